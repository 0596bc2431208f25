import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docketlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="docketlens-tests-") as shared:
        conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": shared}
        session = build_session("local[4]", "tests", **conf)
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
