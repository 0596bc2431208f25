"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", app_name: str = "docketlens", **conf) -> SparkSession:
    """A UTC, ANSI, adaptive session. Extra ``spark.*`` settings go in ``conf``."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster an
    unset ``spark.checkpoint.dir`` is an error, because executors could not read it back.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return os.path.join(tempfile.gettempdir(), "docketlens")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, never reused folder below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a table that several later steps read: it is computed once, and what reads it no longer
    depends on the work behind it when executors are lost.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table. Unlike one made of a list of Python's, it starts no Python workers."""
    return literal_rows(spark, [], schema)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a literal of the plan, without Python workers."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))
