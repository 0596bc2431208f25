"""Survival buckets as streaming counts: the curve is computed when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketlens.operators import survival as S
from docketlens.streaming.state import BucketedState, run_available

OBSERVATION = "cohort string, clock string, days int, event boolean, reason string"
GROUPS = ["cohort", "clock"]


class SurvivalStream:
    def __init__(self, root: str):
        self.root = root
        self.state = BucketedState(
            f"{root}/buckets", "cohort string, clock string, days int, events bigint, censored bigint", [*GROUPS, "days"]
        )

    def run(self, spark: SparkSession, observations_path: str, max_files: int = 100) -> None:
        """Count all observations not yet counted; each micro-batch writes the buckets it changed."""
        observed = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", max_files).parquet(observations_path)
        run_available(S.survival_buckets(observed, GROUPS), self.state.write, f"{self.root}/checkpoint", "update")

    def buckets(self, spark: SparkSession) -> DataFrame:
        return self.state.current(spark).drop("batch")

    def curve(self, spark: SparkSession) -> DataFrame:
        return S.survival_curve(self.buckets(spark), GROUPS)
