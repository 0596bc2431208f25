"""Search-hit pages: JSON envelopes with a nested ``results`` array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.sources.schemas import HIT_PAGE


def _placed(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})


def hits_of(pages: DataFrame) -> DataFrame:
    """One row for each hit with its ``hit_order``. A page without a ``results`` array fails the job.

    Pages read from files are ordered by file and place in it; others by their place in the input.
    """
    # Inside the explode, so that no inferred filter can drop the malformed page before the check.
    results = F.coalesce("results", F.raise_error(F.lit("unexpected response shape")))
    place = ["_file", "_block"] if "_file" in pages.columns else []
    return (
        pages.withColumn("_page", F.monotonically_increasing_id())
        .select(*place, "_page", F.posexplode(results).alias("_at", "_hit"))
        .select("_hit.*", F.struct(*place, "_page", "_at").alias("hit_order"))
    )


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return hits_of(_placed(spark.read.schema(HIT_PAGE).option("mode", "FAILFAST").json(path)))


def stream_pages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same pages as a stream; ``max_files`` bounds the work of one micro-batch."""
    return _placed(spark.readStream.schema(HIT_PAGE).option("mode", "FAILFAST").option("maxFilesPerTrigger", max_files).json(path))
