"""Incremental docket upsert: search-hit files stream in, merged dockets accumulate by buckets of dockets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.operators import dockets as D
from docketlens.sources.schemas import DOCKET, DOCKET_FILING
from docketlens.sources.search_hits import hits_of, stream_pages
from docketlens.streaming.state import BucketedState, DeltaState, run_available

RUN = "run int, observed_at string, degraded boolean, raw_results_seen bigint, accepted_results bigint"


class DocketStream:
    """State below ``root``: ``records`` and ``filings`` by docket, ``runs`` by micro-batch."""

    def __init__(self, root: str):
        self.root = root
        self.records = BucketedState(f"{root}/records", DOCKET, ["docket_id"])
        self.filings = BucketedState(f"{root}/filings", DOCKET_FILING, ["docket_id"])
        self.runs = DeltaState(f"{root}/runs", RUN, ["run"])

    def merge_batch(self, pages: DataFrame, batch_id: int, observed_at: str, degraded: bool = False) -> None:
        """Merge one batch of pages: only the dockets it names are read, merged and written."""
        spark = pages.sparkSession
        hits = hits_of(pages)
        # Read by several writes below; a lost cached part is computed again.
        accepted = D.normalize_hits(hits, observed_at).persist()
        observed, filings = D.dedupe_dockets(accepted), D.filings_of(accepted)
        before = self.records.current(spark, batch_id, observed).drop("batch")
        # An observed docket's filings replace its earlier ones, and its digest tells whether they differ: none are read.
        none = spark.createDataFrame([], DOCKET_FILING)
        records, merged_filings = D.merge_dockets(before, none, observed, filings, observed_at)
        self.records.write(records, batch_id)
        self.filings.write(merged_filings, batch_id)
        counts = D.run_metrics(hits, accepted).select(
            F.lit(batch_id).alias("run"), F.lit(observed_at).alias("observed_at"), F.lit(degraded).alias("degraded"),
            "raw_results_seen", "accepted_results",
        )
        self.runs.write(counts, batch_id)
        accepted.unpersist()

    def run(
        self, spark: SparkSession, pages_path: str, stamp: Callable[[int], str],
        degraded: Callable[[int], bool] = lambda _batch: False, max_files: int = 100,
    ) -> None:
        """Process all files not yet processed. ``stamp`` must give a retried batch the same time."""

        def each(pages: DataFrame, batch_id: int) -> None:
            self.merge_batch(pages, batch_id, stamp(batch_id), degraded(batch_id))

        run_available(stream_pages(spark, pages_path, max_files), each, f"{self.root}/checkpoint")

    def current(self, spark: SparkSession) -> DataFrame:
        """Current records. A record not seen since the last degraded run is stale."""
        # One number of the run log, which has one row for each micro-batch.
        last_bad = self.runs.deltas(spark).filter("degraded").agg(F.max("run")).first()[0]
        records = self.records.current(spark)
        if last_bad is not None:
            fresh = F.when(F.col("batch") < last_bad, "stale").otherwise(F.col("freshness"))
            records = records.withColumn("freshness", fresh)
        return records.drop("batch")

    def current_filings(self, spark: SparkSession) -> DataFrame:
        return self.filings.current(spark).drop("batch")

    def totals(self, spark: SparkSession) -> DataFrame:
        """Counts of all runs so far; a resumed stream carries on from them."""
        return self.runs.deltas(spark).agg(
            F.count(F.lit(1)).alias("runs"), F.sum("raw_results_seen").alias("raw_results_seen_total"),
            F.sum("accepted_results").alias("accepted_results_total"),
        )
