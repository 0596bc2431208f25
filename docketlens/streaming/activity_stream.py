"""Claim activity from a stream of row versions: a state store keeps each claim's last version between batches, by buckets of claims."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketlens.operators import ledger as L
from docketlens.streaming.state import rocksdb_store

VERSION = (
    "claim_id string, user_id string, case_id string, seq bigint, at timestamp_ntz, personal_status string, "
    "status_provenance string, confirmation_number string, submitted_at timestamp_ntz, approved_at timestamp_ntz, "
    "approved_amount_cents bigint, paid_at timestamp_ntz, received_amount_cents bigint, amount_source string, "
    "private_note string"
)
ACTIVITY = (
    "user_id string, claim_id string, event_type string, personal_status string, provenance string, "
    "confirmation_number string, amount_cents bigint, amount_kind string, occurred_at timestamp_ntz"
)
_PAIR = "claim_id string, version string, before string"
#: Claims are kept by buckets: a call of Python costs more than all else that is done for a claim.
BUCKETS = 4096
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def previous_versions(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs each version with the one before it of its claim. A bucket's state is the last version of each of its claims; what a
    batch has of a bucket is ordered in memory.
    """
    names = ["seq", "claim_id", "version"]
    rows = [row for chunk in chunks for row in zip(*(chunk[c].tolist() for c in names), strict=True)]
    last = dict(json.loads(state.get[0])) if state.exists else {}
    pairs = []
    for _, claim, version in sorted(rows, key=lambda row: row[0]):
        pairs.append((claim, version, last.get(claim)))
        last[claim] = version
    state.update((json.dumps(list(last.items())),))
    yield pd.DataFrame(pairs, columns=["claim_id", "version", "before"])


class ActivityStream:
    def __init__(self, root: str):
        self.root = root

    def run(self, spark: SparkSession, versions_path: str, max_files: int = 100) -> StreamingQuery:
        """Log the events of all versions not yet read. The file sink lists what each batch wrote, so a retried batch adds nothing twice."""
        versions = spark.readStream.schema(VERSION).option("maxFilesPerTrigger", max_files).parquet(versions_path)
        written = versions.select("claim_id", "seq", F.to_json(F.struct(*versions.columns), _TIMES).alias("version"))
        bucketed = written.withColumn("bucket", F.pmod(F.xxhash64("claim_id"), F.lit(BUCKETS)))
        pairs = bucketed.groupBy("bucket").applyInPandasWithState(previous_versions, _PAIR, "version string", "append", GroupStateTimeout.NoTimeout)
        read = lambda name: F.from_json(name, VERSION, _TIMES)
        rows = pairs.select(read("version").alias("v"), read("before").alias("_old")).select("v.*", "_old")
        with rocksdb_store(spark):
            query = (
                L.version_events(rows).writeStream.format("parquet").outputMode("append").option("path", f"{self.root}/activity")
                .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
            )
        query.awaitTermination()
        return query

    def events(self, spark: SparkSession) -> DataFrame:
        """The whole append-only log."""
        return spark.read.schema(ACTIVITY).parquet(f"{self.root}/activity")
