"""Keyed state of a stream in append-only parquet folders, one for each micro-batch, folded into a base by buckets of keys.

A batch writes only the keys it touched. A retried batch replaces its own folder and reads only what earlier ones wrote, so every
batch takes effect once even when executors or the driver are lost in between. ``DeltaState`` keeps all deltas, as a log;
``BucketedState`` folds them, so that what a batch reads follows the keys it touches and not the batches before it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docketlens.operators.keyed import only_keys
from docketlens.session import no_rows
from docketlens.sources.snapshots import delete_path, existing_paths, path_exists


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What the last batch of each key wrote. All rows a batch wrote for a key belong together."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"], "left_semi")


@dataclass(frozen=True)
class DeltaState:
    path: str
    schema: str
    keys: list[str]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def deltas(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All rows ever written, with their ``batch``; only batches below ``before`` if given."""
        schema = f"{self.schema}, batch int"
        if not path_exists(spark, self.path):
            return no_rows(spark, schema)
        rows = spark.read.schema(schema).parquet(self.path)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def current(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The newest delta of each key; ``only`` restricts the keys before anything is grouped.

        All rows a batch wrote for a key belong together: a key may have several rows.
        """
        rows = self.deltas(spark, before)
        if only is not None:
            rows = only_keys(rows, only, self.keys)
        return newest(rows, self.keys)


@dataclass(frozen=True)
class BucketedState:
    """Rows by key: ``deltas/batch=i/bucket=b`` and, every ``fold_every`` batches, ``base/upto=i/bucket=b`` of the buckets touched since.

    A folder counts once its writer has marked it complete. Reading for a batch takes, of each bucket the batch touches, the newest
    base from before the batch and the deltas after the last fold: fewer than ``fold_every`` of them. A fold drops what the fold
    before it made needless; a batch is retried only as the last one, so what its retry reads is still there.
    """

    path: str
    schema: str
    keys: list[str]
    buckets: int = 16
    fold_every: int = 8

    def _bucket(self) -> Column:
        types = {f.name: f.dataType for f in T.StructType.fromDDL(self.schema)}
        return F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Batches with a complete folder of a kind, ``deltas/batch`` or ``base/upto``."""
        return sorted(int(p.split("/")[-2].split("=")[1]) for p in existing_paths(spark, f"{self.path}/{kind}=*/_SUCCESS"))

    def _folders(self, spark: SparkSession, kind: str) -> list[tuple[int, int, str]]:
        """(number, bucket, path) of every bucket folder of a kind."""
        found = existing_paths(spark, f"{self.path}/{kind}=*/bucket=*")
        return sorted((int(p.split("/")[-2].split("=")[1]), int(p.split("=")[-1]), p) for p in found)

    def paths(self, spark: SparkSession, before: int | None = None, buckets: set[int] | None = None) -> list[str]:
        """The folders that hold the state from before a batch."""
        early = lambda numbers: {n for n in numbers if before is None or n < before}
        folds, batches = early(self._numbers(spark, "base/upto")), early(self._numbers(spark, "deltas/batch"))
        bases = {bucket: path for n, bucket, path in self._folders(spark, "base/upto") if n in folds}
        deltas = [(bucket, path) for n, bucket, path in self._folders(spark, "deltas/batch") if n in batches and n > max(folds, default=-1)]
        return [path for bucket, path in [*bases.items(), *deltas] if buckets is None or bucket in buckets]

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, batch int"
        return spark.read.schema(schema).parquet(*paths) if paths else no_rows(spark, schema)

    def current(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The newest rows of each key, with their ``batch``; ``only`` restricts the keys, and the buckets that are read."""
        if only is None:
            return newest(self._read(spark, self.paths(spark, before)), self.keys)
        # At most as many numbers as there are buckets.
        touched = {r[0] for r in only.select(self._bucket()).distinct().collect()}
        return newest(only_keys(self._read(spark, self.paths(spark, before, touched)), only, self.keys), self.keys)

    def _write(self, rows: DataFrame, folder: str) -> None:
        # Rebalanced, so that a batch writes few files and a bucket with a hot key is still written by many tasks.
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._write(rows.withColumn("batch", F.lit(batch_id)), f"{self.path}/deltas/batch={batch_id}")
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(rows.sparkSession, batch_id)

    def fold(self, spark: SparkSession, batch_id: int) -> None:
        """Write the state up to and with a batch as a base, for the buckets touched since the fold before."""
        folds = [n for n in self._numbers(spark, "base/upto") if n < batch_id]
        past = folds[-1] if folds else -1
        touched = {bucket for n, bucket, _ in self._folders(spark, "deltas/batch") if past < n <= batch_id}
        # Without the base of an earlier try of this batch.
        delete_path(spark, f"{self.path}/base/upto={batch_id}")
        rows = newest(self._read(spark, self.paths(spark, batch_id + 1, touched)), self.keys)
        self._write(rows, f"{self.path}/base/upto={batch_id}")
        for n, _, path in self._folders(spark, "deltas/batch"):
            if n <= past:
                delete_path(spark, path)
        newest_base: dict[int, str] = {}
        for n, bucket, path in self._folders(spark, "base/upto"):
            if n <= past:
                if bucket in newest_base:
                    delete_path(spark, newest_base[bucket])
                newest_base[bucket] = path


@contextlib.contextmanager
def rocksdb_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which does not hold it all in memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_available(stream: DataFrame, each_batch, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Run every available micro-batch through ``each_batch(rows, batch_id)``, resuming from ``checkpoint``."""
    query = (
        stream.writeStream.foreachBatch(each_batch).outputMode(output_mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
