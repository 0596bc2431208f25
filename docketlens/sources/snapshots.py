"""Versioned table snapshots: written to a new folder, never over the folder being read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def version_path(root: str, version: int) -> str:
    return f"{root}/v{version:08d}"


def write_snapshot(df: DataFrame, path: str, schema_version: int = SCHEMA_VERSION) -> None:
    """Write a full snapshot with its schema version. Repeating the same write replaces it whole."""
    df.withColumn("schema_version", F.lit(schema_version)).write.mode("overwrite").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def existing_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in the file system the pattern names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(status.getPath().toString() for status in found or [])


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: under another name first. A file that is there already is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path}.draft")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(target) or not system.rename(draft, target):
        raise FileExistsError(path)


def read_snapshot(
    spark: SparkSession, path: str, schema: str, schema_version: int = SCHEMA_VERSION
) -> DataFrame:
    """The snapshot at ``path``, or an empty table of ``schema`` when there is none.

    A row of another schema version makes the reading job fail.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, schema_version int").parquet(path)
    checked = F.assert_true(
        F.col("schema_version") == schema_version,
        F.concat(F.lit("unsupported schema version: "), F.col("schema_version").cast("string")),
    )
    return rows.filter(checked.isNull()).drop("schema_version")


def read_json_catalog(
    spark: SparkSession, path: str, schema: str, schema_version: int = SCHEMA_VERSION
) -> DataFrame:
    """Records of a JSON catalog document ``{schemaVersion, records: [...]}``, empty when absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    document = spark.read.option("multiLine", "true").schema(
        f"schemaVersion int, records array<struct<{schema}>>"
    ).json(path)
    checked = F.assert_true(
        F.col("schemaVersion") == schema_version, F.lit("unsupported schema version")
    )
    return document.filter(checked.isNull()).select(F.inline("records"))
