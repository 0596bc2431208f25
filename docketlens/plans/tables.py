"""Access to the input tables and small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# The column that identifies a row, for tables whose rows are costly to process.
SPREAD_KEYS = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


# A setting for one machine, whose tables are files of a single split: over how many parts they are spread.
SPREAD = "spark.docketlens.spread"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, scanned as its files are split, without a shuffle.

    Only where the session asks for it, as the benchmark does, tables of costly rows are spread by their key.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(SPREAD, None)
    return rows.repartition(int(parts), SPREAD_KEYS[name]) if parts and name in SPREAD_KEYS else rows


def row_count(spark: SparkSession, folder: str, name: str) -> int:
    """The rows of a table, out of its file footers; keys of the given tables run from 1 to it."""
    return table(spark, folder, name).count()


def within(at: Column, start: str | None, end: str | None) -> Column:
    """Whether a time lies in a period; a side without a bound is open."""
    bound = lambda day: F.lit(day).cast("timestamp_ntz")
    return (at >= bound(start) if start else at.isNotNull()) & (at < bound(end) if end else F.lit(True))


def pick(at: Column, values: list) -> Column:
    """The ``at``-th (0-based) of a list of literals."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def sql_pick(at: str, values: list) -> str:
    """The same for DuckDB."""
    literals = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{literals}])[({at}) + 1]"


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def day(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
