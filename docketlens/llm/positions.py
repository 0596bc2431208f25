"""Places of rows within their key, for keys of any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.session import written_once

_PART_BITS = 33  # the digits below the number of the task in monotonically_increasing_id


def positions(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, a row's place from 0 among those of its ``key`` by ``order``, and ``of_key``, their count.

    Rows are dealt by ranges of (key, order) and sorted in each range, so a key may fill many ranges; places follow from
    the counts of the ranges before, one row for each key and range. Nulls come first, in the key too, which is a value like
    others. Rows of equal order take places in the order of a number given to them when they are first written. The caller's columns must not be named tie, at, part, shift or span_*.
    """
    numbered = written_once(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    by = [key, *order, "tie"]
    # Written, as the ranges are found by a sample: a second run of these steps might cut them elsewhere.
    dealt = numbered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    sorted_rows = written_once(dealt.drop("tie"), f"{name}-sorted").withColumn("part", F.shiftright("at", _PART_BITS))
    spans = sorted_rows.groupBy(key, "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    of_key = Window.partitionBy(key)
    before = F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(
        F.col(key).alias("span_key"), F.col("part").alias("span_part"), (F.coalesce(before, F.lit(0)) - F.col("first_at")).alias("shift"),
        F.sum("n").over(of_key).alias("of_key"),
    )
    found = sorted_rows.join(spans, F.col(key).eqNullSafe(F.col("span_key")) & (F.col("part") == F.col("span_part")))
    return found.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "of_key")
