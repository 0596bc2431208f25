"""Keyed reductions that survive a hot key.

Everything here either aggregates map-side (so a key holding a third of all rows reaches its
reducer as one partial row for each map task) or splits a key into blocks before ordering it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.session import written_once


def _row(columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns`` behind a one-row generator.

    Spark copies a projected expression into every filter and projection above it; for parsing
    expressions that multiplies the work. It does not copy the output of a generator.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    chosen = df.groupBy(*keys).agg(pick(_row(rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def without_keys(df: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(removed.select(*keys).distinct(), keys, "left_anti")


def only_keys(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def previous_row(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, columns: list[str], into: str
) -> DataFrame:
    """Add ``into``: a struct of ``columns`` from the preceding row of the same key, null for the first.

    ``block`` must not decrease along ``order`` and must not be null; rows of one key are ordered
    within each block, and only one summary row for each block is ordered across blocks. A hot key
    is thus sorted by as many tasks as it has blocks.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    placed = df.withColumn("_block", block).withColumns({
        "_prev": F.lag(_row(columns)).over(inside),
        "_first": F.row_number().over(inside) == 1,
        "_last": F.lead(F.lit(1)).over(inside).isNull(),
    })
    across = Window.partitionBy(*keys).orderBy("_block")
    ends = placed.filter("_last").select(*keys, "_block", F.lag(_row(columns)).over(across).alias("_carry"))
    return (
        placed.join(ends, [*keys, "_block"], "left")
        .withColumn(into, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_block", "_prev", "_first", "_last", "_carry")
    )


def running_position(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, into: str
) -> DataFrame:
    """Add ``into``: the 1-based position of each row in its key, counted block by block.

    The same two-level scheme as ``previous_row``: positions inside a block plus the number of rows
    in earlier blocks.
    """
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_before")
    )
    return (
        blocked.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(into, F.col("_before") + F.col("_at"))
        .drop("_block", "_before", "_at")
    )


def global_position(df: DataFrame, order: list[Column], into: str = "position") -> DataFrame:
    """``df`` with its rows numbered from 1 in ``order``, which should be total; no task ever holds all rows.

    Rows are dealt by ranges of the order, sorted in each range and written; the ranges' counts, one number each, give where each
    range begins. Reading the result in the order of ``into`` needs no comparison but of numbers.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = written_once(dealt.withColumn("_at", F.monotonically_increasing_id()), "positions")
    part, mask = F.shiftright("_at", 33), (1 << 33) - 1
    counts = {r["part"]: r["n"] for r in sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins = [sum(counts.get(p, 0) for p in range(k)) for k in range(max(counts, default=0) + 1)]
    begin = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in begins]), (part + 1).cast("int"))
    return sorted_rows.withColumn(into, begin + F.col("_at").bitwiseAND(F.lit(mask)) + 1).drop("_at")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """At most ``k`` rows for each key, numbered in ``rank`` if named.

    Spark limits each partition before the shuffle.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    numbered = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.filter(F.col(rank or "_rank") <= k)
    return kept if rank else kept.drop("_rank")


def fill_forward(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, columns: list[str], firsts: tuple[str, ...] = ()
) -> DataFrame:
    """Replace nulls in ``columns`` by the last value before them in the same key, block by block.

    Each of ``firsts`` becomes the first value of its key that is not null, from the row that has it on, in the same pass.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn("_block", block).withColumns(
        {c: F.last(c, ignorenulls=True).over(so_far) for c in columns}
        | {c: F.first(c, ignorenulls=True).over(so_far) for c in firsts}
        | {"_last": F.lead(F.lit(1)).over(inside).isNull()}
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = filled.filter("_last").select(
        *keys, "_block", *[F.last(c, ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns],
        *[F.first(c, ignorenulls=True).over(before).alias(f"_carry_{c}") for c in firsts],
    )
    return (
        filled.join(ends, [*keys, "_block"], "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns})
        .withColumns({c: F.coalesce(F.col(f"_carry_{c}"), F.col(c)) for c in firsts})
        .drop("_block", "_last", *[f"_carry_{c}" for c in [*columns, *firsts]])
    )
