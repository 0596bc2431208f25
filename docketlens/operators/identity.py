"""Merging records that denote the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.text import clean_text
from docketlens.functions.urls import canonical_url

LONGEST = ["summary", "eligibility", "benefit"]


def identity_key(kind: Column, action_url: Column, provenance_url: Column, title: Column) -> Column:
    """``kind|canonical action URL``, else the provenance URL, else the lower-case title."""
    where = F.coalesce(canonical_url(action_url), canonical_url(provenance_url), F.lower(clean_text(title)))
    return F.concat_ws("|", kind, where)


def _longest(name: str, order: list[Column]) -> Column:
    """Longest non-empty text, earlier on ties; when all are empty, the last value as it is."""
    value = F.col(name)
    filled = F.when(value != "", value)
    rank = F.when(filled.isNotNull(), F.struct((-F.length(value)).alias("l"), *order))
    return F.coalesce(F.min_by(filled, rank), F.max_by(value, F.struct(*order))).alias(name)


def merge_records(records: DataFrame, order: list[Column], longest: list[str] | None = None) -> DataFrame:
    """One row for each ``identity_key``: the first record, with the longest of some texts.

    Set-valued fields are left to ``merged_members``.
    """
    longest = LONGEST if longest is None else longest
    first = [c for c in records.columns if c not in ("identity_key", *longest)]
    merged = records.groupBy("identity_key").agg(
        F.min_by(F.struct(*first), F.struct(*order)).alias("r"),
        *[_longest(name, order) for name in longest],
        F.count(F.lit(1)).alias("merged_count"),
    )
    return merged.select("identity_key", "r.*", *longest, "merged_count")


def merged_members(records: DataFrame, members: dict[str, Column]) -> DataFrame:
    """Set unions of a merge as rows (identity_key, member, value).

    A union is kept as rows, not as one array, because an identity shared by a large part of all
    records would not fit one row.
    """
    pairs = F.array(
        *[F.struct(F.lit(name).alias("member"), value.alias("value")) for name, value in members.items()]
    )
    return (
        records.select("identity_key", F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .distinct()
    )
