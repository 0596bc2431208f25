"""Semantic record comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlens.functions.text import json_value, short_hash


def field_changes(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Array of (field, before, after) JSON texts for fields that differ, in field-name order.

    A field only one side has counts as null on the other.
    """

    def side(fields: dict[str, Column], name: str) -> Column:
        return json_value(fields[name]) if name in fields else F.lit("null")

    def differs(name: str) -> Column:
        if name in before and name in after:
            return ~before[name].eqNullSafe(after[name])
        return (before if name in before else after)[name].isNotNull()

    entries = [
        F.when(
            differs(name),
            F.struct(
                F.lit(name).alias("field"), side(before, name).alias("before"), side(after, name).alias("after")
            ),
        )
        for name in sorted(set(before) | set(after))
    ]
    return F.array_compact(F.array(*entries))


def changes_json(changes: Column) -> Column:
    """Canonical JSON of a change array; before and after already are JSON texts."""
    each = F.transform(
        changes,
        lambda c: F.concat(
            F.lit('{"after":'), c["after"], F.lit(',"before":'), c["before"],
            F.lit(',"field":"'), c["field"], F.lit('"}'),
        ),
    )
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def lifecycle_event_id(record_id: Column, kind: Column, occurred_at: Column, changes: Column) -> Column:
    text = F.concat_ws("|", record_id, kind, occurred_at, changes_json(changes))
    return F.concat(F.lit("event-"), short_hash(text, 24))
