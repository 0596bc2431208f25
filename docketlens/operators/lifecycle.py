"""Listing snapshots of several sources: lifecycle states, history events and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.diff import field_changes, lifecycle_event_id
from docketlens.functions.text import canonical_json
from docketlens.operators.keyed import keep_last

KEY = ["source_id", "record_id"]
# Fields every record has besides its own content; the lifecycle stamps take no part in the diff.
STATE = ["active", "inactive_reason", "stale_reason"]
STAMPS = ["first_seen_at", "last_seen_at", "last_changed_at", "freshness"]


def latest_snapshots(history: DataFrame, order: list[Column]) -> DataFrame:
    """The last snapshot of each record in log order."""
    return keep_last(history, ["record_id"], order)


def refresh(
    observed: DataFrame,
    prior: DataFrame,
    historical: DataFrame,
    source_status: DataFrame,
    content: list[str],
    checked_at: str,
    report_recovery: bool = True,
) -> DataFrame:
    """Join a checked snapshot with the prior one and label each record with its ``transition``.

    ``observed`` has KEY and ``content``; ``prior`` and ``historical`` (one row for each record id)
    also have STATE and STAMPS; ``source_status`` has (source_id, status). Records of a failed source
    are retained as stale; records of a source without a status row are dropped. With
    ``report_recovery`` the loss of ``stale_reason`` after a failed check counts as a change.
    """
    fields = [*content, *STATE]
    status = source_status.select("source_id", "status")
    ok = status.filter(F.col("status") == "ok")
    seen = observed.join(ok.select("source_id"), "source_id", "left_semi").select(
        *KEY, F.struct(*content).alias("n")
    )
    old = prior.select(*KEY, F.struct(*fields, *STAMPS).alias("p"))
    past = historical.select("record_id", F.struct(*fields, *STAMPS).alias("h"))
    joined = (
        seen.join(old, KEY, "full_outer")
        .join(status, "source_id")
        .join(past, "record_id", "left")
    )
    return label(joined, content, checked_at, report_recovery)


def label(joined: DataFrame, content: list[str], checked_at: str, report_recovery: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """The second half of ``refresh``, over KEY, ``status`` and a record as observed (``n``), in the prior snapshot (``p``) and in history (``h``).

    ``extra`` names columns to keep.
    """
    fields = [*content, *STATE]
    new, had = F.col("n").isNotNull(), F.col("p").isNotNull()
    base = F.coalesce("p", "h")
    now = F.lit(checked_at)

    fresh = {name: F.col(f"n.{name}") for name in content}
    fresh |= {"active": F.lit(True), "inactive_reason": F.lit(None).cast("string"), "stale_reason": F.lit(None).cast("string")}
    compared = [f for f in fields if report_recovery or f != "stale_reason"]
    compared_base = {f: F.col(f"base.{f}") for f in compared}
    changes = field_changes(compared_base, {f: fresh[f] for f in compared})

    prepared = joined.withColumn("base", base).withColumn(
        "changes", F.when(new & F.col("base").isNotNull(), changes)
    )
    differs = F.coalesce(F.size("changes") > 0, F.lit(False))
    transition = (
        F.when(new & F.col("base").isNull(), "discovered")
        .when(new & ~had, "reactivated")
        .when(new & differs, "changed")
        .when(new, "unchanged")
        .when(F.col("status") == "failed", "retained")
        .otherwise("deactivated")
    )
    labelled = prepared.withColumn("transition", transition)
    gone, stale = F.col("transition") == "deactivated", F.col("transition") == "retained"
    kept = {
        "active": F.when(gone, F.lit(False)).otherwise(F.col("p.active")),
        "inactive_reason": F.when(gone, "removed_from_agency_source").otherwise(F.col("p.inactive_reason")),
        "stale_reason": F.when(stale, "source_check_failed").otherwise(F.col("p.stale_reason")),
    }
    value = lambda f: F.when(new, fresh[f]).otherwise(kept.get(f, F.col(f"p.{f}"))).alias(f)
    moved = F.when(differs, now).otherwise(F.coalesce("base.last_changed_at", now))
    return labelled.select(
        *KEY,
        "transition",
        *[value(f) for f in fields],
        F.when(new, F.coalesce("base.first_seen_at", now)).otherwise(F.col("p.first_seen_at")).alias("first_seen_at"),
        F.when(new, now).otherwise(F.col("p.last_seen_at")).alias("last_seen_at"),
        F.when(new, moved).when(gone, now).otherwise(F.col("p.last_changed_at")).alias("last_changed_at"),
        F.when(stale, "stale").otherwise("current").alias("freshness"),
        # Only a plain change lists its fields; a reactivation event carries none.
        F.when(F.col("transition") == "changed", F.col("changes")).otherwise(
            F.expr("array()").cast("array<struct<field:string,before:string,after:string>>")
        ).alias("changes"),
        *extra,
    )


def current_records(refreshed: DataFrame) -> DataFrame:
    return refreshed.filter(F.col("transition") != "deactivated").drop("changes")


def is_event(transition: Column) -> Column:
    return transition.isin("discovered", "changed", "reactivated", "deactivated")


def event_snapshot(content: list[str]) -> Column:
    """A record as its event keeps it."""
    return canonical_json({c: F.col(c) for c in ["record_id", "source_id", *content, *STATE, *STAMPS]})


def lifecycle_events(refreshed: DataFrame, content: list[str], checked_at: str, snapshot: Column | None = None) -> DataFrame:
    """Append-only events of the run: discovered, changed, reactivated and deactivated; ``snapshot``: their ``event_snapshot``, where it is known."""
    now = F.lit(checked_at)
    return refreshed.filter(is_event(F.col("transition"))).select(
        lifecycle_event_id(F.col("record_id"), F.col("transition"), now, F.col("changes")).alias("event_id"),
        "record_id",
        "source_id",
        F.col("transition").alias("type"),
        now.alias("occurred_at"),
        "changes",
        (event_snapshot(content) if snapshot is None else snapshot).alias("snapshot"),
    )


def check_sources(counts: DataFrame, minimum_share: float = 0.8) -> DataFrame:
    """Status of each source from its raw and parsed row counts; a failed one does not stop the rest.

    ``counts`` has (source_id, required, minimum_records, raw_rows, parsed_rows).
    """
    too_few = (F.col("raw_rows") < F.col("minimum_records")) | (F.col("parsed_rows") < F.col("minimum_records"))
    incomplete = F.col("parsed_rows") < F.col("raw_rows") * minimum_share
    error = F.when(too_few, "too few rows").when(incomplete, "extraction was incomplete")
    return counts.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "ok").otherwise("failed")
    )


def coverage(
    checked: DataFrame, refreshed: DataFrame, previous: DataFrame, checked_at: str
) -> DataFrame:
    """One row for each source with the overall status beside it.

    ``previous`` has (source_id, last_success_at) of the run before.
    """
    ok = F.col("status") == "ok"
    per_source = refreshed.groupBy("source_id").agg(
        F.count_if(F.col("transition") == "retained").alias("stale_retention_count"),
        F.count_if(~F.col("transition").isin("retained", "deactivated")).alias("record_count"),
        F.count_if(~F.col("transition").isin("retained", "deactivated") & F.col("active")).alias("active_record_count"),
    )
    sources = (
        checked.join(per_source, "source_id", "left")
        .join(previous.select("source_id", F.col("last_success_at").alias("_before")), "source_id", "left")
        .fillna(0, ["stale_retention_count", "record_count", "active_record_count"])
        .withColumn("last_success_at", F.when(ok, F.lit(checked_at)).otherwise(F.col("_before")))
        .drop("_before")
    )
    # One row for each configured source, so all of them fit the one row of the overall status.
    whole = sources.agg(
        F.collect_list(F.struct(*sources.columns)).alias("_sources"),
        F.count_if("required").alias("required_source_count"),
        F.count_if(F.col("required") & ok).alias("required_success_count"),
        F.coalesce(F.bool_and(~F.col("required") | ok), F.lit(True)).alias("all_required_sources_succeeded"),
        F.coalesce(F.bool_or(ok | (F.col("stale_retention_count") > 0)), F.lit(False)).alias("_any"),
    )
    overall = (
        F.when(F.col("all_required_sources_succeeded"), "complete").when(F.col("_any"), "degraded").otherwise("failed")
    )
    return whole.withColumn("overall_status", overall).select(
        F.inline("_sources"), "required_source_count", "required_success_count", "all_required_sources_succeeded",
        "overall_status",
    )


def counts_by_agency(records: DataFrame, agency: str = "source_id") -> DataFrame:
    return records.groupBy(F.col(agency).alias("agency")).agg(F.count(F.lit(1)).alias("records"))


def record_order(agency: str = "agency_code") -> list[Column]:
    """Agency, then title ignoring case and accents, then id."""
    return [
        F.collate(F.col(agency), "UNICODE"), F.collate(F.col("title"), "UNICODE_CI_AI"),
        F.collate(F.col("record_id"), "UNICODE"),
    ]
