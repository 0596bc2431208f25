"""Listing lifecycles over ``events``: three periods as history, prior snapshot and observed snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.operators import lifecycle as L
from docketlens.operators.keyed import global_position, keep_last
from docketlens.plans.tables import sql_stamp, stamp, table, within

CHECKED_AT = "2024-01-31T00:00:00.000Z"
PERIODS = [(None, "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", None)]
CONTENT = ["title", "benefit", "summary"]
# The error source parses only rows above this value, so its check fails.
PARSE_FLOOR = 40.0


def period_rows(spark, folder, period: int):
    k = F.get_json_object("props", "$.k").cast("int")
    place = F.col("event_id") % 20
    return table(spark, folder, "events").filter(within(F.col("ts"), *PERIODS[period])).select(
        F.col("event_type").alias("source_id"),
        F.concat_ws("-", "event_type", "user_id", place).alias("record_id"),
        F.concat(F.lit('Program "'), F.col("user_id"), F.lit('" '), place).alias("title"),
        F.concat(F.lit("Tier "), F.floor("value") % 2).alias("benefit"),
        F.concat(F.lit("Summary "), k % 2).alias("summary"),
        stamp(F.col("ts")).alias("at"), "event_id", "user_id", "value",
    )


def snapshot_of(rows, prior: bool):
    """The last row of each record with its lifecycle stamps."""
    last = keep_last(rows, L.KEY, [F.col("event_id")])
    stale = F.lit(prior) & (F.col("user_id") % 7 == 0)
    gone = (~F.lit(prior)) & (F.col("event_id") % 2 == 0)
    return last.select(
        *L.KEY, *CONTENT, (~gone).alias("active"),
        F.when(gone, "removed_from_agency_source").alias("inactive_reason"),
        F.when(stale, "source_check_failed").alias("stale_reason"),
        F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), F.col("at").alias("last_changed_at"),
        F.when(stale, "stale").otherwise("current").alias("freshness"), "event_id",
    )


def source_counts(spark, folder):
    rows = period_rows(spark, folder, 2)
    parsed = (F.col("source_id") != "error") | (F.col("value") > PARSE_FLOOR)
    return L.check_sources(
        rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(parsed).alias("parsed_rows"))
        .select("source_id", (F.col("source_id") != "view").alias("required"), F.lit(3).alias("minimum_records"), "raw_rows", "parsed_rows")
    )


def refreshed(spark, folder, report_recovery=True):
    observed = keep_last(period_rows(spark, folder, 2), L.KEY, [F.col("event_id")]).select(*L.KEY, *CONTENT)
    prior = snapshot_of(period_rows(spark, folder, 1), True).drop("event_id")
    history = snapshot_of(period_rows(spark, folder, 0), False)
    return L.refresh(
        observed, prior, L.latest_snapshots(history, [F.col("event_id")]),
        source_counts(spark, folder), CONTENT, CHECKED_AT, report_recovery,
    )


def snapshot_lifecycle(spark, folder):
    return global_position(L.current_records(refreshed(spark, folder)), [*L.record_order("source_id")])


def lifecycle_events(spark, folder):
    events = L.lifecycle_events(refreshed(spark, folder), CONTENT, CHECKED_AT)
    fields = F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["field"], c["before"], c["after"])), ";")
    return events.withColumn("changes", fields)


def lifecycle_without_recovery(spark, folder):
    """The event counts when the end of a failed check is not reported as a change."""
    events = L.lifecycle_events(refreshed(spark, folder, False), CONTENT, CHECKED_AT)
    return events.groupBy("source_id", "type").agg(F.count(F.lit(1)).alias("events"))


def coverage_status(spark, folder):
    previous = period_rows(spark, folder, 1).groupBy("source_id").agg(F.max("at").alias("last_success_at"))
    return L.coverage(source_counts(spark, folder), refreshed(spark, folder), previous, CHECKED_AT)


def agency_counts(spark, folder):
    return L.counts_by_agency(L.current_records(refreshed(spark, folder)))


QUERIES = {
    "snapshot_lifecycle": snapshot_lifecycle,
    "lifecycle_events": lifecycle_events,
    "lifecycle_without_recovery": lifecycle_without_recovery,
    "coverage_status": coverage_status,
    "agency_counts": agency_counts,
}

# ---- the same in SQL ----


def _sql(recovery: bool) -> str:
    stale_changed = "OR base_stale IS NOT NULL" if recovery else ""
    change = lambda field, before, after: (
        f"CASE WHEN {before} IS DISTINCT FROM {after} THEN "
        f"{{'field': '{field}', 'before': coalesce(CAST(to_json({before}) AS VARCHAR), 'null'), 'after': coalesce(CAST(to_json({after}) AS VARCHAR), 'null')}} END"
    )
    changes = ", ".join([
        change("active", "base_active", "true"), change("benefit", "base_benefit", "n_benefit"),
        change("inactive_reason", "base_inactive", "CAST(NULL AS VARCHAR)"),
        *([change("stale_reason", "base_stale", "CAST(NULL AS VARCHAR)")] if recovery else []),
        change("summary", "base_summary", "n_summary"), change("title", "base_title", "n_title"),
    ])
    return f"""
WITH rows_ AS (
  SELECT event_type AS source_id, event_type || '-' || user_id || '-' || (event_id % 20) AS record_id,
    'Program "' || user_id || '" ' || (event_id % 20) AS title, 'Tier ' || CAST(floor(value) % 2 AS BIGINT) AS benefit,
    'Summary ' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 2) AS summary, {sql_stamp('ts')} AS at_, event_id, user_id, value,
    CASE WHEN ts < TIMESTAMP '{PERIODS[0][1]}' THEN 0 WHEN ts < TIMESTAMP '{PERIODS[1][1]}' THEN 1 ELSE 2 END AS period FROM events),
lasts AS (
  SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY period, source_id, record_id ORDER BY event_id DESC) = 1),
checked AS (
  SELECT *, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status FROM (
    SELECT *, CASE WHEN raw_rows < 3 OR parsed_rows < 3 THEN 'too few rows' WHEN parsed_rows < raw_rows * 0.8 THEN 'extraction was incomplete' END AS error FROM (
      SELECT source_id, source_id <> 'view' AS required, 3 AS minimum_records, count(*) AS raw_rows,
        count(*) FILTER (WHERE source_id <> 'error' OR value > {PARSE_FLOOR}) AS parsed_rows FROM rows_ WHERE period = 2 GROUP BY source_id))),
h AS (SELECT *, event_id % 2 = 1 AS active, CASE WHEN event_id % 2 = 0 THEN 'removed_from_agency_source' END AS inactive FROM lasts WHERE period = 0),
p AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'source_check_failed' END AS stale FROM lasts WHERE period = 1),
n AS (SELECT l.* FROM lasts l JOIN checked USING (source_id) WHERE period = 2 AND status = 'ok'),
joined AS (
  SELECT coalesce(n.source_id, p.source_id) AS source_id, coalesce(n.record_id, p.record_id) AS record_id, n.record_id IS NOT NULL AS is_new, p.record_id IS NOT NULL AS had,
    n.title AS n_title, n.benefit AS n_benefit, n.summary AS n_summary, p.title AS p_title, p.benefit AS p_benefit, p.summary AS p_summary,
    p.stale AS p_stale, p.at_ AS p_at, n.at_ AS n_at FROM n FULL JOIN p ON n.source_id = p.source_id AND n.record_id = p.record_id),
based AS (
  SELECT j.*, c.status, had OR h.record_id IS NOT NULL AS has_base, CASE WHEN had THEN p_title ELSE h.title END AS base_title,
    CASE WHEN had THEN p_benefit ELSE h.benefit END AS base_benefit, CASE WHEN had THEN p_summary ELSE h.summary END AS base_summary,
    CASE WHEN had THEN true ELSE h.active END AS base_active, CASE WHEN had THEN NULL ELSE h.inactive END AS base_inactive,
    CASE WHEN had THEN p_stale END AS base_stale, CASE WHEN had THEN p_at ELSE h.at_ END AS base_at
  FROM joined j JOIN checked c USING (source_id) LEFT JOIN h ON h.record_id = j.record_id),
diffed AS (
  SELECT *, is_new AND has_base AND (base_title <> n_title OR base_benefit <> n_benefit OR base_summary <> n_summary OR NOT base_active
    OR base_inactive IS NOT NULL {stale_changed}) AS differs FROM based),
labelled AS (
  SELECT *, CASE WHEN is_new AND NOT has_base THEN 'discovered' WHEN is_new AND NOT had THEN 'reactivated' WHEN is_new AND differs THEN 'changed'
    WHEN is_new THEN 'unchanged' WHEN status = 'failed' THEN 'retained' ELSE 'deactivated' END AS transition FROM diffed),
final AS (
  SELECT source_id, record_id, transition, coalesce(n_title, p_title) AS title, coalesce(n_benefit, p_benefit) AS benefit, coalesce(n_summary, p_summary) AS summary,
    transition <> 'deactivated' AS active, CASE WHEN transition = 'deactivated' THEN 'removed_from_agency_source' END AS inactive_reason,
    CASE WHEN is_new THEN NULL WHEN transition = 'retained' THEN 'source_check_failed' ELSE p_stale END AS stale_reason,
    CASE WHEN is_new THEN coalesce(base_at, '{CHECKED_AT}') ELSE p_at END AS first_seen_at, CASE WHEN is_new THEN '{CHECKED_AT}' ELSE p_at END AS last_seen_at,
    CASE WHEN transition IN ('discovered', 'deactivated') OR differs THEN '{CHECKED_AT}' WHEN is_new THEN base_at ELSE p_at END AS last_changed_at,
    CASE WHEN transition = 'retained' THEN 'stale' ELSE 'current' END AS freshness,
    CASE WHEN transition = 'changed' THEN list_filter([{changes}], lambda c: c IS NOT NULL) ELSE [] END AS changes FROM labelled)"""


_EVENT_SQL = f"""
SELECT 'event-' || substr(sha256(record_id || '|' || transition || '|{CHECKED_AT}|[' ||
    array_to_string(list_transform(changes, lambda c: '{{"after":' || c.after || ',"before":' || c.before || ',"field":"' || c.field || '"}}'), ',') || ']'), 1, 24) AS event_id,
  record_id, source_id, transition AS type, '{CHECKED_AT}' AS occurred_at,
  coalesce(array_to_string(list_transform(changes, lambda c: c.field || ':' || c.before || ':' || c.after), ';'), '') AS changes,
  CAST(json_object('active', active, 'benefit', benefit, 'first_seen_at', first_seen_at, 'freshness', freshness, 'inactive_reason', inactive_reason,
    'last_changed_at', last_changed_at, 'last_seen_at', last_seen_at, 'record_id', record_id, 'source_id', source_id, 'stale_reason', stale_reason,
    'summary', summary, 'title', title) AS VARCHAR) AS snapshot
FROM final WHERE transition IN ('discovered', 'changed', 'reactivated', 'deactivated')"""

ORACLES = {
    "snapshot_lifecycle": _sql(True) + "\nSELECT * EXCLUDE (changes), row_number() OVER (ORDER BY source_id, lower(title), record_id) AS position FROM final WHERE transition <> 'deactivated'",
    "lifecycle_events": _sql(True) + _EVENT_SQL,
    "lifecycle_without_recovery": _sql(False) + """
SELECT source_id, transition AS type, count(*) AS events FROM final
WHERE transition IN ('discovered', 'changed', 'reactivated', 'deactivated') GROUP BY ALL""",
    "coverage_status": _sql(True) + f""",
kept AS (
  SELECT source_id, count(*) FILTER (WHERE transition = 'retained') AS stale_retention_count,
    count(*) FILTER (WHERE transition NOT IN ('retained', 'deactivated')) AS record_count FROM final GROUP BY source_id),
before AS (SELECT source_id, max(at_) AS at_ FROM rows_ WHERE period = 1 GROUP BY source_id),
sources AS (
  SELECT c.*, coalesce(stale_retention_count, 0) AS stale_retention_count, coalesce(record_count, 0) AS record_count, coalesce(record_count, 0) AS active_record_count,
    CASE WHEN status = 'ok' THEN '{CHECKED_AT}' ELSE at_ END AS last_success_at FROM checked c LEFT JOIN kept USING (source_id) LEFT JOIN before USING (source_id)),
overall AS (
  SELECT count(*) FILTER (WHERE required) AS required_source_count, count(*) FILTER (WHERE required AND status = 'ok') AS required_success_count,
    bool_and(NOT required OR status = 'ok') AS all_required_sources_succeeded, bool_or(status = 'ok' OR stale_retention_count > 0) AS any_ FROM sources)
SELECT s.*, required_source_count, required_success_count, all_required_sources_succeeded,
  CASE WHEN all_required_sources_succeeded THEN 'complete' WHEN any_ THEN 'degraded' ELSE 'failed' END AS overall_status FROM sources s, overall""",
    "agency_counts": _sql(True) + """
SELECT source_id AS agency, count(*) AS records FROM final WHERE transition <> 'deactivated' GROUP BY source_id""",
}
