"""Versions, audited writes and run states: jobs that write, check, publish and read back what they published."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.operators import catalog as C
from docketlens.operators import lifecycle as L
from docketlens.operators import run_state as R
from docketlens.operators import survival as S
from docketlens.operators.audited import publish_staged, stage_rows
from docketlens.operators.keyed import keep_last
from docketlens.plans import catalog_browsing, docket_survival, source_lifecycle
from docketlens.plans.source_lifecycle import CONTENT, PARSE_FLOOR, PERIODS, period_rows
from docketlens.session import run_dir
from docketlens.sources.publication import Publication, Refused
from docketlens.sources.snapshots import write_text
from docketlens.streaming.lifecycle_stream import COVERAGE, LifecycleStream

CHECKS = ["2024-01-11T00:00:00.000Z", "2024-01-21T00:00:00.000Z", "2024-02-01T00:00:00.000Z"]
#: In this check the error source parses too little and fails.
FAILING = 1


# ---- listing lifecycle as a stream ----


def arriving_check(spark: SparkSession, folder: str, root: str, number: int) -> dict:
    """The rows of a period written as a check, with its manifest last."""
    rows, path = period_rows(spark, folder, number), f"{root}/observed/check-{number}"
    keep_last(rows, L.KEY, [F.col("event_id")]).select(*L.KEY, *CONTENT).write.parquet(path)
    parsed = (F.col("source_id") != "error") | (F.col("value") > PARSE_FLOOR) | (F.lit(number) != FAILING)
    # One row for each source.
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(parsed).alias("parsed_rows")).collect()
    sources = [{**r.asDict(), "required": r["source_id"] != "view", "minimum_records": 1} for r in counts]
    check = {"checked_at": CHECKS[number], "path": path, "sources": sources}
    write_text(spark, f"{root}/checks/check-{number}.json", json.dumps(check))
    return check


def run_lifecycle_stream(spark: SparkSession, folder: str) -> LifecycleStream:
    """Three checks arriving one after the other; the second is applied again, as after a lost driver."""
    root = run_dir(spark, "lifecycle-stream")
    stream = LifecycleStream(f"{root}/state", CONTENT)
    for number in range(len(CHECKS)):
        check = arriving_check(spark, folder, root, number)
        stream.run(spark, f"{root}/checks")
        if number == FAILING:
            stream.check(spark, check, number)
    return stream


def lifecycle_stream(spark, folder):
    return run_lifecycle_stream(spark, folder).records(spark)


def lifecycle_stream_events(spark, folder):
    events = run_lifecycle_stream(spark, folder).history(spark)
    changed = F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["field"], c["before"], c["after"])), ";")
    first = F.get_json_object("snapshot", "$.first_seen_at").alias("first_seen_at")
    return events.select("record_id", "source_id", "type", "occurred_at", changed.alias("changes"), first)


# ---- versions and their history ----

VERSIONED = "source_id string, record_id string, title string, benefit string, summary string"
EVENT = "record_id string, type string"


def published_versions(spark, folder):
    """The last two periods published as versions, each run repeated, and both read back with the run that listed a record first."""
    catalog = Publication(f"{run_dir(spark, 'published')}/catalog", VERSIONED, EVENT)
    for period, run in ((1, "first"), (2, "second")):
        rows = keep_last(period_rows(spark, folder, period), L.KEY, [F.col("event_id")]).select(*L.KEY, *CONTENT)
        events = rows.join(catalog.read(spark).select("record_id"), "record_id", "left_anti").select("record_id", F.lit("listed").alias("type"))
        # A run that was lost before its version had a name, the run again, and once more when it has one.
        catalog.append_history(events, run)
        catalog.publish(rows, run, events)
        catalog.publish(rows, run, events)
    told = lambda version: catalog.read(spark, version).withColumn("version", F.lit(version))
    runs = catalog.history(spark).select("record_id", F.col("run").alias("listed_by"))
    return told(1).unionByName(told(2)).join(runs, "record_id", "left")


# ---- audited lifecycles ----

#: What a collapse reads of the classified rows, beside their order.
CLASSIFIED = ["is_class", "pending", "filed", "terminated", "row_status", "docket_key", "DISP", "MDLDOCK", "TRCLACT", "ORIGIN"]
LIFE = "docket_key string, filed_at date, final_terminated_at date, pending boolean, lifecycle_days int, settled boolean, n_rows bigint"


def audited_lifecycles(spark, folder):
    """Three runs: a good one, one whose collapse loses rows, and one that leaves a docket without an end. Only the first is published."""
    lost = lambda rows, *how: S.collapse_dockets(rows.filter(~((F.col("row_status") == "valid") & (F.col("l_linenumber") == 2))), *how)
    endless = lambda rows, *how: S.collapse_dockets(rows, *how).withColumn("final_terminated_at", F.when(F.col("n_rows") > 1, F.col("final_terminated_at")))
    catalog = Publication(f"{run_dir(spark, 'audited')}/lives", LIFE)
    rows = S.classify_rows(S.class_rows(docket_survival.extract_rows(spark, folder)), docket_survival.SNAPSHOT)
    # The runs differ in their collapse alone, so the extract is joined, parsed and written once for them.
    staged = stage_rows(rows.select(*CLASSIFIED, *docket_survival.ORDER), catalog, "extract")
    outcomes = []
    for run, collapse in (("good", S.collapse_dockets), ("lossy", lost), ("endless", endless)):
        try:
            publish_staged(staged, catalog, run, docket_survival.ORDER, docket_survival.SNAPSHOT, collapse)
            broken = ""
        except Refused as refused:
            broken = ",".join(refused.broken)
        # What a reader gets after this run.
        lives = catalog.read(spark)
        outcomes.append(lives.agg(
            F.lit(run).alias("run"), F.lit(broken).alias("broken"), F.lit(catalog.latest(spark)).alias("version"), F.count(F.lit(1)).alias("dockets"),
            F.sum("n_rows").alias("rows"), F.sum("lifecycle_days").alias("days"),
        ))
    return C.unify(*outcomes)


# ---- run states ----

#: Runs in order: run id, and for each search it works on the period read, window, restart, failure and the page left.
RUNS = [
    ("r1", CHECKS[0], [("backfill", 0, "3y", False, False, "page-2")]),
    ("r2", CHECKS[1], [("backfill", 1, "3y", False, False, "page-3"), ("incremental", 1, "14d", False, True, None)]),
    ("r3", CHECKS[2], [("backfill", 2, "3y", False, False, None), ("incremental", 2, "14d", False, False, None)]),
    ("r4", "2024-02-11T00:00:00.000Z", [("incremental", 0, "14d", False, True, "page-9")]),
]


def attempts(spark, folder, run: str, at: str, searches: list) -> DataFrame:
    """One row for each search of a run, counted over the events of its period."""
    found = []
    for key, period, window, restart, failed, left in searches:
        rows = period_rows(spark, folder, period)
        fixed = {"state_key": key, "run_id": run, "checked_at": at, "window": window, "restart": restart, "failed": failed, "next_url": left}
        types = {"restart": "boolean", "failed": "boolean"}
        found.append(rows.agg(
            *[F.lit(v).cast(types.get(c, "string")).alias(c) for c, v in fixed.items()], F.ceil(F.count(F.lit(1)) / 100).alias("pages"),
            F.count(F.lit(1)).alias("raw_results"), F.count_if(F.col("source_id") != "error").alias("accepted_results"),
        ))
    return C.unify(*found)


def run_states(spark, folder):
    """The states after each of four runs, read back from the versions they published; the third run is done twice."""
    states = Publication(f"{run_dir(spark, 'run-states')}/states", R.STATE)
    for again, (run, at, searches) in enumerate([*RUNS[:3], *RUNS[2:]]):
        after = R.advance(states.read(spark), attempts(spark, folder, run, at, searches))
        # The repeated run publishes under a name of its own, so its states are computed anew from those it left itself.
        states.publish(after, f"{run}-{again}")
    shown = ["state_key", "status", "run_id", "run_status", "resumed", "next_url", *R.TOTALS.values(), "last_attempt_at", "last_completed_at", "last_successful_at"]
    return C.unify(*[states.read(spark, v).select(F.lit(v).alias("version"), *shown) for v in states.named(spark)])


def lifecycle_coverage(spark, folder):
    """Coverage after each check, with the times of the last success and the last complete check carried over."""
    stream = run_lifecycle_stream(spark, folder)
    return stream.coverage.deltas(spark).select(F.col("batch").alias("check_no"), *[c.split()[0] for c in COVERAGE.split(", ")])


def serving_coverage(spark, folder):
    """The agency sources of the last check beside the docket search, which is partial while it has raw results it did not accept."""
    sources = source_lifecycle.coverage_status(spark, folder).withColumn("checked_at", F.lit(source_lifecycle.CHECKED_AT))
    hits = period_rows(spark, folder, 2).agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("source_id") != "error").alias("record_count"))
    run = hits.select(
        F.lit("docket-search").alias("source_id"), F.when(F.col("raw") > F.col("record_count"), "partial").otherwise("complete").alias("status"),
        F.lit(CHECKS[2]).alias("checked_at"), "record_count", F.lit(None).cast("string").alias("error"),
    )
    return R.serving_coverage(sources, run)


def published_totals(spark, folder):
    layer = lambda name, df, kind, active, freshness: df.select(F.lit(name).alias("layer"), F.lit(kind).alias("kind"), active.alias("active"), freshness.alias("freshness"))
    current = F.lit("current")
    return C.published_totals(C.unify(
        layer("curated", catalog_browsing.curated(spark, folder), "settlement_claims_open", F.lit(True), current),
        layer("agency", catalog_browsing.agency(spark, folder), "government_redress", F.col("active"), F.col("freshness")),
        layer("docket", catalog_browsing.dockets(spark, folder).filter("active"), "potential_class_case", F.col("active"), F.col("freshness")),
    ))


QUERIES = {
    "lifecycle_stream": lifecycle_stream,
    "lifecycle_stream_events": lifecycle_stream_events,
    "lifecycle_coverage": lifecycle_coverage,
    "published_versions": published_versions,
    "audited_lifecycles": audited_lifecycles,
    "run_states": run_states,
    "serving_coverage": serving_coverage,
    "published_totals": published_totals,
}

# ---- the same in SQL ----

_ROWS = f"""
WITH rows_ AS (
  SELECT event_type AS source_id, event_type || '-' || user_id || '-' || (event_id % 20) AS record_id,
    'Program "' || user_id || '" ' || (event_id % 20) AS title, 'Tier ' || CAST(floor(value) % 2 AS BIGINT) AS benefit,
    'Summary ' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 2) AS summary, event_id, value,
    CASE WHEN ts < TIMESTAMP '{PERIODS[0][1]}' THEN 0 WHEN ts < TIMESTAMP '{PERIODS[1][1]}' THEN 1 ELSE 2 END AS period FROM events),
lasts AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY period, source_id, record_id ORDER BY event_id DESC) = 1)"""

_NOTHING = """
r_ AS (
  SELECT source_id, record_id, title, benefit, summary, true AS active, '' AS inactive, '' AS stale, '' AS first_, '' AS last_, '' AS moved, '' AS fresh, true AS listed,
    title AS e_title, benefit AS e_benefit, summary AS e_summary, true AS e_active, '' AS e_inactive, '' AS e_stale, '' AS e_first, '' AS e_moved, true AS told, '' AS transition, '' AS changes
  FROM lasts WHERE false)"""


def _check_sql(number: int, before: str) -> str:
    """CTEs of one check: s<n> sources, r<n> records and their last events."""
    now, parsed = CHECKS[number], f"source_id <> 'error' OR value > {PARSE_FLOOR}" if number == FAILING else "true"
    as_json = lambda v: f"coalesce(CAST(to_json({v}) AS VARCHAR), 'null')"
    pairs = [("active", "b_active", "true"), ("benefit", "b_benefit", "n_benefit"), ("inactive_reason", "b_inactive", "CAST(NULL AS VARCHAR)"),
             ("stale_reason", "b_stale", "CAST(NULL AS VARCHAR)"), ("summary", "b_summary", "n_summary"), ("title", "b_title", "n_title")]
    change = ", ".join(f"CASE WHEN {b} IS DISTINCT FROM {n} THEN '{f}:' || {as_json(b)} || ':' || {as_json(n)} END" for f, b, n in pairs)
    fields = ["title", "benefit", "summary"]
    base = ", ".join(f"CASE WHEN had THEN {f} ELSE e_{f} END AS b_{f}" for f in [*fields, "active", "inactive", "stale"])
    kept = ["title", "benefit", "summary", "active", "inactive", "stale"]
    return f"""
s{number} AS (
  SELECT source_id, source_id <> 'view' AS required, 1 AS minimum_records, count(*) AS raw_rows, count(*) FILTER (WHERE {parsed}) AS parsed_rows,
    CASE WHEN count(*) FILTER (WHERE {parsed}) < 1 THEN 'too few rows' WHEN count(*) FILTER (WHERE {parsed}) < 0.8 * count(*) THEN 'extraction was incomplete' END AS error
  FROM rows_ WHERE period = {number} GROUP BY source_id),
n{number} AS (SELECT l.source_id, record_id, {', '.join(f'{f} AS n_{f}' for f in fields)} FROM lasts l JOIN s{number} s ON s.source_id = l.source_id AND s.error IS NULL WHERE period = {number}),
j{number} AS (
  SELECT n.source_id AS n_source, n.record_id AS n_record, {', '.join(f'n_{f}' for f in fields)}, r.*, n.record_id IS NOT NULL AS is_new, coalesce(listed, false) AS had
  FROM n{number} n FULL JOIN {before} r ON n.source_id = r.source_id AND n.record_id = r.record_id),
b{number} AS (
  SELECT j.*, s.source_id IS NOT NULL AS checked_, s.error IS NOT NULL AS failed, had OR coalesce(told, false) AS has_base, {base},
    CASE WHEN had THEN first_ ELSE e_first END AS b_first, CASE WHEN had THEN moved ELSE e_moved END AS b_moved
  FROM j{number} j LEFT JOIN s{number} s ON s.source_id = coalesce(n_source, j.source_id)),
d{number} AS (
  SELECT *, is_new AND has_base AND (b_title <> n_title OR b_benefit <> n_benefit OR b_summary <> n_summary OR NOT b_active OR b_inactive IS NOT NULL OR b_stale IS NOT NULL) AS differs FROM b{number}),
l{number} AS (
  SELECT *, CASE WHEN is_new AND NOT has_base THEN 'discovered' WHEN is_new AND NOT had THEN 'reactivated' WHEN is_new AND differs THEN 'changed' WHEN is_new THEN 'unchanged'
    WHEN NOT had OR NOT checked_ THEN 'absent' WHEN failed THEN 'retained' ELSE 'deactivated' END AS label FROM d{number}),
f{number} AS (
  SELECT coalesce(n_source, source_id) AS source_id, coalesce(n_record, record_id) AS record_id, {', '.join(f'coalesce(n_{f}, {f}) AS {f}' for f in fields)},
    CASE WHEN is_new THEN true WHEN label = 'deactivated' THEN false ELSE active END AS active,
    CASE WHEN is_new THEN NULL WHEN label = 'deactivated' THEN 'removed_from_agency_source' ELSE inactive END AS inactive,
    CASE WHEN is_new THEN NULL WHEN label = 'retained' THEN 'source_check_failed' ELSE stale END AS stale,
    CASE WHEN is_new THEN coalesce(b_first, '{now}') ELSE first_ END AS first_, CASE WHEN is_new THEN '{now}' ELSE last_ END AS last_,
    CASE WHEN label IN ('discovered', 'deactivated') OR differs THEN '{now}' WHEN is_new THEN coalesce(b_moved, '{now}') ELSE moved END AS moved,
    CASE WHEN label = 'retained' THEN 'stale' WHEN label = 'absent' THEN fresh ELSE 'current' END AS fresh, label IN ('discovered', 'reactivated', 'changed', 'unchanged', 'retained') AS listed,
    {', '.join(f'e_{f}' for f in kept)}, e_first, e_moved, told, label,
    CASE WHEN label = 'changed' THEN array_to_string(list_filter([{change}], lambda c: c IS NOT NULL), ';') ELSE '' END AS changes FROM l{number}),
r{number} AS (
  SELECT source_id, record_id, title, benefit, summary, active, inactive, stale, first_, last_, moved, fresh, listed,
    {', '.join(f'CASE WHEN event_ THEN {f} ELSE e_{f} END AS e_{f}' for f in kept)}, CASE WHEN event_ THEN first_ ELSE e_first END AS e_first,
    CASE WHEN event_ THEN moved ELSE e_moved END AS e_moved, event_ OR coalesce(told, false) AS told, label AS transition, changes
  FROM (SELECT *, label IN ('discovered', 'changed', 'reactivated', 'deactivated') AS event_ FROM f{number}))"""


_CHECKED = ",".join([_ROWS, _NOTHING, _check_sql(0, "r_"), _check_sql(1, "r0"), _check_sql(2, "r1")])
_EVENTS = " UNION ALL ".join(
    f"SELECT record_id, source_id, transition AS type, '{CHECKS[n]}' AS occurred_at, changes, first_ AS first_seen_at FROM r{n} WHERE transition IN ('discovered', 'changed', 'reactivated', 'deactivated')"
    for n in range(3)
)


def _coverage_sql(number: int) -> str:
    """Coverage rows of one check, with the last success of each source and the last complete check before carried over."""
    before = f"(SELECT source_id, last_success_at FROM c{number - 1})" if number else "(SELECT '' AS source_id, '' AS last_success_at WHERE false)"
    carried = f"(SELECT max(last_complete_at) FROM c{number - 1})" if number else "CAST(NULL AS VARCHAR)"
    return f"""
k{number} AS (
  SELECT source_id, count(*) FILTER (WHERE transition = 'retained') AS stale_retention_count,
    count(*) FILTER (WHERE transition IN ('discovered', 'reactivated', 'changed', 'unchanged')) AS record_count FROM r{number} GROUP BY source_id),
t{number} AS (
  SELECT s.*, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, coalesce(stale_retention_count, 0) AS stale_retention_count, coalesce(record_count, 0) AS record_count,
    coalesce(record_count, 0) AS active_record_count, CASE WHEN error IS NULL THEN '{CHECKS[number]}' ELSE b.last_success_at END AS last_success_at
  FROM s{number} s LEFT JOIN k{number} USING (source_id) LEFT JOIN {before} b USING (source_id)),
o{number} AS (
  SELECT count(*) FILTER (WHERE required) AS required_source_count, count(*) FILTER (WHERE required AND error IS NULL) AS required_success_count,
    bool_and(NOT required OR error IS NULL) AS all_required_sources_succeeded, bool_or(error IS NULL OR stale_retention_count > 0) AS any_ FROM t{number}),
c{number} AS (
  SELECT {number} AS check_no, t.*, required_source_count, required_success_count, all_required_sources_succeeded,
    CASE WHEN all_required_sources_succeeded THEN 'complete' WHEN any_ THEN 'degraded' ELSE 'failed' END AS overall_status,
    CASE WHEN all_required_sources_succeeded THEN '{CHECKS[number]}' ELSE {carried} END AS last_complete_at FROM t{number} t, o{number})"""


def _state_sql(version: int, key: str, status: str, run: int, run_status: str, resumed: bool, left: str | None, periods: list[int], attempt: int, completed: int | None, success: int) -> str:
    """A state as the scenario of ``RUNS`` should leave it; totals over the periods read since the search began."""
    at = lambda i: "CAST(NULL AS VARCHAR)" if i is None else f"'{RUNS[i][1]}'"
    chosen = f"period IN ({', '.join(map(str, periods))})"
    return f"""SELECT {version} AS version, '{key}' AS state_key, '{status}' AS status, 'r{run}' AS run_id, '{run_status}' AS run_status, {str(resumed).lower()} AS resumed,
  {"CAST(NULL AS VARCHAR)" if left is None else f"'{left}'"} AS next_url, (SELECT CAST(sum(ceil(n / 100)) AS BIGINT) FROM (SELECT count(*) AS n FROM rows_ WHERE {chosen} GROUP BY period)) AS pages_fetched_total,
  (SELECT count(*) FROM rows_ WHERE {chosen}) AS raw_results_seen_total, (SELECT count(*) FROM rows_ WHERE {chosen} AND source_id <> 'error') AS accepted_results_total,
  {at(attempt)} AS last_attempt_at, {at(completed)} AS last_completed_at, {at(success)} AS last_successful_at"""


_THIRD = [("backfill", "complete", 3, "complete", True, None, [0, 1, 2], 2, 2, 2), ("incremental", "complete", 3, "complete", False, None, [2], 2, 2, 2)]
_STATES = [
    (1, "backfill", "in_progress", 1, "partial", False, "page-2", [0], 0, None, 0),
    (2, "backfill", "in_progress", 2, "partial", True, "page-3", [0, 1], 1, None, 1),
    (2, "incremental", "degraded", 2, "degraded", False, None, [1], 1, None, 1),
    *[(v, *state) for v in (3, 4) for state in _THIRD],
    (5, *_THIRD[0]), (5, "incremental", "in_progress", 4, "degraded", False, "page-9", [0], 3, 2, 3),
]

ORACLES = {
    "lifecycle_stream": f"""{_CHECKED}
SELECT source_id, record_id, transition, title, benefit, summary, active, inactive AS inactive_reason, stale AS stale_reason, first_ AS first_seen_at, last_ AS last_seen_at,
  moved AS last_changed_at, fresh AS freshness FROM r2 WHERE listed""",
    "lifecycle_stream_events": f"{_CHECKED}\n{_EVENTS}",
    "lifecycle_coverage": f"{_CHECKED}, {', '.join(_coverage_sql(n) for n in range(3))}\nSELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2",
    "published_versions": f"""{_ROWS}
SELECT l.source_id, l.record_id, l.title, l.benefit, l.summary, l.period AS version,
  CASE WHEN record_id IN (SELECT record_id FROM lasts WHERE period = 1) THEN 'first' ELSE 'second' END AS listed_by FROM lasts l WHERE period IN (1, 2)""",
    "audited_lifecycles": f"""
WITH lives AS ({docket_survival.ORACLES['docket_lifecycle']})
SELECT run, broken, 1 AS version, count(*) AS dockets, CAST(sum(n_rows) AS BIGINT) AS rows, CAST(sum(lifecycle_days) AS BIGINT) AS days
FROM lives, (VALUES ('good', ''), ('lossy', 'rows_reconcile'), ('endless', 'dockets_end')) r(run, broken) GROUP BY run, broken""",
    "run_states": _ROWS + "\n" + " UNION ALL ".join(_state_sql(*state) for state in _STATES),
    "serving_coverage": f"""
WITH agency AS ({source_lifecycle.ORACLES['coverage_status']}),
hits AS (SELECT count(*) AS raw, count(*) FILTER (WHERE event_type <> 'error') AS n FROM events WHERE ts >= TIMESTAMP '{PERIODS[2][0]}'),
sources AS (
  SELECT source_id, status, '{source_lifecycle.CHECKED_AT}' AS checked_at, record_count, error, 'agency' AS layer FROM agency
  UNION ALL SELECT 'docket-search', CASE WHEN raw > n THEN 'partial' ELSE 'ok' END, '{CHECKS[2]}', n, NULL, 'docket' FROM hits)
SELECT s.*, a AS all_required_sources_succeeded, CASE WHEN a THEN 'complete' WHEN b THEN 'degraded' ELSE 'failed' END AS overall_status
FROM sources s, (SELECT bool_and(status = 'ok') AS a, bool_or(status = 'ok') AS b FROM sources)""",
    "published_totals": """
WITH c AS (SELECT count(*) AS n FROM part), d AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'),
g AS (SELECT count(*) FILTER (WHERE s_suppkey % 10 <> 7) AS n, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS stale FROM supplier)
SELECT c.n + d.n + g.n AS record_count, c.n + d.n + g.n AS active_record_count, c.n AS open_claim_count, 0::BIGINT AS legal_intake_count,
  d.n AS potential_case_count, g.n AS government_redress_count, g.stale AS stale_count FROM c, d, g""",
}
