"""State of repeated runs: what each run came to, and what it carries over from the runs before.

States are one row for each state key (such as a backfill and an incremental search), attempts one row for each key a run works on. A run
that is repeated is computed from what the run before it left, which its state row carries, so repeating it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTALS = {"pages": "pages_fetched_total", "raw_results": "raw_results_seen_total", "accepted_results": "accepted_results_total"}
ATTEMPT = (
    "state_key string, run_id string, checked_at string, window string, restart boolean, failed boolean, next_url string, "
    "pages bigint, raw_results bigint, accepted_results bigint"
)
_CARRIED = ["status", "window", "next_url", *TOTALS.values(), "last_completed_at", "last_successful_at"]
_CARRIED_TYPES = {c: "bigint" if c in TOTALS.values() else "string" for c in _CARRIED}
_STRUCT = ", ".join(f"{c}: {t}" for c, t in _CARRIED_TYPES.items())
STATE = (
    f"state_key string, {', '.join(f'{c} {t}' for c, t in _CARRIED_TYPES.items())}, run_id string, run_status string, resumed boolean, "
    f"last_attempt_at string, base struct<{_STRUCT}>"
)


def advance(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """``STATE`` after one run of ``attempts`` (``ATTEMPT``, a row for each key); keys without an attempt stay as they are.

    A search that was left in progress is resumed, and its totals go on, unless a restart is asked for or the window has changed. A run
    with pages left is partial and its state in progress; a failed one is degraded; only one that is neither is complete and moves the
    time of the last completion. Pages read at all move the time of the last success.
    """
    old = states.select("state_key", F.struct(*[c for c in states.columns if c != "state_key"]).alias("o"))
    joined = old.join(attempts.select("state_key", F.struct(*[c for c in attempts.columns if c != "state_key"]).alias("n")), "state_key", "full_outer")
    n = lambda c: F.col(f"n.{c}")
    repeated = F.col("o.run_id").eqNullSafe(n("run_id"))
    now_held = F.struct(*[F.col(f"o.{c}").alias(c) for c in _CARRIED])
    joined = joined.withColumn("base", F.when(repeated, F.col("o.base")).when(F.col("o").isNotNull(), now_held))
    base = lambda c: F.col(f"base.{c}")
    resumes = (base("status") == "in_progress") & base("next_url").isNotNull() & ~n("restart") & base("window").eqNullSafe(n("window"))
    resumed = F.coalesce(resumes, F.lit(False))
    left, failed = n("next_url").isNotNull(), n("failed")
    total = lambda count, name: F.when(resumed, F.coalesce(base(name), F.lit(0))).otherwise(F.lit(0)) + n(count)
    after: dict[str, Column] = {
        "status": F.when(left, "in_progress").when(failed, "degraded").otherwise("complete"),
        "window": n("window"), "next_url": n("next_url"), **{name: total(count, name) for count, name in TOTALS.items()},
        "last_completed_at": F.when(~failed & ~left, n("checked_at")).otherwise(base("last_completed_at")),
        "last_successful_at": F.when(n("pages") > 0, n("checked_at")).otherwise(base("last_successful_at")),
        "run_id": n("run_id"), "run_status": F.when(failed, "degraded").when(left, "partial").otherwise("complete"),
        "resumed": resumed, "last_attempt_at": n("checked_at"), "base": F.col("base"),
    }
    kept = F.col("n").isNull()
    return joined.select("state_key", *[F.when(kept, F.col(f"o.{c}")).otherwise(value).alias(c) for c, value in after.items()])


def with_last_complete(coverage: DataFrame, previous: DataFrame, checked_at: str) -> DataFrame:
    """``coverage`` with ``last_complete_at``: the time of this check if it is complete, else of the last one that was.

    ``previous`` is a coverage of one run before, or empty; every row of a coverage tells the same time.
    """
    # One text of the run before.
    before = previous.agg(F.max("last_complete_at")).first()[0]
    complete = F.col("overall_status") == "complete"
    return coverage.withColumn("last_complete_at", F.when(complete, F.lit(checked_at)).otherwise(F.lit(before).cast("string")))


def serving_coverage(agency_sources: DataFrame, docket_runs: DataFrame) -> DataFrame:
    """Sources of both layers with one overall status beside each: complete if all are ok, degraded if some are, else failed.

    ``agency_sources`` and ``docket_runs`` have (source_id, status, checked_at, record_count, error); a docket run that is complete
    counts as ok, a partial one as partial, any other as failed.
    """
    columns = ["source_id", "status", "checked_at", "record_count", "error"]
    status = F.when(F.col("status") == "complete", "ok").when(F.col("status") == "partial", "partial").otherwise("failed")
    dockets = docket_runs.select(*columns).withColumns({"status": status, "layer": F.lit("docket")})
    sources = agency_sources.select(*columns).withColumn("layer", F.lit("agency")).unionByName(dockets)
    ok = F.col("status") == "ok"
    # A source is a configured one, so all of them fit one row.
    whole = sources.agg(
        F.collect_list(F.struct(*sources.columns)).alias("sources"), F.bool_and(ok).alias("all_required_sources_succeeded"), F.bool_or(ok).alias("any_ok")
    )
    overall = F.when(F.col("all_required_sources_succeeded"), "complete").when(F.col("any_ok"), "degraded").otherwise("failed")
    return whole.withColumn("overall_status", overall).select(F.inline("sources"), "all_required_sources_succeeded", "overall_status")
