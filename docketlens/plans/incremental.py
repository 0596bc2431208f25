"""The streaming jobs over the tables, split into files by period; results equal their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.operators.survival import observations
from docketlens.plans import claim_ledger, docket_survival
from docketlens.plans.tables import day, pick, sql_pick, table, within
from docketlens.session import run_dir
from docketlens.streaming.activity_stream import ActivityStream
from docketlens.streaming.docket_stream import DocketStream
from docketlens.streaming.survival_stream import SurvivalStream

BOUNDS = [None, "2024-01-11", "2024-01-21", None]
STAMPS = ["2024-01-11T00:00:00Z", "2024-01-21T00:00:00Z", "2024-02-01T00:00:00Z"]
DESCRIPTIONS = ["Class Action Complaint", "Complaint (CLASS ACTION)", "Motion to dismiss", "Amended complaint for class action relief"]


def hit_pages(spark, folder, period: int):
    """The events of a period as search-hit pages."""
    k = F.get_json_object("props", "$.k").cast("int")
    event, ended = F.col("event_id"), F.col("event_type") == "purchase"
    none = F.lit(None).cast("string")
    document = F.struct(
        (event % 3).alias("id"), (k % 2).cast("bigint").alias("docket_entry_id"), (event % 3).cast("int").alias("document_number"),
        F.date_format("ts", "yyyy-MM-dd").alias("entry_date_filed"), pick(event % len(DESCRIPTIONS), DESCRIPTIONS).alias("description"),
        none.alias("document_type"), F.lit(True).alias("is_available"), none.alias("absolute_url"),
    )
    hit = F.struct(
        (F.col("user_id") * 40 + event % 40 + 1).alias("docket_id"), F.concat(F.lit("Matter "), F.col("user_id")).alias("caseName"),
        none.alias("docketNumber"), none.alias("court"), none.alias("court_id"), F.lit("2023-12-01").alias("dateFiled"),
        F.when(ended, F.date_format("ts", "yyyy-MM-dd")).alias("dateTerminated"),
        F.when(F.col("event_type").isin("click", "view"), "Browsing").otherwise("Other").alias("cause"), none.alias("suitNature"),
        none.alias("docket_absolute_url"), F.array(document).alias("recap_documents"),
    )
    rows = table(spark, folder, "events").filter(within(F.col("ts"), *BOUNDS[period:period + 2]))
    return rows.select(
        "event_id", F.lit(1).cast("bigint").alias("count"), none.alias("next"), none.alias("previous"), F.array(hit).alias("results")
    )


def run_docket_stream(spark, folder, degraded_period: int | None = 2) -> DocketStream:
    """Three periods arriving one after the other; the last run is degraded."""
    root = run_dir(spark, "docket-stream")
    stream = DocketStream(f"{root}/state")
    for period in range(3):
        pages = hit_pages(spark, folder, period)
        # Files in range order keep the hits of a period in event order.
        pages.repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id").write.json(f"{root}/pages/p{period}")
        # Each call processes the files of its period, in however many batches they come.
        stream.run(
            spark, f"{root}/pages/*", lambda _batch, at=STAMPS[period]: at, lambda _batch, bad=period == degraded_period: bad, max_files=100_000
        )
    return stream


def docket_stream(spark, folder):
    return run_docket_stream(spark, folder).current(spark).select(
        "docket_id", "case_name", day(F.col("date_terminated")).alias("date_terminated"), "active", "cause", "first_seen_at", "last_seen_at", "freshness"
    )


def docket_stream_totals(spark, folder):
    return run_docket_stream(spark, folder).totals(spark)


def survival_stream(spark, folder):
    root = run_dir(spark, "survival-stream")
    observed = observations(docket_survival.members(spark, folder))
    observed.write.parquet(f"{root}/observed")
    stream = SurvivalStream(f"{root}/state")
    stream.run(spark, f"{root}/observed", max_files=4)
    return stream.buckets(spark)


def activity_stream(spark, folder):
    root = run_dir(spark, "activity-stream")
    versions = claim_ledger.versions(spark, folder)
    versions.write.parquet(f"{root}/all")
    written = spark.read.parquet(f"{root}/all")
    stream = ActivityStream(f"{root}/state")
    for period in range(3):
        written.filter(within(F.col("at"), *BOUNDS[period:period + 2])).write.parquet(f"{root}/versions/p{period}")
        stream.run(spark, f"{root}/versions/*", max_files=100_000)
    return claim_ledger.shown(stream.events(spark))


QUERIES = {
    "docket_stream": docket_stream,
    "docket_stream_totals": docket_stream_totals,
    "survival_stream": survival_stream,
    "activity_stream": activity_stream,
}

_HITS = f"""
WITH hits AS (
  SELECT *, user_id * 40 + event_id % 40 + 1 AS docket_id, CASE WHEN ts < TIMESTAMP '{BOUNDS[1]}' THEN 0 WHEN ts < TIMESTAMP '{BOUNDS[2]}' THEN 1 ELSE 2 END AS run,
    CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d') END AS ended, CASE WHEN event_type IN ('click', 'view') THEN 'Browsing' ELSE 'Other' END AS cause
  FROM events WHERE event_id % 4 <> 2)"""

ORACLES = {
    "docket_stream": _HITS + f""",
batches AS (
  SELECT docket_id, run, any_value(user_id) AS user_id, arg_max(ended, event_id) FILTER (WHERE ended IS NOT NULL) AS ended, arg_max(event_type <> 'purchase', event_id) AS active, arg_max(cause, event_id) AS cause
  FROM hits GROUP BY docket_id, run),
folded AS (
  SELECT *, last_value(ended IGNORE NULLS) OVER (PARTITION BY docket_id ORDER BY run) AS kept, first_value(run) OVER (PARTITION BY docket_id ORDER BY run) AS first_run,
    row_number() OVER (PARTITION BY docket_id ORDER BY run DESC) AS back FROM batches)
SELECT docket_id, 'Matter ' || user_id AS case_name, kept AS date_terminated, CASE WHEN ended IS NULL AND kept IS NOT NULL THEN false ELSE active END AS active, cause,
  {sql_pick('first_run', STAMPS)} AS first_seen_at, {sql_pick('run', STAMPS)} AS last_seen_at, CASE WHEN run < 2 THEN 'stale' ELSE 'current' END AS freshness FROM folded WHERE back = 1""",
    "docket_stream_totals": _HITS + """
SELECT CAST(3 AS BIGINT) AS runs, (SELECT count(*) FROM events) AS raw_results_seen_total, (SELECT count(*) FROM hits) AS accepted_results_total""",
    "survival_stream": docket_survival.ORACLES["survival_buckets"],
    "activity_stream": claim_ledger.ORACLES["claim_activity"],
}
