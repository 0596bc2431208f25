"""Docket survival over ``lineitem`` and ``orders`` shaped as a court extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.operators import survival as S
from docketlens.plans.tables import day, table
from docketlens.session import run_dir
from docketlens.sources.court_extract import ROW_ORDER, read_court_extract, write_court_extract

SNAPSHOT = "2001-06-30"
# lineitem keys repeat, so every value column takes part in the row order.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
GROUPS = ["cohort", "clock"]


def cohorts():
    return S.cohort_definitions(include_certified=True)


def extract_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw extract rows, all strings, with the ``ORDER`` columns kept beside them."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    pending = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
    by_tape = F.col("l_suppkey") % 3 == 0
    filed = F.date_add(F.col("o_orderdate").cast("date"), F.col("l_linenumber"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") % 11).cast("string").alias("CIRCUIT"),
        F.lpad((F.col("l_orderkey") % 7).cast("string"), 2, "0").alias("DISTRICT"),
        F.lit("1").alias("OFFICE"),
        F.col("l_orderkey").cast("string").alias("DOCKET"),
        F.col("l_linenumber").cast("string").alias("ORIGIN"),
        F.when(F.col("l_suppkey") % 50 == 0, "02/31/2020")
        .when(F.col("l_partkey") % 2 == 0, F.date_format(filed, "yyyy-MM-dd"))
        .otherwise(F.date_format(filed, "MM/dd/yyyy")).alias("FILEDATE"),
        F.lit("1").alias("JURIS"),
        F.lit("190").alias("NOS"),
        F.when(F.col("l_quantity") >= 10, "1").otherwise("-8").alias("CLASSACT"),
        F.when(F.col("l_partkey") % 10 == 0, "1234").when(F.col("l_partkey") % 10 == 1, "").otherwise("-8").alias("MDLDOCK"),
        F.when(pending, "01/01/1900")
        .when(F.col("l_partkey") % 194 == 0, "")
        .when(F.col("l_partkey") % 97 == 0, "-8")
        .when(F.col("l_partkey") % 101 == 0, "13/45/2000")
        .otherwise(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("TERMDATE"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "3").otherwise("-8").alias("TRCLACT"),
        F.when(F.col("l_partkey") % 23 == 0, "")
        .when(F.col("l_returnflag") == "A", "13")
        .when(F.col("l_returnflag") == "R", "6")
        .otherwise("12").alias("DISP"),
        F.when(pending & ~by_tape, "S").otherwise("L").alias("STATUSCD"),
        F.when(pending & by_tape, "2099").otherwise("2001").alias("TAPEYEAR"),
        *ORDER,
    )


def classified(spark, folder):
    return S.classify_rows(extract_rows(spark, folder), SNAPSHOT)


def lifecycles(spark, folder):
    return S.collapse_dockets(S.classify_rows(S.class_rows(extract_rows(spark, folder)), SNAPSHOT), ORDER, SNAPSHOT)


def members(spark, folder):
    return S.with_cohorts(lifecycles(spark, folder), cohorts())


def curve(spark, folder):
    return S.survival_curve(S.survival_buckets(S.observations(members(spark, folder)), GROUPS), GROUPS)


def quantiles(spark, folder):
    return S.complete_cohorts(S.survival_quantiles(curve(spark, folder), GROUPS), cohorts())


def row_accounting(spark, folder):
    return S.row_accounting(classified(spark, folder))


def court_extract_accounting(spark, folder):
    """The accounting again, over the extract written out and scanned back as tab-delimited text."""
    path = run_dir(spark, "court-extract")
    write_court_extract(extract_rows(spark, folder), path)
    return S.row_accounting(S.classify_rows(read_court_extract(spark, path), SNAPSHOT))


def court_extract_lifecycle(spark, folder):
    """Lifecycles from the scanned text; dispositions follow file order, so ties are left out."""
    path = run_dir(spark, "court-extract")
    write_court_extract(extract_rows(spark, folder), path)
    rows = S.classify_rows(read_court_extract(spark, path), SNAPSHOT)
    return S.collapse_dockets(rows, ROW_ORDER, SNAPSHOT).select(
        "docket_key", "lifecycle_days", "settlement_days", "settled", "pending", "n_rows"
    )


def docket_lifecycle(spark, folder):
    return lifecycles(spark, folder).select(
        "docket_key", day(F.col("filed_at")).alias("filed_at"),
        day(F.col("final_terminated_at")).alias("final_terminated_at"), "final_disposition",
        day(F.col("first_settlement_at")).alias("first_settlement_at"), "pending", "trclact_granted",
        "is_mdl_transfer_origin", "mdl_docket_present", "n_rows", "lifecycle_days", "settlement_days", "settled",
    )


def cohort_counts(spark, folder):
    return S.cohort_counts(members(spark, folder))


def disposition_histogram(spark, folder):
    return S.disposition_histogram(members(spark, folder))


def survival_buckets(spark, folder):
    return S.survival_buckets(S.observations(members(spark, folder)), GROUPS)


def censor_reasons(spark, folder):
    return S.censor_reasons(S.observations(members(spark, folder)))


def survival_curve(spark, folder):
    return curve(spark, folder).select(
        *GROUPS, "days", "events", "censored", "at_risk", F.round("survival", 6).alias("survival")
    )


def serving_quantiles(spark, folder):
    return S.serving_quantiles(
        quantiles(spark, folder), SNAPSHOT, source_provider="court extract", default_population="CLASSACT=1"
    )


QUERIES = {
    "row_accounting": row_accounting,
    "court_extract_accounting": court_extract_accounting,
    "court_extract_lifecycle": court_extract_lifecycle,
    "docket_lifecycle": docket_lifecycle,
    "cohort_counts": cohort_counts,
    "disposition_histogram": disposition_histogram,
    "survival_buckets": survival_buckets,
    "censor_reasons": censor_reasons,
    "survival_curve": survival_curve,
    "survival_quantiles": quantiles,
    "serving_quantiles": serving_quantiles,
}

# ---- the same in SQL ----

_PENDING = "(l_linestatus = 'O' AND l_returnflag = 'N')"
_DATE = """CASE WHEN regexp_full_match({0}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN CAST(try_strptime({0}, '%m/%d/%Y') AS DATE)
        WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime({0}, '%Y-%m-%d') AS DATE) END"""
_ROWS = f"""
WITH raw AS (
  SELECT *, (l_orderkey % 11) || ':' || lpad(CAST(l_orderkey % 7 AS VARCHAR), 2, '0') || ':1:' || l_orderkey AS docket_key,
    l_quantity >= 10 AS is_class, {_PENDING} AS pending,
    CASE WHEN l_suppkey % 50 = 0 THEN '02/31/2020'
      WHEN l_partkey % 2 = 0 THEN strftime(CAST(o_orderdate AS DATE) + l_linenumber, '%Y-%m-%d')
      ELSE strftime(CAST(o_orderdate AS DATE) + l_linenumber, '%m/%d/%Y') END AS filedate,
    CASE WHEN {_PENDING} THEN '01/01/1900' WHEN l_partkey % 194 = 0 THEN '' WHEN l_partkey % 97 = 0 THEN '-8'
      WHEN l_partkey % 101 = 0 THEN '13/45/2000' ELSE strftime(l_shipdate, '%m/%d/%Y') END AS termdate,
    CASE WHEN l_partkey % 23 = 0 THEN 'missing' WHEN l_returnflag = 'A' THEN '13' WHEN l_returnflag = 'R' THEN '6' ELSE '12' END AS disp,
    l_returnflag = 'A' AND l_linestatus = 'F' AS granted, l_linenumber IN (6, 13) AS mdl, l_partkey % 10 = 0 AS mdldock
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dated AS (
  SELECT *, {_DATE.format('filedate')} AS filed,
    CASE WHEN NOT pending THEN {_DATE.format('termdate')} END AS terminated FROM raw),
rows_ AS (
  SELECT *, CASE WHEN NOT is_class THEN 'not_class' WHEN filed IS NULL THEN 'invalid_filing_date'
    WHEN NOT pending AND terminated IS NULL AND termdate NOT IN ('', '-8') THEN 'invalid_termination_date'
    WHEN NOT pending AND terminated IS NULL THEN 'ambiguous_endpoint'
    WHEN (CASE WHEN pending THEN DATE '{SNAPSHOT}' ELSE terminated END) < filed
      OR (CASE WHEN pending THEN DATE '{SNAPSHOT}' ELSE terminated END) > DATE '{SNAPSHOT}' THEN 'negative_or_post_snapshot'
    ELSE 'valid' END AS row_status FROM dated)"""
_LIVES = _ROWS + f""",
grouped AS (
  SELECT docket_key, min(filed) AS filed_at, max(terminated) AS final_terminated_at,
    arg_min(disp, (DATE '{SNAPSHOT}' - terminated, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax))
      FILTER (WHERE terminated IS NOT NULL) AS final_disposition,
    min(terminated) FILTER (WHERE disp = '13') AS first_settlement_at,
    bool_or(pending) AS pending, bool_or(granted) AS trclact_granted, bool_or(mdl) AS is_mdl_transfer_origin,
    bool_or(mdldock) AS mdl_docket_present, count(*) AS n_rows
  FROM rows_ WHERE row_status = 'valid' GROUP BY docket_key),
lives AS (
  SELECT *, CAST((CASE WHEN pending THEN DATE '{SNAPSHOT}' ELSE final_terminated_at END) - filed_at AS INTEGER) AS lifecycle_days,
    CAST(coalesce(first_settlement_at, CASE WHEN pending THEN DATE '{SNAPSHOT}' ELSE final_terminated_at END) - filed_at AS INTEGER) AS settlement_days,
    first_settlement_at IS NOT NULL AS settled FROM grouped)"""
_MEMBERS = _LIVES + """,
members AS (
  SELECT *, 'class_alleged_all_origins' AS cohort FROM lives
  UNION ALL SELECT *, 'class_alleged_excluding_mdl_transfer_origins' FROM lives WHERE NOT is_mdl_transfer_origin
  UNION ALL SELECT *, 'class_alleged_mdl_transfer_origins' FROM lives WHERE is_mdl_transfer_origin
  UNION ALL SELECT *, 'class_certification_granted_all_origins' FROM lives WHERE trclact_granted
  UNION ALL SELECT *, 'class_certification_granted_excluding_mdl_transfer_origins' FROM lives WHERE trclact_granted AND NOT is_mdl_transfer_origin)"""
_OBSERVED = _MEMBERS + """,
observed AS (
  SELECT cohort, 'lifecycle' AS clock, lifecycle_days AS days, NOT pending AS event,
    CASE WHEN pending THEN 'pending_at_snapshot' END AS reason FROM members
  UNION ALL
  SELECT cohort, 'settlement', settlement_days, settled,
    CASE WHEN settled THEN NULL WHEN pending THEN 'pending_at_snapshot' ELSE 'other_termination_disposition' END FROM members),
buckets AS (
  SELECT cohort, clock, days, count(*) FILTER (WHERE event) AS events, count(*) FILTER (WHERE NOT event) AS censored
  FROM observed GROUP BY ALL)"""
_CURVE = _OBSERVED + """,
risk AS (
  SELECT *, CAST(sum(events + censored) OVER (PARTITION BY cohort, clock ORDER BY days
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk FROM buckets),
curve AS (
  SELECT *, list_reduce(list(1 - events / at_risk) OVER (PARTITION BY cohort, clock ORDER BY days
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, b: a * b) AS survival FROM risk)"""
_QUANTILES = _CURVE + """,
summary AS (
  SELECT cohort, clock, CAST(sum(events + censored) AS BIGINT) AS n, CAST(sum(events) AS BIGINT) AS events,
    CAST(sum(censored) AS BIGINT) AS censored,
    min(days) FILTER (WHERE events > 0 AND survival <= 0.75 + 2.220446049250313e-16) AS p25_days,
    min(days) FILTER (WHERE events > 0 AND survival <= 0.5 + 2.220446049250313e-16) AS median_days,
    min(days) FILTER (WHERE events > 0 AND survival <= 0.25 + 2.220446049250313e-16) AS p75_days,
    max(days) FILTER (WHERE events > 0) AS last_event_days, max(days) AS last_observed_days,
    round(arg_max(survival, days), 6) AS survival_at_end
  FROM curve GROUP BY cohort, clock),
quantiles AS (
  SELECT *, round(p25_days / 30.436875, 1) AS p25_months, round(median_days / 30.436875, 1) AS median_months,
    round(p75_days / 30.436875, 1) AS p75_months FROM summary)"""
_ACCOUNTING = _ROWS + """
SELECT rows_read, class_rows, explicit_pending_rows, sentinel_rows, invalid_filing_date_rows, invalid_termination_date_rows,
  ambiguous_endpoint_rows, negative_or_post_snapshot_rows, dockets, pending_dockets, valid_rows - dockets AS repeated_rows_collapsed,
  CAST(0 AS BIGINT) AS unreconciled_rows
FROM (SELECT count(*) AS rows_read, count(*) FILTER (WHERE is_class) AS class_rows,
  count(*) FILTER (WHERE is_class AND pending) AS explicit_pending_rows,
  count(*) FILTER (WHERE is_class AND pending) AS sentinel_rows,
  count(*) FILTER (WHERE row_status = 'invalid_filing_date') AS invalid_filing_date_rows,
  count(*) FILTER (WHERE row_status = 'invalid_termination_date') AS invalid_termination_date_rows,
  count(*) FILTER (WHERE row_status = 'ambiguous_endpoint') AS ambiguous_endpoint_rows,
  count(*) FILTER (WHERE row_status = 'negative_or_post_snapshot') AS negative_or_post_snapshot_rows,
  count(*) FILTER (WHERE row_status = 'valid') AS valid_rows,
  count(DISTINCT docket_key) FILTER (WHERE row_status = 'valid') AS dockets,
  count(DISTINCT docket_key) FILTER (WHERE row_status = 'valid' AND pending) AS pending_dockets FROM rows_)"""

ORACLES = {
    "row_accounting": _ACCOUNTING,
    "court_extract_accounting": _ACCOUNTING,
    "court_extract_lifecycle": _LIVES + """
SELECT docket_key, lifecycle_days, settlement_days, settled, pending, n_rows FROM lives""",
    "docket_lifecycle": _LIVES + """
SELECT docket_key, strftime(filed_at, '%Y-%m-%d') AS filed_at, strftime(final_terminated_at, '%Y-%m-%d') AS final_terminated_at,
  final_disposition, strftime(first_settlement_at, '%Y-%m-%d') AS first_settlement_at, pending, trclact_granted,
  is_mdl_transfer_origin, mdl_docket_present, n_rows, lifecycle_days, settlement_days, settled FROM lives""",
    "cohort_counts": _MEMBERS + """
SELECT cohort, count(*) AS included, count(*) FILTER (WHERE NOT pending) AS terminated,
  count(*) FILTER (WHERE pending) AS pending_at_snapshot, count(*) FILTER (WHERE mdl_docket_present) AS mdl_docket_present
FROM members GROUP BY cohort""",
    "disposition_histogram": _MEMBERS + """
SELECT cohort, coalesce(final_disposition, 'missing') AS disposition, count(*) AS dockets
FROM members WHERE NOT pending GROUP BY ALL""",
    "survival_buckets": _OBSERVED + "\nSELECT * FROM buckets",
    "censor_reasons": _OBSERVED + """
SELECT cohort, clock, reason, count(*) AS dockets FROM observed WHERE NOT event GROUP BY ALL""",
    "survival_curve": _CURVE + """
SELECT cohort, clock, days, events, censored, at_risk, round(survival, 6) AS survival FROM curve""",
    "survival_quantiles": _QUANTILES + "\nSELECT * FROM quantiles",
    "serving_quantiles": _QUANTILES + f"""
SELECT cohort, clock, n, p25_months, median_months, p75_months, '{SNAPSHOT}' AS snapshot_date,
  'CLASSACT=1' AS default_population, 'court extract' AS source_provider
FROM quantiles WHERE cohort = '{S.DEFAULT_COHORT}'""",
}
