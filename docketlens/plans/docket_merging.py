"""Docket hits and merges over ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.operators import dockets as D
from docketlens.operators.keyed import global_position
from docketlens.plans.tables import day, pick, sql_pick, table
from docketlens.session import run_dir, written_once
from docketlens.sources.search_hits import read_hits

SPLIT = "2024-01-16"
BEFORE, AFTER = "2024-01-15T00:00:00Z", "2024-01-31T00:00:00Z"


def event_records(spark, folder, later: bool):
    """Docket records from one half of ``events``; a purchase reports a termination."""
    events = table(spark, folder, "events")
    half = F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz") if later else F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k").cast("int")
    ended = F.col("event_type") == "purchase"
    docket = F.col("user_id") * 40 + F.col("event_id") % 40 + 1
    seen = F.lit(AFTER if later else BEFORE)
    filing = F.struct(
        (F.col("event_id") % 3).cast("string").alias("document_id"),
        (k % 2).cast("string").alias("docket_entry_id"),
        (F.col("event_id") % 3).cast("int").alias("document_number"),
        F.lit("2024-01-01").alias("entry_date_filed"),
        F.lit("Class Action Complaint").alias("description"),
        F.lit(None).cast("string").alias("document_type"),
        (F.col("value") > 100).alias("available_in_recap"),
        F.concat(F.lit(D.ORIGIN + "/docket/"), docket, F.lit("/")).alias("url"),
    )
    none = F.lit(None).cast("string")
    return events.filter(half).select(
        docket.alias("docket_id"),
        F.concat(F.lit("Matter "), F.col("user_id")).alias("case_name"),
        F.concat(F.lit("No. "), F.col("user_id")).alias("docket_number"),
        F.concat(F.lit(D.ORIGIN + "/docket/"), docket, F.lit("/")).alias("docket_url"),
        none.alias("court"),
        F.concat(F.lit("court"), F.col("user_id") % 5).alias("court_id"),
        F.lit("2024-01-01").cast("date").alias("date_filed"),
        F.when(ended, F.col("ts").cast("date")).alias("date_terminated"),
        F.when(ended, "terminated_date_reported").otherwise("termination_not_reported").alias("termination_state"),
        (~ended).alias("active"),
        F.when(ended, D.TERMINATED_CAVEAT).otherwise(D.NOT_TERMINATED_CAVEAT).alias("active_status_caveat"),
        F.when(F.col("event_type").isin("click", "view"), "Browsing").otherwise("Other").alias("cause"),
        none.alias("suit_nature"),
        F.array(filing).alias("matched_filings"),
        seen.alias("first_seen_at"), seen.alias("last_seen_at"), seen.alias("last_changed_at"),
        F.lit("current").alias("freshness"),
        F.col("event_id").alias("hit_order"),
    )


def merged(spark, folder, degraded=True):
    before, after = event_records(spark, folder, False), event_records(spark, folder, True)
    return D.merge_dockets(
        D.dedupe_dockets(before), D.filings_of(before),
        D.dedupe_dockets(after), D.filings_of(after), AFTER, degraded=degraded,
    )


def docket_merge(spark, folder):
    records, _ = merged(spark, folder)
    return records.select(
        "docket_id", "case_name", "court_id", day(F.col("date_filed")).alias("date_filed"),
        day(F.col("date_terminated")).alias("date_terminated"), "termination_state", "active",
        "active_status_caveat", "cause", "first_seen_at", "last_seen_at", "last_changed_at", "freshness",
    ).transform(lambda rows: global_position(rows, D.docket_order()))


def docket_filings(spark, folder):
    _, filings = merged(spark, folder)
    return filings.select(*D.FILING_KEY, "document_number", "available_in_recap", "url")


def retained_count(spark, folder):
    records, _ = merged(spark, folder)
    return D.retained_count(records, D.dedupe_dockets(event_records(spark, folder, True)))


def docket_recomputed_active(spark, folder):
    """In-batch dedupe with the active state derived from the kept termination date."""
    records = D.dedupe_dockets(event_records(spark, folder, True), recompute_active=True)
    return records.select("docket_id", day(F.col("date_terminated")).alias("date_terminated"), "active", "termination_state")


# Descriptions put before each document text, so that every branch of the classifier occurs.
DESCRIPTIONS = [
    "Class Action Complaint.",
    "COMPLAINT of two tenants against a landlord (CLASS ACTION), with # 1 Lease",
    "Complaint over rent; a class of tenants is named elsewhere.",
    "Third Amended Complaint for wages, collective and class action;",
    "Motion to dismiss.",
    "Second amended complaint - class and collective claims.",
    "Complaint (Attachments: # 1 class action notice)",
    "Answer to class and collective  action complaint.",
    "Reclass action complaints.",
    "Third  Complaint about fees,",
    "Notice of removal.",
]
DATES = ["2024-02-29", "2023-02-29", "2024-01-15", "01/15/2024", "", None, "2022-12-31"]
URLS = ["/docket/77/x/", "https://www.courtlistener.com/docket/5/y/", "https://evil.example.com/docket/1/", "", None]


def hit_pages(spark, folder):
    """One page with one nested hit for each document."""
    documents = table(spark, folder, "documents")
    text, doc = F.col("text"), F.col("doc_id")

    def filing(i):
        return F.struct(
            F.when(doc % 9 != i, doc * 10 + F.lit(i) % 2).alias("id"),
            (doc * 10 + F.lit(i) % 2).alias("docket_entry_id"),
            F.when(doc % 5 != i, F.lit(12 - 5 * i)).cast("int").alias("document_number"),
            pick((doc + i) % len(DATES), DATES).alias("entry_date_filed"),
            F.concat_ws(" ", pick((doc * 3 + i * 4) % len(DESCRIPTIONS), DESCRIPTIONS), text).alias("description"),
            F.col("lang").alias("document_type"),
            (doc % 2 == i).alias("is_available"),
            pick((doc + i) % len(URLS), URLS).alias("absolute_url"),
        )

    hit = F.struct(
        F.when(doc % 11 == 0, -doc).otherwise(doc * 2 + 1).alias("docket_id"),
        F.concat(F.lit("  "), F.substring_index(text, "\n", 1)).alias("caseName"),
        F.when(doc % 4 != 0, F.concat(F.lit(" 1:24-cv-"), doc)).alias("docketNumber"),
        F.col("source").alias("court"),
        F.lit("nysd").alias("court_id"),
        pick((doc + 1) % len(DATES), DATES).alias("dateFiled"),
        pick((doc + 4) % len(DATES), DATES).alias("dateTerminated"),
        F.lit("28:1332").alias("cause"),
        F.lit(None).cast("string").alias("suitNature"),
        pick(doc % len(URLS), URLS).alias("docket_absolute_url"),
        F.array(*[filing(i) for i in range(3)]).alias("recap_documents"),
    )
    return documents.select(
        F.lit(1).cast("bigint").alias("count"), F.lit(None).cast("string").alias("next"),
        F.lit(None).cast("string").alias("previous"), F.array(hit).alias("results"),
    )


def docket_hits(spark, folder):
    """Documents written as search-hit JSON, read back with the explicit schema and normalized."""
    path = run_dir(spark, "search-hits")
    hit_pages(spark, folder).write.json(path)
    records = D.normalize_hits(read_hits(spark, path), AFTER)
    filing = lambda f: F.concat_ws(
        "/", F.coalesce(f["document_id"], F.lit("-")), F.coalesce(f["docket_entry_id"], F.lit("-")),
        F.coalesce(f["document_number"].cast("string"), F.lit("-")), F.coalesce(f["entry_date_filed"], F.lit("-")),
        f["available_in_recap"].cast("string"), f["url"],
    )
    return records.select(
        "docket_id", "case_name", "docket_number", "docket_url", "court",
        day(F.col("date_filed")).alias("date_filed"), day(F.col("date_terminated")).alias("date_terminated"),
        "termination_state", "active", F.size("matched_filings").cast("bigint").alias("n_filings"),
        F.array_join(F.transform("matched_filings", filing), " ").alias("filings"),
    )


def hit_metrics(spark, folder):
    """Raw and accepted counts of the run, carried on from an earlier run over the same pages."""
    path = run_dir(spark, "search-hits")
    hit_pages(spark, folder).write.json(path)
    hits = read_hits(spark, path)
    accepted = written_once(D.normalize_hits(hits, AFTER).select("docket_id"), "accepted-hits")
    return D.run_metrics(hits, accepted, D.run_metrics(hits, accepted))


QUERIES = {
    "docket_merge": docket_merge,
    "docket_filings": docket_filings,
    "retained_count": retained_count,
    "docket_recomputed_active": docket_recomputed_active,
    "docket_hits": docket_hits,
    "hit_metrics": hit_metrics,
}

# ---- the same in SQL ----

_EVENTS = f"""
WITH recs AS (
  SELECT *, user_id * 40 + event_id % 40 + 1 AS docket_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    event_type = 'purchase' AS ended, CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END AS date_terminated,
    CASE WHEN event_type IN ('click', 'view') THEN 'Browsing' ELSE 'Other' END AS cause,
    ts >= TIMESTAMP '{SPLIT}' AS later FROM events),
deduped AS (
  SELECT docket_id, later, any_value(user_id) AS user_id, arg_max(date_terminated, event_id) FILTER (WHERE date_terminated IS NOT NULL) AS date_terminated,
    arg_max(ended, event_id) AS ended, arg_max(cause, event_id) AS cause FROM recs GROUP BY docket_id, later),
filed AS (
  SELECT docket_id, later, CAST(event_id % 3 AS VARCHAR) AS document_id, CAST(k % 2 AS VARCHAR) AS docket_entry_id,
    arg_min(CAST(event_id % 3 AS INTEGER), event_id) AS document_number, arg_min(value > 100, event_id) AS available_in_recap
  FROM recs GROUP BY ALL),
same_filings AS (
  SELECT docket_id, bool_and(both_sides) AS same FROM (
    SELECT docket_id, document_id, docket_entry_id, document_number, available_in_recap, count(*) = 2 AS both_sides
    FROM filed GROUP BY ALL) GROUP BY docket_id),
o AS (SELECT * FROM deduped WHERE NOT later), n AS (SELECT * FROM deduped WHERE later),
sided AS (
  SELECT coalesce(o.docket_id, n.docket_id) AS docket_id, coalesce(o.user_id, n.user_id) AS user_id,
    o.docket_id IS NOT NULL AS known, n.docket_id IS NOT NULL AS seen,
    o.date_terminated IS NOT NULL AND n.date_terminated IS NULL AND n.docket_id IS NOT NULL AS keep_end,
    o.date_terminated AS o_end, n.date_terminated AS n_end, o.ended AS o_ended, n.ended AS n_ended, o.cause AS o_cause, n.cause AS n_cause
  FROM o FULL JOIN n ON o.docket_id = n.docket_id),
merged AS (
  SELECT s.*, CASE WHEN NOT seen OR keep_end THEN o_end ELSE n_end END AS m_end,
    CASE WHEN NOT seen OR keep_end THEN o_ended ELSE n_ended END AS m_ended,
    CASE WHEN NOT seen THEN NOT o_ended WHEN keep_end THEN false ELSE NOT n_ended END AS m_active,
    CASE WHEN seen THEN n_cause ELSE o_cause END AS m_cause, same FROM sided s LEFT JOIN same_filings USING (docket_id))"""
_STATE = "CASE WHEN {0} THEN 'terminated_date_reported' ELSE 'termination_not_reported' END"

_DOCS = f"""
WITH raw AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN -doc_id ELSE doc_id * 2 + 1 END AS docket_id, text, source,
    {sql_pick(f'(doc_id + 1) % {len(DATES)}', DATES)} AS filed, {sql_pick(f'(doc_id + 4) % {len(DATES)}', DATES)} AS ended,
    {sql_pick(f'doc_id % {len(URLS)}', URLS)} AS docket_path FROM documents),
docs AS (
  SELECT doc_id, docket_id, i, CASE WHEN doc_id % 9 <> i THEN doc_id * 10 + i % 2 END AS id, doc_id * 10 + i % 2 AS entry,
    CASE WHEN doc_id % 5 <> i THEN 12 - 5 * i END AS number, {sql_pick(f'(doc_id + i) % {len(DATES)}', DATES)} AS entered,
    trim(regexp_replace({sql_pick(f'(doc_id * 3 + i * 4) % {len(DESCRIPTIONS)}', DESCRIPTIONS)} || ' ' || text,
      '[\\s\\x0b\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g')) AS description,
    doc_id % 2 = i AS available, {sql_pick(f'(doc_id + i) % {len(URLS)}', URLS)} AS path
  FROM raw, (SELECT unnest([0, 1, 2]) AS i)),
headed AS (
  SELECT *, substr(regexp_extract(description, '(?is)^(.*?)(\\(?\\battachments?\\s*:|$)', 1), 1, 600) AS header FROM docs),
kept AS (
  SELECT * FROM headed WHERE docket_id > 0 AND (
    regexp_matches(description, '\\bclass\\s+action\\s+complaint\\b', 'i')
    OR regexp_matches(description, '\\bclass\\s+and\\s+collective\\s+action\\s+complaint\\b', 'i')
    OR regexp_matches(description, '\\bamended\\s+class\\s+action\\s+complaint\\b', 'i')
    OR (regexp_matches(header, '^(?:(?:first|second|third|fourth)\\s+)?(?:amended\\s+)?complaint\\b', 'i') AND (
      regexp_matches(header, '\\bclass\\s+action\\b', 'i') OR regexp_matches(header, '\\bclass\\s+and\\s+collective\\b', 'i')
      OR regexp_matches(header, '\\bcollective\\s+and(?:\\s+r\\.?\\s*23)?\\s+class\\s+action\\b', 'i'))))),
firsts AS (
  SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, id, entry ORDER BY i) = 1),
shown AS (
  SELECT *, CASE WHEN regexp_full_match(entered, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_cast(entered AS DATE) AS VARCHAR) END AS day,
    CASE WHEN path LIKE '/%' THEN 'https://www.courtlistener.com' || path WHEN path LIKE 'https://www.courtlistener.com/%' THEN path
      ELSE 'https://www.courtlistener.com/docket/' || docket_id || '/' END AS url FROM firsts),
joined AS (
  SELECT doc_id, count(*) AS n_filings, string_agg(coalesce(CAST(id AS VARCHAR), '-') || '/' || entry || '/' || coalesce(CAST(number AS VARCHAR), '-')
    || '/' || coalesce(day, '-') || '/' || available || '/' || url, ' '
    ORDER BY coalesce(day, ''), coalesce(CAST(number AS VARCHAR), ''), coalesce(CAST(id AS VARCHAR), '')) AS filings FROM shown GROUP BY doc_id)"""
_ISO = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_cast({0} AS DATE) AS VARCHAR) END"

ORACLES = {
    "docket_merge": _EVENTS + f"""
SELECT docket_id, 'Matter ' || user_id AS case_name, 'court' || (user_id % 5) AS court_id, '2024-01-01' AS date_filed,
  strftime(m_end, '%Y-%m-%d') AS date_terminated, {_STATE.format('m_ended')} AS termination_state, m_active AS active,
  CASE WHEN m_ended THEN '{D.TERMINATED_CAVEAT}' ELSE '{D.NOT_TERMINATED_CAVEAT}' END AS active_status_caveat, m_cause AS cause,
  CASE WHEN known THEN '{BEFORE}' ELSE '{AFTER}' END AS first_seen_at, CASE WHEN seen THEN '{AFTER}' ELSE '{BEFORE}' END AS last_seen_at,
  CASE WHEN NOT known THEN '{AFTER}' WHEN NOT seen THEN '{BEFORE}'
    WHEN m_end IS DISTINCT FROM o_end OR m_ended <> o_ended OR m_active = o_ended OR m_cause <> o_cause OR NOT same THEN '{AFTER}'
    ELSE '{BEFORE}' END AS last_changed_at,
  CASE WHEN seen THEN 'current' ELSE 'stale' END AS freshness, row_number() OVER (ORDER BY docket_id) AS position FROM merged""",
    "docket_filings": _EVENTS + f"""
SELECT docket_id, document_id, docket_entry_id, document_number, available_in_recap, '{D.ORIGIN}/docket/' || docket_id || '/' AS url
FROM filed WHERE later OR docket_id NOT IN (SELECT docket_id FROM n)""",
    "retained_count": _EVENTS + "\nSELECT count(*) AS retained_from_previous FROM merged WHERE NOT seen",
    "docket_recomputed_active": _EVENTS + f"""
SELECT docket_id, strftime(date_terminated, '%Y-%m-%d') AS date_terminated, date_terminated IS NULL AS active,
  {_STATE.format('date_terminated IS NOT NULL')} AS termination_state FROM n""",
    "docket_hits": _DOCS + f"""
SELECT docket_id, coalesce(nullif(trim(regexp_replace(split_part(text, chr(10), 1), '[\\s\\x0b\\x{{00a0}}]+', ' ', 'g')), ''), 'Unnamed federal matter') AS case_name,
  CASE WHEN doc_id % 4 <> 0 THEN '1:24-cv-' || doc_id END AS docket_number,
  CASE WHEN docket_path LIKE '/%' THEN 'https://www.courtlistener.com' || docket_path WHEN docket_path LIKE 'https://www.courtlistener.com/%' THEN docket_path
    ELSE 'https://www.courtlistener.com/docket/' || docket_id || '/' END AS docket_url, source AS court,
  {_ISO.format('filed')} AS date_filed, {_ISO.format('ended')} AS date_terminated,
  {_STATE.format(f"({_ISO.format('ended')}) IS NOT NULL")} AS termination_state, ({_ISO.format('ended')}) IS NULL AS active,
  n_filings, filings FROM raw JOIN joined USING (doc_id)""",
    "hit_metrics": _DOCS + """
SELECT (SELECT count(*) FROM raw) AS raw_results_seen, (SELECT count(*) FROM joined) AS accepted_results,
  2 * (SELECT count(*) FROM raw) AS raw_results_seen_total, 2 * (SELECT count(*) FROM joined) AS accepted_results_total""",
}
