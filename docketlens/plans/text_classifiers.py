"""Text, date and message classifiers over ``documents``, ``conversations``, ``part`` and ``lineitem``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docketlens.functions import dates as D
from docketlens.functions import finder as N
from docketlens.functions import wording as W
from docketlens.functions.text import short_hash, slugify, stable_bucket
from docketlens.operators.keyed import computed_once
from docketlens.operators.sessions import message_preferences as parsed_messages
from docketlens.operators.sessions import session_keywords as keywords_of
from docketlens.operators.sessions import session_preferences as preferences_of
from docketlens.plans.page_listings import sql_clean, sql_slug
from docketlens.plans.tables import day, pick, sql_list, sql_pick, table
from docketlens.session import written_once

AS_OF = "1999-01-01"

# Appended to the texts, so that every branch of a classifier occurs.
CAUSES = [
    "Fair Labor Standards Act overtime wage", "data breach of patient records", "hospital billing", "bank loan interest",
    "auto dealership", "automatic car wash", "wireless text message", "nothing special", "copyright", "truth-in-lending fraud",
    "civil rights act: employment", "tracking pixel", "Carpet sale",
]
WORDINGS = [
    "No action needed.", "You will automatically receive a check", "You do not need to file a form", "Only investors invited may respond",
    "If you received an invitation, reply. We are accepting claims", "no longer accepting forms", "the claim  period closed", "claim window is open",
    "Submit claim by June", "yes, always", "No receipts", "November", "agency invitation; no action is needed", "",
]
INTENTS = [
    "Please list open claims that I may file today", "A letter told me of a data breach at my clinic in West  Virginia", "We paid two phone companies in WA in 2021 and 2022",
    "Any claims where no documents are needed?", "My landlord did not receive a notice after the breach", "watch the lawsuit docket in New York",
    "official refund from the FTC, my bank in TX", "every catalog about hospital jobs 1999", "I have an invoice and my e-mail is a.b@example.com",
    "my SSN is 123-45-6789", "call me at (212) 555-0100", "card 4111 1111 1111 1111", "claim number A7", "id 123456 applied", "the password",
    "I live at 12 Main Street", "my diagnosis is private", "I live in Kansas, not arkansas; XX OK", "",
]


def slug_names(spark, folder):
    parts = table(spark, folder, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    docs = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), F.col("text").alias("value"))
    return parts.unionByName(docs).select("kind", "key", slugify(F.col("value")).alias("slug"), short_hash(F.col("value")).alias("hash16"))


def stable_buckets(spark, folder):
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    docs = table(spark, folder, "documents").select((-F.col("doc_id") - 1).alias("key"), F.concat_ws("/", "source", "lang", "doc_id").alias("name"))
    return names.unionByName(docs).select("key", stable_bucket(F.col("name")).alias("bucket"))


def category_inference(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id"), F.col("text"), pick(F.col("doc_id") % len(CAUSES), CAUSES).alias("cause"),
        pick((F.col("doc_id") * 5 + 1) % len(CAUSES), CAUSES).alias("suit"),
    )
    return docs.select(
        "doc_id", W.settlement_category(F.col("cause"), F.col("text")).alias("settlement_category"),
        W.docket_category(F.col("cause"), F.when(F.col("doc_id") % 2 == 0, F.col("suit"))).alias("docket_category"),
    )


def wording_modes(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat_ws(" ", pick(F.col("doc_id") % len(WORDINGS), WORDINGS), "text").alias("wording")
    )
    return computed_once(docs, mode=W.participation_mode(F.col("wording"))).select(
        "doc_id", "mode", W.window_status(F.col("wording"), F.col("mode")).alias("window_status"),
        W.proof_answer(F.col("wording")).alias("proof"),
    )


def dollar_amounts(spark, folder):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity").cast("int")
    text = F.concat(
        F.lit("Pays $"), F.format_number(price, 2), F.lit(" now, $ "), quantity, F.lit(" later, $"), F.format_number(price, 2),
        F.lit(" again and $"), quantity, F.lit(".5 or $x"),
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = computed_once(lines, a=W.dollar_amounts(text))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform("a", lambda x: x["raw"]), ";").alias("raw"),
        F.round(F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["value"]), 2).alias("total"),
    )


def sensitive_screen(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text"))
        .otherwise(F.concat_ws(" ", "text", pick(F.col("doc_id") % len(INTENTS), INTENTS))).alias("text"),
    )
    return docs.select("doc_id", N.sensitive_reason(F.col("text")).alias("reason"))


def messages(spark, folder):
    """User turns; two of three carry one of the intents."""
    talk = table(spark, folder, "conversations")
    at = (F.col("conv_id") * 7 + F.col("turn") * 3) % len(INTENTS)
    return talk.select(
        "conv_id", "turn", "role",
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("text")).otherwise(F.concat_ws(" ", "text", pick(at, INTENTS))).alias("text"),
    )


def message_preferences(spark, folder):
    parsed = parsed_messages(messages(spark, folder))
    return parsed.select(
        "conv_id", "turn", "goal", F.array_join("experiences", ",").alias("experiences"), F.array_join("keywords", " ").alias("keywords"),
        "location", "proof", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), "sensitive",
    )


def session_preferences(spark, folder):
    said = messages(spark, folder).filter("role = 'user'")
    parsed = written_once(parsed_messages(said).drop("text"), "parsed-messages")
    return preferences_of(parsed, "conv_id", "turn").withColumn("experiences", F.array_join("experiences", ","))


def session_keywords(spark, folder):
    said = messages(spark, folder).filter("role = 'user'")
    parsed = written_once(parsed_messages(said).drop("text"), "parsed-messages")
    return keywords_of(parsed, "conv_id", "turn")


def strict_dates(spark, folder):
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    month = F.date_format(date, "MMMM")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", date.alias("d"),
        F.when(key % 13 == 0, "02/31/2020").when(key % 13 == 1, "-8").when(key % 13 == 2, "2/1/2020").when(key % 13 == 3, F.date_format(date, "yyyy-MM-dd"))
        .when(key % 13 == 4, "0050-01-01").when(key % 13 == 5, "  ").otherwise(F.concat(F.lit(" "), F.date_format(date, "MM/dd/yyyy"))).alias("extract_text"),
        F.when(key % 7 == 0, "13/1/99").when(key % 7 == 1, "2/29/1999").when(key % 7 == 2, F.date_format(date, "M/d/yyyy"))
        .when(key % 7 == 3, "1/2/345").otherwise(F.date_format(date, "M/d/yy")).alias("claim_text"),
        F.when(key % 5 == 0, "2024-02-30").when(key % 5 == 1, "2024-2-03").otherwise(F.date_format(date, "yyyy-MM-dd")).alias("iso_text"),
        F.when(key % 4 == 0, F.concat(month, F.lit(" 24"))).when(key % 4 == 1, F.upper(F.concat_ws("  ", month, F.date_format(date, "yyyy"))))
        .otherwise(F.concat_ws(" ", month, F.date_format(date, "yyyy"))).alias("month_text"),
    )
    return orders.select(
        "o_orderkey", day(D.extract_date(F.col("extract_text"))).alias("extract_date"), day(D.claim_date(F.col("claim_text"))).alias("claim_date"),
        day(D.iso_date(F.col("iso_text"))).alias("iso_date"), D.month_date(F.col("month_text")).alias("month_date"),
        day(D.window_start(F.col("d"), years=3)).alias("backfill_start"), day(D.window_start(F.col("d"), days=14)).alias("incremental_start"),
        D.days_to_months(D.days_between(F.col("d"), F.lit("2002-01-01").cast("date"))).alias("months"),
    )


def deadline_status(spark, folder):
    as_of = F.lit(dt.date.fromisoformat(AS_OF))
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    raw = F.when(key % 11 == 0, "soon").when(key % 11 == 1, " ").otherwise(F.date_format(date, "M/d/yy"))
    orders = computed_once(table(spark, folder, "orders").select("o_orderkey", date.alias("d"), raw.alias("text")), deadline=D.claim_deadline(F.col("text"), as_of))
    days = D.days_until(F.col("deadline.date"), as_of)
    return orders.select(
        "o_orderkey", F.col("deadline.raw").alias("raw"), day(F.col("deadline.date")).alias("date"), F.col("deadline.status").alias("status"),
        days.alias("days_left"), D.urgency_band(days).alias("band"), D.elapsed_months(F.col("d"), as_of).alias("elapsed_months"),
    )


QUERIES = {
    "slug_names": slug_names,
    "stable_bucket": stable_buckets,
    "category_inference": category_inference,
    "wording_modes": wording_modes,
    "dollar_amounts": dollar_amounts,
    "sensitive_screen": sensitive_screen,
    "message_preferences": message_preferences,
    "session_preferences": session_preferences,
    "session_keywords": session_keywords,
    "strict_dates": strict_dates,
    "deadline_status": deadline_status,
}

# ---- the same in SQL, with the patterns as the reference's own engine reads them ----


def _sql_first(text: str, rules, otherwise: str) -> str:
    plain = lambda p: p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")
    whens = " ".join(f"WHEN regexp_matches({text}, '{plain(p)}') THEN '{label}'" for label, p in rules)
    return f"CASE {whens} ELSE {otherwise} END"


_SENSITIVE = r"""CASE
  WHEN regexp_matches(text, '\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b', 'i') THEN 'email address'
  WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') OR regexp_matches(text, 'social security|\bssn\b', 'i') THEN 'Social Security information'
  WHEN regexp_matches(text, '(?:\+?1[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b') THEN 'phone number'
  WHEN regexp_matches(text, '\b(?:\d[ -]*?){13,19}\b') THEN 'payment-card-like number'
  WHEN regexp_matches(text, '\b(?:claim|notice|confirmation|account|routing|tax)\s*(?:number|no\.?|id)\b', 'i') THEN 'private identifier'
  WHEN regexp_matches(text, '\b\d{5,12}\b') THEN 'private number'
  WHEN regexp_matches(text, '\b(?:password|passcode|bank credentials?)\b', 'i') THEN 'account credential'
  WHEN regexp_matches(text, '\b\d{1,6}\s+[a-z0-9 .''-]{2,40}\s(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr)\b', 'i') THEN 'street address'
  WHEN regexp_matches(text, '\b(?:my diagnosis|medical record|patient id|information about my child|minor''s information)\b', 'i') THEN 'sensitive personal detail'
  END"""
_IGNORED = sql_list([*N.STOP_WORDS, *N.GENERIC_WORDS])
_CODES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.STATES.items()) + "}"
_STATES = "[" + ", ".join(f"'{s}'" for s in N.STATE_NAMES) + "]"
_MESSAGES = f"""
WITH talk AS (
  SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 3 = 0 THEN text
    ELSE text || ' ' || {sql_pick(f'(conv_id * 7 + turn * 3) % {len(INTENTS)}', INTENTS)} END AS text FROM conversations),
tokens AS (
  SELECT *, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '),
    lambda t: length(t) >= 2 AND t NOT IN {_IGNORED}) AS all_tokens FROM talk),
parsed AS (
  SELECT conv_id, turn, role, {_sql_first('lower(text)', N.GOALS, 'NULL')} AS goal,
    list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{n}' END" for n, p in N.ISSUES)}], lambda x: x IS NOT NULL) AS experiences,
    list_filter(all_tokens, lambda t, i: list_position(all_tokens, t) = i) AS keywords,
    coalesce(list_filter({_STATES}, lambda s: regexp_matches(lower(text), '\\b' || replace(s, ' ', '\\s+') || '\\b'))[1],
      {_CODES}[list_filter(regexp_extract_all(text, '\\b[A-Z]{{2}}\\b'), lambda c: list_contains(map_keys({_CODES}), c))[1]], '') AS location,
    CASE WHEN regexp_matches(text, 'no (?:receipt|receipts|proof|document|documents)|without (?:proof|receipts|documents)', 'i') THEN 'No documents stated'
      WHEN NOT regexp_matches(text, '\\b(?:no|never|did not|didn''t)\\s+(?:receive\\w*\\s+)?(?:a\\s+)?notice\\b', 'i')
        AND regexp_matches(text, 'notice|claim id|notice id|confirmation', 'i') THEN 'Notice or ID'
      WHEN regexp_matches(text, 'receipt|record|invoice|statement', 'i') THEN 'Records may be requested' END AS proof,
    regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b') AS all_years, {_SENSITIVE} AS sensitive FROM tokens)"""
_SESSIONS = _MESSAGES + """,
kept AS (SELECT * FROM parsed WHERE role = 'user' AND sensitive IS NULL)"""
_IDENT = r"""(CASE WHEN regexp_full_match({0}, '\d{{1,2}}/\d{{1,2}}/(\d{{2}}|\d{{4}})') THEN
  try_cast((CASE WHEN CAST(split_part({0}, '/', 3) AS INTEGER) < 70 THEN CAST(split_part({0}, '/', 3) AS INTEGER) + 2000
    WHEN CAST(split_part({0}, '/', 3) AS INTEGER) < 100 THEN CAST(split_part({0}, '/', 3) AS INTEGER) + 1900 ELSE CAST(split_part({0}, '/', 3) AS INTEGER) END)
    || '-' || lpad(split_part({0}, '/', 1), 2, '0') || '-' || lpad(split_part({0}, '/', 2), 2, '0') AS DATE) END)"""

ORACLES = {
    "slug_names": f"""
SELECT 'part' AS kind, p_partkey AS key, {sql_slug('p_name')} AS slug, substr(sha256(p_name), 1, 16) AS hash16 FROM part
UNION ALL SELECT 'document', doc_id, {sql_slug('text')}, substr(sha256(text), 1, 16) FROM documents""",
    "stable_bucket": """
SELECT key, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda a, b: (a * 31 + b) & 4294967295) % 5 AS INTEGER) AS bucket
FROM (SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT -doc_id - 1, source || '/' || lang || '/' || doc_id FROM documents)""",
    "category_inference": f"""
SELECT doc_id, {_sql_first('hay', W.SETTLEMENT_CATEGORIES, "'Consumer'")} AS settlement_category,
  {_sql_first('suit', W.DOCKET_CATEGORIES, "'Federal court cases'")} AS docket_category FROM (
  SELECT doc_id, lower({sql_clean("cause || ' ' || text")}) AS hay, lower(cause || ' ' || CASE WHEN doc_id % 2 = 0 THEN suit ELSE '' END) AS suit FROM (
    SELECT doc_id, text, {sql_pick(f'doc_id % {len(CAUSES)}', CAUSES)} AS cause, {sql_pick(f'(doc_id * 5 + 1) % {len(CAUSES)}', CAUSES)} AS suit FROM documents))""",
    "wording_modes": f"""
SELECT doc_id, mode, coalesce({_sql_first('w', W.WINDOW_STATUSES, 'NULL')}, CASE WHEN mode = 'automatic_distribution' THEN 'not_applicable' ELSE 'unknown' END) AS window_status,
  CASE WHEN regexp_matches(w, '^yes\\b') THEN 'yes' WHEN regexp_matches(w, '^no\\b') THEN 'no' ELSE 'unknown' END AS proof FROM (
  SELECT doc_id, w, {_sql_first('w', W.PARTICIPATION_MODES, "'unknown'")} AS mode FROM (
    SELECT doc_id, lower({sql_clean(sql_pick(f'doc_id % {len(WORDINGS)}', WORDINGS) + " || ' ' || text")}) AS w FROM documents))""",
    "dollar_amounts": r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(raws, ';') AS raw,
  round(list_sum(list_transform(raws, lambda r: CAST(replace(replace(r, '$', ''), ',', '') AS DOUBLE))), 2) AS total FROM (
  SELECT *, list_filter(found, lambda a, i: list_position(found, a) = i) AS raws FROM (
    SELECT *, list_transform(regexp_extract_all(text, '\$\s*[0-9][0-9,]*(?:\.\d{1,2})?'), lambda a: replace(a, ' ', '')) AS found FROM (
      SELECT *, 'Pays $' || format('{:,.2f}', l_extendedprice) || ' now, $ ' || CAST(l_quantity AS INTEGER) || ' later, $' || format('{:,.2f}', l_extendedprice)
        || ' again and $' || CAST(l_quantity AS INTEGER) || '.5 or $x' AS text FROM lineitem)))""",
    "sensitive_screen": f"""
SELECT doc_id, {_SENSITIVE} AS reason FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' ' || {sql_pick(f'doc_id % {len(INTENTS)}', INTENTS)} END AS text FROM documents)""",
    "message_preferences": _MESSAGES + """
SELECT conv_id, turn, goal, coalesce(array_to_string(experiences, ','), '') AS experiences, coalesce(array_to_string(keywords, ' '), '') AS keywords, location, proof,
  coalesce(array_to_string(list_filter(all_years, lambda y, i: list_position(all_years, y) = i), ','), '') AS years, sensitive FROM parsed""",
    "session_preferences": _SESSIONS + f""",
issues AS (
  SELECT conv_id, string_agg(issue, ',' ORDER BY turn, list_position([{', '.join(f"'{n}'" for n, _ in N.ISSUES)}], issue)) AS experiences FROM (
    SELECT conv_id, issue, min(turn) AS turn FROM (SELECT conv_id, turn, unnest(experiences) AS issue FROM kept) GROUP BY conv_id, issue) GROUP BY conv_id)
SELECT conv_id, coalesce(arg_max(goal, turn) FILTER (WHERE goal IS NOT NULL), 'open_claims') AS goal, count(goal) > 0 AS goal_explicit,
  coalesce(any_value(issues.experiences), '') AS experiences, coalesce(arg_max(location, turn) FILTER (WHERE location <> ''), '') AS location,
  coalesce(arg_max(proof, turn) FILTER (WHERE proof IS NOT NULL), 'Any') AS proof FROM kept LEFT JOIN issues USING (conv_id) GROUP BY conv_id""",
    "session_keywords": _SESSIONS + """,
first_seen AS (
  SELECT conv_id, token, min((turn, i)) AS first_ FROM (SELECT conv_id, turn, unnest(keywords) AS token, generate_subscripts(keywords, 1) AS i FROM kept) GROUP BY ALL)
SELECT conv_id, token, row_number() OVER (PARTITION BY conv_id ORDER BY first_) AS position FROM first_seen""",
    "strict_dates": f"""
SELECT o_orderkey, strftime(CASE WHEN regexp_full_match(e, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN CAST(try_strptime(e, '%m/%d/%Y') AS DATE)
    WHEN regexp_full_match(e, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND e >= '0100' THEN try_cast(e AS DATE) END, '%Y-%m-%d') AS extract_date,
  strftime({_IDENT.format('c')}, '%Y-%m-%d') AS claim_date, CASE WHEN regexp_full_match(i, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN strftime(try_cast(i AS DATE), '%Y-%m-%d') END AS iso_date,
  CASE WHEN o_orderkey % 4 <> 0 THEN strftime(d, '%Y-%m') END AS month_date, strftime(CAST(d - INTERVAL 3 YEAR AS DATE), '%Y-%m-%d') AS backfill_start,
  strftime(CAST(d - INTERVAL 14 DAY AS DATE), '%Y-%m-%d') AS incremental_start, round((DATE '2002-01-01' - d) / 30.436875, 1) AS months FROM (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
    trim(CASE o_orderkey % 13 WHEN 0 THEN '02/31/2020' WHEN 1 THEN '-8' WHEN 2 THEN '2/1/2020' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN '0050-01-01'
      WHEN 5 THEN '  ' ELSE strftime(o_orderdate, '%m/%d/%Y') END) AS e,
    CASE o_orderkey % 7 WHEN 0 THEN '13/1/99' WHEN 1 THEN '2/29/1999' WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 3 THEN '1/2/345' ELSE strftime(o_orderdate, '%-m/%-d/%y') END AS c,
    CASE o_orderkey % 5 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-2-03' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS i FROM orders)""",
    "deadline_status": f"""
SELECT o_orderkey, raw, strftime(date_, '%Y-%m-%d') AS date, CASE WHEN raw IS NULL THEN NULL WHEN date_ IS NULL THEN 'unknown' WHEN date_ < DATE '{AS_OF}' THEN 'past' ELSE 'upcoming' END AS status,
  CAST(date_ - DATE '{AS_OF}' AS INTEGER) AS days_left, CASE WHEN date_ IS NULL THEN 'none' WHEN date_ < DATE '{AS_OF}' THEN 'passed' WHEN date_ = DATE '{AS_OF}' THEN 'today'
    WHEN date_ - DATE '{AS_OF}' <= 14 THEN 'closing_soon' WHEN date_ - DATE '{AS_OF}' <= 21 THEN 'urgent' ELSE 'later' END AS band,
  CAST((1999 - year(d)) * 12 + 1 - month(d) - CASE WHEN 1 < day(d) THEN 1 ELSE 0 END AS INTEGER) AS elapsed_months FROM (
  SELECT *, {_IDENT.format('raw')} AS date_ FROM (
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 11 WHEN 0 THEN 'soon' WHEN 1 THEN NULL ELSE strftime(o_orderdate, '%-m/%-d/%y') END AS raw FROM orders))""",
}
