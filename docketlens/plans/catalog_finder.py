"""The finder over the unified catalog: reviewed cases, agency records and dockets in one ranking and one screener."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.operators import catalog as C
from docketlens.operators import matcher as M
from docketlens.operators.keyed import keep_last
from docketlens.plans import catalog_browsing, finder_matching
from docketlens.plans.catalog_browsing import _CATALOG
from docketlens.plans.finder_matching import _CASES, _PEOPLE, _norm, _sql_ranked

AS_OF = finder_matching.AS_OF.replace(" ", "T") + "Z"


def criteria(spark, folder):
    """What reviewers noted about the cases they have reviewed."""
    reviewed = finder_matching.catalog(spark, folder).filter("has_criteria")
    return reviewed.select(F.regexp_replace("case_id", "^case-", "part-").alias("id"), *C.CRITERIA_COLUMNS)


def cases(spark, folder):
    return C.finder_cases(catalog_browsing.catalog(spark, folder), criteria(spark, folder))


def sessions(spark, folder):
    """The finder's sessions; most name a party, an agency or words of every docket as well."""
    key = F.col("session_id")
    named = (
        F.when(key % 5 == 0, F.concat(F.lit("doe "), key * 7 % 1500 + 1))
        .when(key % 5 == 1, "ftc program")
        .when(key % 5 == 2, F.concat(F.lit("supplier "), F.lpad((key % 100 + 1).cast("string"), 9, "0")))
        .when(key % 5 == 3, "proposed doe")
    )
    return finder_matching.sessions(spark, folder).withColumn("keywords", F.concat_ws(" ", "keywords", named))


def catalog_matches(spark, folder):
    """The best three cases of the whole catalog for each session, explained."""
    made = finder_matching.ready(cases(spark, folder), sessions(spark, folder))
    return M.explain_matches(M.rank_cases(made, finder_matching.TOP), made).select(
        "session_id", "rank", "case_id", "score", "kind", "signal", F.array_join("reasons", " / ").alias("reasons"), F.array_join("questions", " / ").alias("questions")
    )


def catalog_screened(spark, folder):
    """Answers of customers about the catalog's open reviewed cases."""
    as_part = lambda rows: rows.withColumn("case_id", F.regexp_replace("case_id", "^case-", "part-"))
    orders = finder_matching.order_answers(spark, folder)
    answers = keep_last(as_part(orders), ["session_id", "case_id"], [F.col("o_orderkey")]).drop("o_orderkey", "o_orderpriority")
    screened = M.screen_claims(
        cases(spark, folder), finder_matching.screened_people(spark, folder), answers, as_part(finder_matching.recognized_cases(spark, folder)), F.lit(AS_OF).cast("timestamp")
    )
    return screened.select(
        "session_id", "case_id", "answer", "recognized", "score", "signal", F.array_join("reasons", " / ").alias("reasons"), F.size("questions").alias("n_questions")
    )


QUERIES = {"catalog_matches": catalog_matches, "catalog_screened": catalog_screened}

# ---- the same in SQL ----

_UNIFIED = _CASES.replace("cases AS (", "noted AS (", 1) + ",\n" + _CATALOG.replace("\nWITH ", "", 1) + f""",
cases AS (
  SELECT w.id AS case_id, w.company, w.title, w.kind, w.window_status, w.freshness, w.proof AS case_proof, n.aliases, n.issue_types, n.situations, n.eligible, n.y0, n.y1,
    CAST(substr(replace(w.deadline, 'T', ' '), 1, 19) AS TIMESTAMP) + CASE WHEN ends_with(w.deadline, '-07:00') THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END AS deadline,
    coalesce(n.notice, false) AS notice, n.case_id IS NOT NULL AS has_criteria, n.recognition,
    list_filter(list_distinct(string_split({_norm("w.company || ' ' || w.title")}, ' ')), lambda t: t <> '' AND t NOT IN {finder_matching.sql_list(finder_matching.N.GENERIC_IDENTITY_WORDS)}) AS identity_
  FROM whole w LEFT JOIN noted n ON n.has_criteria AND w.id = replace(n.case_id, 'case-', 'part-'))"""
_NAMED = _PEOPLE.replace("people AS (", "asked AS (", 1) + """,
people AS (
  SELECT * REPLACE (trim(words || ' ' || CASE session_id % 5 WHEN 0 THEN 'doe ' || (session_id * 7 % 1500 + 1) WHEN 1 THEN 'ftc program' WHEN 2 THEN 'supplier ' || lpad(CAST(session_id % 100 + 1 AS VARCHAR), 9, '0')
    WHEN 3 THEN 'proposed doe' ELSE '' END) AS words) FROM asked)"""

ORACLES = {
    "catalog_matches": _sql_ranked(_NAMED, _UNIFIED) + """
SELECT session_id, rank, case_id, score, kind, signal, array_to_string(reasons, ' / ') AS reasons, array_to_string(questions, ' / ') AS questions FROM told""",
    "catalog_screened": finder_matching.ORACLES["screened_candidates"].replace(_CASES, _UNIFIED).replace("'case-' || (1 +", "'part-' || (1 +"),
}
