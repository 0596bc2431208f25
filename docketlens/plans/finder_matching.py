"""Finder matching: ``part`` as catalog cases, ``customer`` and ``conversations`` as sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.functions import finder as N
from docketlens.operators import matcher as M
from docketlens.operators import sessions as S
from docketlens.operators.keyed import keep_last
from docketlens.plans.tables import pick, row_count, sql_list, sql_pick, table
from docketlens.plans.text_classifiers import _SESSIONS, messages
from docketlens.session import written_once

AS_OF = "1999-01-01 12:00:00"
PROOFS = ["No documents stated", "Notice or ID", "Records may be requested", "Requirements not stated"]
GOALS = ["open_claims", "explore", "government_redress", "watch_cases", "open_claims", "explore"]
PLACES = ["washington", "texas", "new york", "ohio"]
SAID_PLACES = ["WA", " Texas ", "new york", "OH", "utah"]
SITUATIONS = list(M.SITUATION_LABELS)[:6]
WISHES = ["No documents stated", "Notice or ID", "Records may be requested", "Any", "Any"]
TOP = 3
#: Cases on a page of prompts.
PROMPTED = 12


def catalog(spark, folder):
    key = F.col("p_partkey")
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))
    start = F.lit(1990) + key % 8
    return table(spark, folder, "part").select(
        F.concat(F.lit("case-"), key).alias("case_id"),
        F.col("p_brand").alias("company"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"),
        F.when(key % 50 == 9, M.INTAKE).when(key % 5 == 3, M.AGENCY).when(key % 5 == 4, M.DOCKET).otherwise(M.CLAIM).alias("kind"),
        F.when(key % 7 == 0, "closed").otherwise("open").alias("window_status"),
        F.when(key % 11 == 0, "stale").otherwise("current").alias("freshness"),
        F.when(key % 9 != 0, F.timestamp_add("DAY", (key * 37 % 400).cast("int"), F.lit("1998-10-01 23:59:59").cast("timestamp_ntz"))).alias("deadline"),
        pick(key % 4, PROOFS).alias("proof"),
        F.array("p_name", "p_brand").alias("aliases"),
        some((F.col("p_size") % 2 == 0, "privacy"), (F.col("p_size") % 3 == 0, "finance"), (F.col("p_size") % 5 == 0, "consumer")).alias("issue_types"),
        F.array(pick(key % 6, SITUATIONS), pick((key * 5 + 1) % 6, SITUATIONS)).alias("situations"),
        F.when(key % 3 == 0, F.array(pick(key % 4, PLACES), pick((key + 1) % 4, PLACES))).alias("eligible_states"),
        F.when(key % 4 == 1, F.concat(start, F.lit("-06-01"))).alias("covered_start"),
        F.when(key % 4 == 1, F.concat(start + key % 5, F.lit("-07-07"))).alias("covered_end"),
        (key % 6 == 0).alias("notice_required"),
        (key % 13 != 0).alias("has_criteria"),
        F.concat(F.lit("Product "), "p_name").alias("recognition_label"),
    )


def sessions(spark, folder):
    """Customers with wishes; their keywords name the product of the same number."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    joined = table(spark, folder, "customer").join(parts.hint("merge"), 1 + key % row_count(spark, folder, "part") == F.col("p_partkey"), "left")
    keywords = F.when(key % 7 == 0, "act now").otherwise(
        F.concat_ws(
            " ", "p_name", F.when(key % 3 == 0, F.col("p_brand")), F.when(key % 4 == 0, "medium large"),
            F.when(key % 6 == 1, "1995 2003"), F.when(key % 6 == 2, "1992"),
        )
    )
    return joined.select(
        key.alias("session_id"), pick(key % 6, GOALS).alias("goal"), (key % 10 < 8).alias("goal_explicit"),
        F.array_compact(F.array(
            F.when(nation % 3 == 0, "finance"), F.when(nation % 2 == 0, "privacy"), F.when(nation % 5 == 0, "consumer")
        )).alias("experiences"),
        F.when(key % 4 == 0, pick(nation % 5, SAID_PLACES)).otherwise("").alias("location"),
        pick(nation % 5, WISHES).alias("proof"), keywords.alias("keywords"),
    )


def ready(cases, people):
    """Cases and sessions with a ``keywords`` text; what ranking and explaining read several times is written, spread by session."""
    people = written_once(people.repartition("session_id"), "finder-sessions")
    texts, tokens = M.keyword_tables(people)
    return M.prepare(cases, people, written_once(texts, "keyword-texts"), written_once(tokens, "keyword-tokens"))


def inputs(spark, folder):
    return ready(catalog(spark, folder), sessions(spark, folder))


def ranked_matches(spark, folder):
    return M.rank_cases(inputs(spark, folder), TOP)


def ranked_followups(spark, folder):
    made = inputs(spark, folder)
    return M.explain_matches(M.rank_cases(made, TOP), made).select(
        "session_id", "rank", "case_id", "layer", F.array_join("reasons", " / ").alias("reasons"), F.array_join("questions", " / ").alias("questions")
    )


def conversation_matches(spark, folder):
    """Messages folded into preferences, their keywords as bounded chunks, then ranked."""
    said = messages(spark, folder).filter("role = 'user'")
    parsed = written_once(S.message_preferences(said).drop("text"), "parsed-messages")
    people = S.session_preferences(parsed, "conv_id", "turn").withColumnRenamed("conv_id", "session_id")
    tokens = written_once(
        S.session_keywords(parsed, "conv_id", "turn").withColumnRenamed("conv_id", "session_id"), "session-keywords"
    )
    cases = catalog(spark, folder)
    made = M.prepare(cases, people, M.keyword_chunks(tokens, M.alias_reach(cases)), tokens)
    return M.rank_cases(made, TOP).select("session_id", "rank", "case_id", "score", "signal")


def situation_candidates(spark, folder):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return M.situation_candidates(catalog(spark, folder), as_of).select("situation", "case_id").orderBy("situation", "case_id")


def order_answers(spark, folder):
    """Orders as answers of customers about cases."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("session_id"), F.concat(F.lit("case-"), 1 + F.col("o_orderkey") % row_count(spark, folder, "part")).alias("case_id"),
        F.when(F.col("o_orderstatus") == "O", "yes").when(F.col("o_orderstatus") == "P", "unsure").otherwise("no").alias("answer"),
        "o_orderkey", "o_orderpriority",
    )


def screened_people(spark, folder):
    nation = F.col("c_nationkey")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("session_id"),
        F.array_compact(F.array(pick(nation % 6, SITUATIONS), pick((nation + 2) % 6, SITUATIONS), F.when(nation % 4 == 0, "not_sure"))).alias("situations"),
    )


def recognized_cases(spark, folder):
    return order_answers(spark, folder).filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("session_id") % 2 == 0)).select("session_id", "case_id")


def session_candidates(spark, folder):
    """The first page of prompted cases of each customer."""
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    found = M.session_candidates(catalog(spark, folder), screened_people(spark, folder), recognized_cases(spark, folder), as_of, PROMPTED)
    return found.select("session_id", "rank", "case_id")


def _candidate_lists(spark, folder):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return M.candidate_lists(catalog(spark, folder), screened_people(spark, folder), recognized_cases(spark, folder), as_of)


def candidate_lists(spark, folder):
    """All prompted cases of each distinct choice of situations."""
    return _candidate_lists(spark, folder)[0].select(F.array_join("chosen", ",").alias("choice"), F.col("rank").cast("int").alias("rank"), "case_id")


def candidate_choices(spark, folder):
    """Which of ``candidate_lists`` each customer sees who recognized no case."""
    return _candidate_lists(spark, folder)[1].select("session_id", F.array_join("chosen", ",").alias("choice"))


def recognized_candidates(spark, folder):
    """All prompted cases of the customers who recognized some."""
    return _candidate_lists(spark, folder)[2].select("session_id", F.col("rank").cast("int").alias("rank"), "case_id")


def screened_candidates(spark, folder):
    """The latest answer of a customer about a case counts."""
    orders = order_answers(spark, folder)
    answers = keep_last(orders, ["session_id", "case_id"], [F.col("o_orderkey")])
    return M.screen_claims(
        catalog(spark, folder), screened_people(spark, folder), answers.drop("o_orderkey", "o_orderpriority"), recognized_cases(spark, folder), F.lit(AS_OF).cast("timestamp_ntz")
    ).orderBy("session_id", *M.match_order()).select("session_id", "case_id", "answer", "recognized", "score", "signal", F.array_join("reasons", " / ").alias("reasons"), F.size("questions").alias("n_questions"))


QUERIES = {
    "ranked_matches": ranked_matches,
    "ranked_followups": ranked_followups,
    "conversation_matches": conversation_matches,
    "situation_candidates": situation_candidates,
    "session_candidates": session_candidates,
    "candidate_lists": candidate_lists,
    "candidate_choices": candidate_choices,
    "recognized_candidates": recognized_candidates,
    "screened_candidates": screened_candidates,
}

# ---- the same in SQL: every session against every case ----

_norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_CODES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.STATES.items()) + "}"
_CASES = f"""cases AS (
  SELECT 'case-' || p_partkey AS case_id, p_brand AS company, p_name || ' ' || lower(p_type) AS title,
    CASE WHEN p_partkey % 50 = 9 THEN 'legal_counsel_intake' WHEN p_partkey % 5 = 3 THEN 'government_redress' WHEN p_partkey % 5 = 4 THEN 'potential_class_case' ELSE 'settlement_claims_open' END AS kind,
    CASE WHEN p_partkey % 7 = 0 THEN 'closed' ELSE 'open' END AS window_status, CASE WHEN p_partkey % 11 = 0 THEN 'stale' ELSE 'current' END AS freshness,
    CASE WHEN p_partkey % 9 <> 0 THEN TIMESTAMP '1998-10-01 23:59:59' + INTERVAL 1 DAY * (p_partkey * 37 % 400) END AS deadline,
    {sql_pick('p_partkey % 4', PROOFS)} AS case_proof, [p_name, p_brand] AS aliases,
    list_filter([CASE WHEN p_size % 2 = 0 THEN 'privacy' END, CASE WHEN p_size % 3 = 0 THEN 'finance' END, CASE WHEN p_size % 5 = 0 THEN 'consumer' END], lambda x: x IS NOT NULL) AS issue_types,
    [{sql_pick('p_partkey % 6', SITUATIONS)}, {sql_pick('(p_partkey * 5 + 1) % 6', SITUATIONS)}] AS situations,
    CASE WHEN p_partkey % 3 = 0 THEN [{sql_pick('p_partkey % 4', PLACES)}, {sql_pick('(p_partkey + 1) % 4', PLACES)}] END AS eligible,
    CASE WHEN p_partkey % 4 = 1 THEN 1990 + p_partkey % 8 END AS y0, CASE WHEN p_partkey % 4 = 1 THEN 1990 + p_partkey % 8 + p_partkey % 5 END AS y1,
    p_partkey % 6 = 0 AS notice, p_partkey % 13 <> 0 AS has_criteria, 'Product ' || p_name AS recognition,
    list_filter(list_distinct(string_split({_norm("p_brand || ' ' || p_name || ' ' || p_type")}, ' ')), lambda t: t <> '' AND t NOT IN {sql_list(N.GENERIC_IDENTITY_WORDS)}) AS identity_
  FROM part)"""
_PEOPLE = f"""people AS (
  SELECT c_custkey AS session_id, {sql_pick('c_custkey % 6', GOALS)} AS goal, c_custkey % 10 < 8 AS explicit_,
    list_filter([CASE WHEN c_nationkey % 3 = 0 THEN 'finance' END, CASE WHEN c_nationkey % 2 = 0 THEN 'privacy' END, CASE WHEN c_nationkey % 5 = 0 THEN 'consumer' END], lambda x: x IS NOT NULL) AS experiences,
    CASE WHEN c_custkey % 4 = 0 THEN {sql_pick('c_nationkey % 5', SAID_PLACES)} ELSE '' END AS said, {sql_pick('c_nationkey % 5', WISHES)} AS proof,
    {_norm('''CASE WHEN c_custkey % 7 = 0 THEN 'act now' ELSE concat_ws(' ', p_name, CASE WHEN c_custkey % 3 = 0 THEN p_brand END, CASE WHEN c_custkey % 4 = 0 THEN 'medium large' END,
      CASE WHEN c_custkey % 6 = 1 THEN '1995 2003' END, CASE WHEN c_custkey % 6 = 2 THEN '1992' END) END''')} AS words
  FROM (SELECT *, 1 + c_custkey % (SELECT count(*) FROM part) AS part_no FROM customer) LEFT JOIN part ON p_partkey = part_no)"""


def _sql_ranked(people: str, cases: str = _CASES) -> str:
    label = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.ISSUE_LABELS.items()) + " END"
    return f"""
WITH {people}, {cases},
prefs AS (
  SELECT *, coalesce({_CODES}[upper(trim(said))], {_norm('trim(said)')}) AS place,
    list_filter(all_tokens, lambda t, i: list_position(all_tokens, t) = i) AS tokens,
    list_transform(list_distinct(regexp_extract_all(words, '\\b(?:19|20)\\d{{2}}\\b')), lambda y: CAST(y AS INTEGER)) AS years FROM (
    SELECT *, list_filter(string_split(words, ' '), lambda t: length(t) >= 2 AND t NOT IN {sql_list([*N.STOP_WORDS, *N.GENERIC_WORDS])}) AS all_tokens FROM people)),
pairs AS (
  SELECT p.*, c.*, kind IN ('government_redress', 'potential_class_case') AS related,
    list_filter(tokens, lambda t: list_contains(identity_, t)) AS shared, list_filter(experiences, lambda e: list_contains(issue_types, e)) AS common,
    list_filter(aliases, lambda a: contains(words, {_norm('a')})) AS hit, place <> '' AND eligible IS NOT NULL AS place_rule, len(years) > 0 AND y0 IS NOT NULL AS year_rule,
    proof <> 'Any' AND case_proof = proof AS proof_same, proof = 'Notice or ID' AND notice AS proof_notice
  FROM prefs p, cases c
  WHERE (len(tokens) > 0 OR len(experiences) > 0 OR place <> '' OR proof <> 'Any')
    AND CASE goal WHEN 'open_claims' THEN kind = 'settlement_claims_open' AND window_status = 'open' WHEN 'government_redress' THEN kind = 'government_redress'
      WHEN 'watch_cases' THEN kind = 'potential_class_case' ELSE kind <> 'legal_counsel_intake' END),
allowed AS (
  SELECT * FROM pairs WHERE CASE WHEN related THEN explicit_ AND len(shared) > 0 ELSE has_criteria AND (NOT place_rule OR list_contains(eligible, place))
    AND (NOT year_rule OR len(list_filter(years, lambda y: y BETWEEN y0 AND y1)) > 0)
    AND (len(hit) > 0 OR len(common) > 0 OR place_rule OR year_rule OR proof_same OR proof_notice) END),
scored AS (
  SELECT *, CAST(CASE WHEN related THEN 26 + least(10, 3 * len(shared)) ELSE 8 + CASE WHEN len(hit) > 0 THEN 30 ELSE 0 END + 8 * len(common) + CASE WHEN place_rule THEN 12 ELSE 0 END
      + CASE WHEN year_rule THEN 8 ELSE 0 END + CASE WHEN proof_same OR proof_notice THEN 7 WHEN proof = 'No documents stated' THEN -5 ELSE 0 END END
    - CASE WHEN freshness = 'stale' THEN 20 ELSE 0 END AS INTEGER) AS score FROM allowed),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY score DESC, list_position({M.KINDS}, kind), deadline NULLS LAST, case_id) AS INTEGER) AS rank FROM scored
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, list_position({M.KINDS}, kind), deadline NULLS LAST, case_id) <= {TOP}),
told AS (
  SELECT *, CASE WHEN score >= 34 THEN 'Several details line up' WHEN score >= 17 THEN 'Some details line up' ELSE 'Broad catalog suggestion' END AS signal,
    CASE WHEN kind = 'settlement_claims_open' THEN 'open_claim' ELSE 'related_source' END AS layer,
    list_slice(list_filter([
      CASE kind WHEN 'settlement_claims_open' THEN 'A hand-reviewed claim window is listed' WHEN 'government_redress' THEN 'Found on an official government redress page' ELSE 'A proposed federal class-action docket to monitor' END,
      CASE WHEN related THEN 'Company or case name mentions ' || array_to_string(shared[1:3], ', ') END, CASE WHEN NOT related AND len(hit) > 0 THEN 'Company or product matches ' || hit[1] END,
      CASE WHEN NOT related AND len(common) > 0 THEN 'Connected to ' || array_to_string(list_transform(common[1:2], lambda e: {label}), ' and ') END,
      CASE WHEN NOT related AND place_rule THEN 'The reviewed class definition includes ' || place END, CASE WHEN NOT related AND year_rule THEN 'The year overlaps the reviewed covered period' END,
      CASE WHEN related THEN NULL WHEN proof_same THEN 'Source summary says: ' || lower(case_proof) WHEN proof_notice THEN 'The reviewed class definition mentions a notice' END
    ], lambda r: r IS NOT NULL), 1, 5) AS reasons,
    list_slice(list_filter([
      CASE WHEN kind = 'settlement_claims_open' AND has_criteria AND place = '' AND eligible IS NOT NULL THEN 'Were you in ' || array_to_string(eligible, ' or ') || ' during the covered period?' END,
      CASE WHEN kind = 'settlement_claims_open' AND has_criteria AND len(years) = 0 AND y0 IS NOT NULL THEN 'Did this happen during the official covered dates?' END,
      CASE WHEN kind = 'settlement_claims_open' AND has_criteria AND notice AND proof <> 'Notice or ID' THEN 'Did you receive the notice described by the official settlement site?' END,
      CASE WHEN kind = 'settlement_claims_open' THEN 'Does the official class definition apply to you?' END,
      CASE WHEN kind = 'government_redress' THEN 'Does the agency page provide instructions for you, or is distribution automatic?' END,
      CASE WHEN kind = 'potential_class_case' THEN 'Has the court later certified a class or opened any participation process?' END,
      CASE WHEN case_proof = 'Requirements not stated' THEN 'What records or notice does the official source require?' END
    ], lambda q: q IS NOT NULL), 1, 2) AS questions FROM ranked)"""


_CONVERSATIONS = _SESSIONS.replace("\nWITH talk", "talk", 1) + f""",
firsts AS (
  SELECT conv_id, token, min((turn, i)) AS at_ FROM (SELECT conv_id, turn, unnest(keywords) AS token, generate_subscripts(keywords, 1) AS i FROM kept) GROUP BY ALL),
worded AS (SELECT conv_id, string_agg(token, ' ' ORDER BY at_) AS words FROM firsts GROUP BY conv_id),
issued AS (
  SELECT conv_id, list(issue ORDER BY turn, list_position([{', '.join(f"'{n}'" for n, _ in N.ISSUES)}], issue)) AS experiences FROM (
    SELECT conv_id, issue, min(turn) AS turn FROM (SELECT conv_id, turn, unnest(experiences) AS issue FROM kept) GROUP BY conv_id, issue) GROUP BY conv_id),
people AS (
  SELECT conv_id AS session_id, coalesce(arg_max(goal, turn) FILTER (WHERE goal IS NOT NULL), 'open_claims') AS goal, count(goal) > 0 AS explicit_,
    coalesce(any_value(issued.experiences), []) AS experiences, coalesce(arg_max(location, turn) FILTER (WHERE location <> ''), '') AS said,
    coalesce(arg_max(proof, turn) FILTER (WHERE proof IS NOT NULL), 'Any') AS proof, coalesce(any_value(words), '') AS words
  FROM kept LEFT JOIN issued USING (conv_id) LEFT JOIN worded USING (conv_id) GROUP BY conv_id)"""
_OPEN = f"kind = 'settlement_claims_open' AND window_status = 'open' AND freshness = 'current' AND has_criteria AND (deadline IS NULL OR deadline >= TIMESTAMP '{AS_OF}')"
_LABELS = "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.SITUATION_LABELS.items()) + " END"

_ANSWERED = f"""orders_ AS (
  SELECT o_custkey AS session_id, 'case-' || (1 + o_orderkey % (SELECT count(*) FROM part)) AS case_id, CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'P' THEN 'unsure' ELSE 'no' END AS answer, o_orderkey, o_orderpriority FROM orders),
answers AS (SELECT * FROM orders_ QUALIFY row_number() OVER (PARTITION BY session_id, case_id ORDER BY o_orderkey DESC) = 1),
marked AS (SELECT DISTINCT session_id, case_id FROM orders_ WHERE o_orderpriority = '1-URGENT' AND session_id % 2 = 0),
people AS (
  SELECT c_custkey AS session_id, CASE WHEN c_nationkey % 4 = 0 THEN ['not_sure'] ELSE [{sql_pick('c_nationkey % 6', SITUATIONS)}, {sql_pick('(c_nationkey + 2) % 6', SITUATIONS)}] END AS chosen FROM customer),"""

ORACLES = {
    "ranked_matches": _sql_ranked(_PEOPLE) + "\nSELECT session_id, rank, case_id, score, kind, signal, layer FROM told",
    "ranked_followups": _sql_ranked(_PEOPLE) + """
SELECT session_id, rank, case_id, layer, array_to_string(reasons, ' / ') AS reasons, array_to_string(questions, ' / ') AS questions FROM told""",
    "conversation_matches": _sql_ranked(_CONVERSATIONS) + "\nSELECT session_id, rank, case_id, score, signal FROM told",
    "situation_candidates": f"""
WITH {_CASES} SELECT DISTINCT unnest(list_append(situations, 'not_sure')) AS situation, case_id FROM cases WHERE {_OPEN}""",
    "session_candidates": f"""
WITH {_CASES},
{_ANSWERED}
prompted AS (
  SELECT p.session_id, c.case_id, c.deadline FROM people p, cases c
  WHERE {_OPEN} AND (list_contains(chosen, 'not_sure') OR list_has_any(situations, chosen))
    AND (NOT EXISTS (SELECT 1 FROM marked m WHERE m.session_id = p.session_id) OR EXISTS (SELECT 1 FROM marked m WHERE m.session_id = p.session_id AND m.case_id = c.case_id)))
SELECT session_id, CAST(row_number() OVER w AS INTEGER) AS rank, case_id FROM prompted
WINDOW w AS (PARTITION BY session_id ORDER BY deadline NULLS LAST, case_id) QUALIFY rank <= {PROMPTED}""",
    "candidate_lists": f"""
WITH {_CASES},
{_ANSWERED}
choices AS (SELECT DISTINCT list_sort(chosen) AS chosen FROM people WHERE session_id NOT IN (SELECT session_id FROM marked))
SELECT array_to_string(chosen, ',') AS choice, CAST(row_number() OVER (PARTITION BY chosen ORDER BY deadline NULLS LAST, case_id) AS INTEGER) AS rank, case_id
FROM choices, cases WHERE {_OPEN} AND (list_contains(chosen, 'not_sure') OR list_has_any(situations, chosen))""",
    "candidate_choices": f"""
WITH {_ANSWERED[:-1]}
SELECT session_id, array_to_string(list_sort(chosen), ',') AS choice FROM people WHERE session_id NOT IN (SELECT session_id FROM marked)""",
    "recognized_candidates": f"""
WITH {_CASES},
{_ANSWERED[:-1]}
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY deadline NULLS LAST, case_id) AS INTEGER) AS rank, case_id
FROM marked JOIN people USING (session_id) JOIN cases USING (case_id) WHERE {_OPEN} AND (list_contains(chosen, 'not_sure') OR list_has_any(situations, chosen))""",
    "screened_candidates": f"""
WITH {_CASES},
{_ANSWERED}
rows_ AS (
  SELECT a.*, c.*, p.chosen, m.case_id IS NOT NULL AS recognized, a.session_id IN (SELECT session_id FROM marked) AS any_marked,
    list_filter(list_distinct_(situations), lambda s: list_contains(chosen, s)) AS selected
  FROM answers a JOIN cases c ON a.case_id = c.case_id JOIN people p ON p.session_id = a.session_id LEFT JOIN marked m ON m.session_id = a.session_id AND m.case_id = a.case_id
  WHERE answer <> 'no' AND {_OPEN})
SELECT session_id, case_id, answer, recognized, CAST(CASE answer WHEN 'yes' THEN 100 ELSE 50 END + CASE WHEN recognized THEN 20 ELSE 0 END AS INTEGER) AS score,
  CASE answer WHEN 'yes' THEN 'Worth reviewing' ELSE 'Needs confirmation' END AS signal,
  CASE WHEN recognized THEN 'You recognized ' || recognition || ' from the prompted list' WHEN len(selected) > 0 THEN 'You selected: ' || array_to_string(list_transform(selected, lambda s: {_LABELS}), '; ')
    ELSE 'You asked to review every prompted possibility' END || CASE answer WHEN 'yes' THEN ' / You said the source-reviewed facts sound true' ELSE ' / You marked the source-reviewed facts as not sure' END AS reasons, CASE answer WHEN 'yes' THEN 1 ELSE 2 END AS n_questions
FROM rows_ WHERE (list_contains(chosen, 'not_sure') OR len(selected) > 0) AND (NOT any_marked OR recognized)""".replace(
        "list_distinct_(situations)", "(CASE WHEN situations[1] = situations[2] THEN situations[1:1] ELSE situations END)"
    ).replace("a.*, c.*", "a.session_id, a.answer, c.*"),
}
