"""Ranking catalog cases for finder sessions: exact top-k without pairing every session with every case.

A case's score depends on a session only through a few features. Cases are therefore cut to the best
``k`` of each *slot* (a combination of features under which they all score alike) before sessions
look slots up:

* reviewed claims: slots of (state, covered year, alias, class), where the class holds the small
  attributes that enter the score. Sessions with equal preferences share one lookup.
* related records (agency programs, dockets): the score grows with the number of shared identity
  tokens, up to four. Each token is a slot; where its slot left cases out that a session may still need,
  sets of the token with further such tokens are slots as well, up to four tokens.

In both cases a case left out of its slot is beaten by ``k`` cases of that slot, so the result is the
same as ranking all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions import finder as N
from docketlens.functions.text import strip
from docketlens.operators.keyed import global_position, only_keys, running_position, top_k, without_keys
from docketlens.session import written_once

# Kinds in rank order, reasons, labels, weights and bands.
KINDS = ["settlement_claims_open", "government_redress", "potential_class_case", "legal_counsel_intake"]
CLAIM, AGENCY, DOCKET, INTAKE = KINDS
KIND_REASONS = {
    CLAIM: "A hand-reviewed claim window is listed",
    AGENCY: "Found on an official government redress page",
    DOCKET: "A proposed federal class-action docket to monitor",
    INTAKE: "A legal intake destination is listed",
}
ISSUE_LABELS = {
    "consumer": "product or service", "privacy": "privacy or data breach",
    "communications": "emails, texts, or calls", "employment": "job or gig work",
    "healthcare": "healthcare", "finance": "banking or investing",
}
BANDS = [(34, "Several details line up"), (17, "Some details line up")]
BROAD = "Broad catalog suggestion"
NO_DOCUMENTS, NOTICE, NOT_STATED = "No documents stated", "Notice or ID", "Requirements not stated"
# Characters of a gram, of an anchor; tokens that count.
GRAM, ANCHOR = 3, 8
MOST_SHARED = 4
# Slot keys no normalized text can equal.
ANY, OPEN = "#any", "#open"
SITUATION_LABELS = {
    "breach_notice": "i received a data-breach or security notice",
    "healthcare_tool": "i used a patient portal or online healthcare booking",
    "voice_assistant": "i or someone in my household used a voice assistant",
    "washington_job": "i applied for a job located in washington",
    "marketing_email": "i received retail marketing emails while living in washington",
    "professional_services": "i used or interacted with credit-counseling, accounting, or legal services",
    "not_sure": "i’m not sure — show me the possibilities",
}
ANSWERED = {
    "yes": "You said the source-reviewed facts sound true",
    "unsure": "You marked the source-reviewed facts as not sure",
}
CONFIRM = {
    "yes": ["Review the complete official class definition before taking any action."],
    "unsure": [
        "Confirm each prompted fact against your own records and the official class definition.",
        "The official administrator decides eligibility.",
    ],
}


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def match_order(score: str = "score") -> list[Column]:
    """Best score, kind rank, earliest deadline (none last), id."""
    return [F.col(score).desc(), kind_rank(F.col("kind")), *deadline_order()]


def deadline_order() -> list[Column]:
    """Earliest deadline (none last), id as a reader sorts it."""
    return [F.col("deadline").asc_nulls_last(), F.collate(F.col("case_id"), "UNICODE"), F.col("case_id")]


def is_reviewed_open(as_of: Column) -> Column:
    """A claim window that is open, current, reviewed, and not past its deadline at ``as_of``."""
    return (
        (F.col("kind") == CLAIM) & (F.col("window_status") == "open") & (F.col("freshness") == "current")
        & F.col("has_criteria") & (F.col("deadline").isNull() | (F.col("deadline") >= as_of))
    )


def _of_sessions(rows: DataFrame) -> DataFrame:
    """Rows by session for a join by session: never broadcast, as Spark would while it takes their compressed file for small."""
    return rows.hint("merge")


# ---- session tables ----


def keyword_tables(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, tokens) of sessions with a ``keywords`` text column."""
    # Years are looked for in the words as they were typed: normalizing would part "alpha_2021".
    texts = sessions.select("session_id", N.normalize(F.col("keywords")).alias("text"), F.col("keywords").alias("raw"))
    tokens = sessions.select("session_id", F.posexplode(F.array_distinct(N.tokenize(F.col("keywords")))).alias("position", "token"))
    return texts, tokens


def alias_reach(cases: DataFrame) -> int:
    """The tokens of the longest normalized alias of a catalog: one number, for ``keyword_chunks``."""
    longest = F.array_max(F.transform("aliases", lambda a: F.size(F.split(N.normalize(a), " "))))
    return cases.agg(F.max(longest).alias("n")).first()["n"] or 1


def keyword_chunks(tokens: DataFrame, longest_alias: int, size: int = 64) -> DataFrame:
    """Keyword texts of sessions given as token rows, in overlapping chunks of bounded size.

    An alias of at most ``longest_alias`` tokens that occurs in the whole text occurs in a chunk.
    """
    at, size = F.col("position"), max(size, longest_alias)
    chunk = F.floor(at / size)
    spill = F.when((at % size < longest_alias - 1) & (chunk > 0), chunk - 1)
    placed = tokens.select(
        "session_id", "position", "token", F.explode(F.array_compact(F.array(chunk, spill))).alias("_chunk")
    )
    return placed.groupBy("session_id", "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("position", "token"))).alias("_t")
    ).select("session_id", F.array_join(F.transform("_t", lambda t: t["token"]), " ").alias("text"))


def _years(texts: DataFrame) -> DataFrame:
    """Distinct years (1900-2099, so at most 200) of each session."""
    return (
        texts.select("session_id", F.explode(N.years_of(F.col("raw" if "raw" in texts.columns else "text"))).alias("year")).distinct()
        .groupBy("session_id").agg(F.sort_array(F.collect_set("year")).alias("years"))
    )


def _profiles(sessions: DataFrame, texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sessions with any specific wish, their years, and a ``profile`` text naming all but the keywords."""
    worded = tokens.groupBy("session_id").agg(F.lit(True).alias("_worded"))
    wishes = (F.size("experiences") > 0) | (strip(F.col("location")) != "") | (F.col("proof") != "Any")
    specific = sessions.join(_of_sessions(worded), "session_id", "left").filter(wishes | F.col("_worded").isNotNull())
    joined = specific.join(_of_sessions(_years(texts)), "session_id", "left").select(
        "session_id", "goal", "goal_explicit", "experiences",
        N.normalize_location(F.col("location")).alias("location"), "proof",
        F.coalesce("years", F.expr("array()").cast("array<int>")).alias("years"),
    )
    return joined.withColumn(
        "profile",
        F.concat_ws(
            "|", "goal", F.array_join(F.array_sort("experiences"), ","), "location", "proof",
            F.array_join(F.transform("years", lambda y: y.cast("string")), ","),
        ),
    )


# ---- reviewed claims ----


def _alias_keys(cases: DataFrame) -> Column:
    """The normalized aliases of each case, in order; ``prepare`` has written them."""
    return F.col("_alias_keys") if "_alias_keys" in cases.columns else F.transform("aliases", N.normalize)


def _claim_slots(cases: DataFrame, lookups: DataFrame, hits: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(by class, by alias): the best ``k`` claims of each (state, year, class), and of each (alias, state, year, class).

    Only states, years and aliases that some session looks up are spread out.
    """
    claims = cases.filter((F.col("kind") == CLAIM) & F.col("has_criteria"))
    start, end = (F.substring(c, 1, 4).try_cast("int") for c in ("covered_start", "covered_end"))
    bounded = F.sequence(F.greatest(start, F.lit(1900)), F.least(end, F.lit(2099)))
    years = F.when(start.isNull() | end.isNull(), F.array(F.lit(OPEN))).otherwise(
        F.when(
            F.greatest(start, F.lit(1900)) <= F.least(end, F.lit(2099)),
            F.transform(bounded, lambda y: y.cast("string")),
        ).otherwise(F.expr("array()").cast("array<string>"))
    )
    states = F.coalesce(F.array_distinct("eligible_states"), F.array(F.lit(OPEN)))
    aliases = F.array_distinct(_alias_keys(cases))
    keyed = claims.select(
        "case_id", "kind", "deadline", F.array_sort("issue_types").alias("issue_types"), "proof",
        F.coalesce("notice_required", F.lit(False)).alias("notice_required"), "freshness", "window_status", aliases.alias("_aliases"), years.alias("_years"),
        states.alias("_states"),
    )
    slot = ["state_key", "year_key", "issue_types", "proof", "notice_required", "freshness", "window_status"]

    def spread(rows: DataFrame) -> DataFrame:
        for key, values in (("state_key", "_states"), ("year_key", "_years")):
            rows = rows.withColumn(key, F.explode(F.concat(F.array(F.lit(ANY)), F.col(values)))).drop(values)
            rows = only_keys(rows, lookups, [key])
        return rows

    named = keyed.withColumn("alias_key", F.explode("_aliases")).drop("_aliases")
    by_class = top_k(spread(keyed.drop("_aliases")), slot, deadline_order(), k)
    return by_class, top_k(spread(only_keys(named, hits, ["alias_key"])), ["alias_key", *slot], deadline_order(), k)


def _lookup_keys(profiles: DataFrame) -> DataFrame:
    """Each profile with the slot keys it reads: its state and open ones, its years and open ones."""
    states = F.when(F.col("location") == "", F.array(F.lit(ANY))).otherwise(
        F.array(F.lit(OPEN), F.col("location"))
    )
    years = F.when(F.size("years") == 0, F.array(F.lit(ANY))).otherwise(
        F.concat(F.array(F.lit(OPEN)), F.transform("years", lambda y: y.cast("string")))
    )
    return profiles.withColumn("state_key", F.explode(states)).withColumn("year_key", F.explode(years))


def _claim_features() -> dict[str, Column]:
    """The reason-giving parts of a claim's score, over joined profile and slot columns."""
    has_location, has_years = F.col("location") != "", F.size("years") > 0
    proof = F.col("proof_wanted")
    matches = (proof != "Any") & (
        (F.col("proof") == proof) | ((proof == NOTICE) & F.col("notice_required"))
    )
    return {
        "issues": F.array_intersect("experiences", "issue_types"),
        "place": has_location & (F.col("state_key") != OPEN),
        "year": has_years & (F.col("year_key") != OPEN),
        "proof_fits": matches,
        "proof_misses": (proof == NO_DOCUMENTS) & ~matches,
    }


def _score_claims(joined: DataFrame, alias_hit: bool) -> DataFrame:
    scored = joined.filter(
        F.when(F.col("goal") == "open_claims", F.col("window_status") == "open").otherwise(F.col("goal") == "explore")
    ).select("*", *[c.alias(name) for name, c in _claim_features().items()])
    points = lambda cond, n: F.when(F.col(cond), n).otherwise(0)
    score = (
        F.lit(38 if alias_hit else 8) + F.size("issues") * 8 + points("place", 12) + points("year", 8)
        + points("proof_fits", 7) - points("proof_misses", 5)
        - F.when(F.col("freshness") == "stale", 20).otherwise(0)
    )
    reason = F.lit(alias_hit) | (F.size("issues") > 0) | F.col("place") | F.col("year") | F.col("proof_fits")
    return scored.filter(reason).withColumn("score", score)


def _best(candidates: DataFrame, keys: list[str], k: int, rank: str | None = None) -> DataFrame:
    """Distinct cases for each key at their best score, cut to ``k``."""
    merged = candidates.groupBy(*keys, "case_id").agg(
        F.max("score").alias("score"), F.first("kind").alias("kind"), F.first("deadline").alias("deadline")
    )
    return top_k(merged, keys, match_order(), k, rank)


def alias_hits(texts: DataFrame, cases: DataFrame) -> DataFrame:
    """(session_id, alias_key): normalized aliases contained in a session's keyword text.

    Each alias has an anchor: at most ``ANCHOR`` of its characters, beginning with the gram that the
    fewest texts hold. Normalized texts have 37 different characters, so there are at most
    1 + 37 + 37**2 + 37**3 grams, and the tables of grams are broadcast whatever the catalog's size.
    Of a text only the places where an anchor may begin are shuffled; equal texts are searched once.
    """
    aliases = (
        cases.filter((F.col("kind") == CLAIM) & F.col("has_criteria"))
        .select(F.explode(_alias_keys(cases)).alias("alias_key")).distinct()
    )
    searched = texts.select("text").distinct().withColumn("text_id", F.xxhash64("text"))
    size, reach = (F.least(F.length("alias_key"), F.lit(n)) for n in (GRAM, ANCHOR))
    starts = F.sequence(F.lit(1), F.length("alias_key") - reach + 1)
    begun = aliases.select("alias_key", F.explode(starts).alias("at")).select(
        "alias_key", F.substring("alias_key", F.col("at"), size).alias("gram"),
        F.substring("alias_key", F.col("at"), reach).alias("anchor"),
    )
    wanted = F.broadcast(begun.select("gram").distinct())
    frequency = (
        searched.select(F.explode(F.array_distinct(_grams(F.col("text"))["gram"])).alias("gram"))
        .join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    )
    # An alias with a gram that no text holds is in no text.
    rarest = (
        begun.join(frequency, "gram", "left").groupBy("alias_key")
        .agg(F.min_by(F.struct("gram", "anchor"), F.struct(F.coalesce("df", F.lit(0)), "gram", "anchor")).alias("_a"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
        .filter("df > 0").select("alias_key", "_a.*")
    )
    anchored = written_once(rarest, "alias-anchors")
    chosen = F.broadcast(anchored.select("gram", F.length("anchor").alias("reach")).distinct())
    places = (
        searched.select("text_id", "text", F.inline(_grams(F.col("text")))).join(chosen, "gram")
        .select("text_id", F.substring("text", F.col("at"), F.col("reach")).alias("anchor")).distinct()
    )
    candidates = places.join(anchored.select("anchor", "alias_key"), "anchor").select("text_id", "alias_key").distinct()
    return (
        texts.select("session_id", "text", F.xxhash64("text").alias("text_id")).join(candidates, "text_id")
        .filter(F.col("text").contains(F.col("alias_key"))).select("session_id", "alias_key").distinct()
    )


def _grams(text: Column) -> Column:
    """(at, gram) for every place of a text and every size up to ``GRAM``, and the empty gram once."""
    def sized(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(n)).alias("gram")))

    return F.concat(F.array(F.struct(F.lit(1).alias("at"), F.lit("").alias("gram"))), *[sized(n) for n in range(1, GRAM + 1)])


def _claim_matches(profiled: DataFrame, hits: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    columns = ["goal", "experiences", "location", "proof", "years"]
    distinct = (
        profiled.filter(F.col("goal").isin("open_claims", "explore"))
        .groupBy("profile").agg(*[F.first(c).alias(c) for c in columns])
        .withColumnRenamed("proof", "proof_wanted")
    )
    lookups = _lookup_keys(distinct)
    by_class, by_name = _claim_slots(cases, lookups, hits, k)
    plain = _score_claims(lookups.join(by_class, ["state_key", "year_key"]), alias_hit=False)
    by_profile = _best(plain, ["profile"], k)
    session_hits = profiled.select("session_id", "profile").join(_of_sessions(hits), "session_id")
    wanted = session_hits.select("profile", "alias_key").distinct()
    named = _score_claims(
        wanted.join(lookups, "profile").join(by_name, ["alias_key", "state_key", "year_key"]), alias_hit=True
    )
    by_alias = _best(named, ["profile", "alias_key"], k)
    columns = ["session_id", "case_id", "score", "kind", "deadline"]
    return (
        profiled.select("session_id", "profile").join(by_profile, "profile").select(*columns)
        .unionByName(session_hits.join(by_alias, ["profile", "alias_key"]).select(*columns))
    )


# ---- related records ----


def _identity() -> Column:
    return N.identity_tokens(F.concat_ws(" ", "company", "title"))


def _related_cases(cases: DataFrame) -> DataFrame:
    identity = F.col("_identity") if "_identity" in cases.columns else _identity()
    return cases.filter(F.col("kind").isin(AGENCY, DOCKET)).select(
        "case_id", "kind", "freshness", "deadline", identity.alias("identity")
    )


CLASS = ["kind", "freshness"]
SEEKER = ["session_id", *CLASS]


def _related_score(shared: Column) -> Column:
    """The score of a related record that shares that many tokens; a row's ``freshness`` counts."""
    points = F.lit(26) + F.least(F.lit(10), shared * 3) - F.when(F.col("freshness") == "stale", 20).otherwise(0)
    return points.cast("int")


def _best_related(sought: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(session_id, kind, freshness, case_id, deadline, place, score): the best ``k`` cases of each session.

    ``sought`` is (session_id, kind, token), ``postings`` (case_id, kind, freshness, deadline, place, token, df); cases of equal score
    go by place. The slot of a set of tokens is the first ``k`` of its cases in each class. A case that is in no slot of one
    token of a session has only tokens whose slots left cases out: it shares at most as many as the session has of
    those, which bounds its score, and it comes after the last of each of these slots. A session that knows ``k`` cases no such
    case can beat goes no further; else its sets grow by one token, up to four, from rare to frequent tokens, so that few sets begin
    with a token that most cases hold.
    """
    of_set = ["set_key", *CLASS]
    tokens = postings.select("token", *CLASS).distinct()
    held = sought.join(tokens, ["token", "kind"]).select(*SEEKER, F.col("token").alias("set_key"))
    level, best, further = postings.withColumn("set_key", F.col("token")), None, None
    for size in range(1, MOST_SHARED + 1):
        slots = written_once(top_k(level, of_set, [F.col("place")], k + 1, "_rank").select(*of_set, "case_id", "place", "_rank"), "related-slots")
        read = held.join(slots.filter(F.col("_rank") <= k), of_set).select(*SEEKER, "case_id").distinct()
        if best is not None:
            read = without_keys(read, best, ["session_id", "case_id"])
        counted = (
            read.join(postings.select("case_id", "deadline", "place", "token"), "case_id").join(_of_sessions(sought), ["session_id", "kind", "token"])
            .groupBy(*SEEKER, "case_id", "deadline", "place").agg(F.count(F.lit(1)).alias("n")).withColumn("score", _related_score(F.col("n"))).drop("n")
        )
        known = counted if best is None else best.select(*counted.columns).unionByName(counted)
        best = written_once(top_k(known, ["session_id"], [F.col("score").desc(), F.col("place")], k, "_rank"), "related-best")
        if size == MOST_SHARED:
            break
        cut = slots.groupBy(*of_set).agg(F.max("_rank").alias("_n"), F.max(F.when(F.col("_rank") == k, F.col("place"))).alias("last")).filter(F.col("_n") > k)
        left_out = held.join(cut, of_set)
        if size == 1:
            left_out = left_out.withColumn("most", F.least(F.count(F.lit(1)).over(Window.partitionBy(*SEEKER)), F.lit(MOST_SHARED)))
        bar = best.filter(F.col("_rank") == k).select("session_id", F.col("score").alias("_score"), F.col("place").alias("_place"))
        most = _related_score(F.col("most"))
        beaten = (F.col("_score") > most) | ((F.col("_score") == most) & (F.col("_place") <= F.col("last")))
        unsure = written_once(
            left_out.filter(F.col("most") > size).join(_of_sessions(bar), "session_id", "left").filter(~F.coalesce(beaten, F.lit(False))).select(*SEEKER, "set_key", "most"),
            "related-unsure",
        )
        if size == 1:
            # A case no session can do without has several tokens of which the same session is unsure.
            further = only_keys(level, unsure, of_set).select("case_id", F.col("token").alias("_token"), F.col("df").alias("_df"))
        after = (F.col("_df") > F.col("df")) | ((F.col("_df") == F.col("df")) & (F.col("_token") > F.col("token")))
        level = written_once(
            only_keys(level, unsure, of_set).join(further, "case_id").filter(after).select(
                "case_id", *CLASS, "place", F.col("set_key").alias("prefix"), F.col("_token").alias("token"), F.col("_df").alias("df"),
                F.concat_ws(" ", "set_key", "_token").alias("set_key"),
            ),
            "related-sets",
        )
        if level.isEmpty():
            break
        steps = level.select("prefix", "token", *of_set).distinct()
        grown = unsure.withColumnRenamed("set_key", "prefix").join(steps, ["prefix", *CLASS])
        held = only_keys(grown, sought, ["session_id", "kind", "token"]).select(*SEEKER, "set_key", "most")
    return best.drop("_rank")


def _related_matches(profiled: DataFrame, tokens: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """The ``k`` best related records of each session, with their scores."""
    # Cases with the same tokens score alike, however many they are.
    related = top_k(_related_cases(cases).withColumn("_same", F.array_sort("identity")), ["_same", *CLASS], deadline_order(), k)
    related = global_position(related.drop("_same"), [kind_rank(F.col("kind")), *deadline_order()], "place")
    kinds = F.when(F.col("goal") == "government_redress", F.array(F.lit(AGENCY))).when(
        F.col("goal") == "watch_cases", F.array(F.lit(DOCKET))
    ).otherwise(F.array(F.lit(AGENCY), F.lit(DOCKET)))
    seekers = profiled.filter(F.col("goal_explicit") & (F.col("goal") != "open_claims")).select("session_id", "goal")
    # Sessions of one goal that hold the same tokens of cases share one search, that of the least of them.
    held = only_keys(tokens.select("session_id", "token"), related.select(F.explode("identity").alias("token")), ["token"])
    wishes = written_once(
        held.join(_of_sessions(seekers), "session_id").groupBy("session_id", "goal").agg(F.array_sort(F.collect_set("token")).alias("tokens")), "related-wishes"
    )
    asks = wishes.groupBy("goal", "tokens").agg(F.min("session_id").alias("ask"))
    sought = written_once(
        asks.select(F.col("ask").alias("session_id"), "tokens", F.explode(kinds).alias("kind")).withColumn("token", F.explode("tokens")).drop("tokens"),
        "related-tokens",
    )
    # Tokens that no session asks for are left out, so that sets are built over few tokens of a case.
    postings = only_keys(related.withColumn("token", F.explode("identity")).drop("identity"), sought, ["kind", "token"])
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    best = _best_related(sought, written_once(postings.join(frequency, "token"), "related-postings"), k)
    members = wishes.join(asks, ["goal", "tokens"]).select("session_id", "ask")
    return best.withColumnRenamed("session_id", "ask").join(members, "ask").select("session_id", "case_id", "score", "kind", "deadline")


# ---- ranking ----


@dataclass(frozen=True)
class MatchInputs:
    """Cases and sessions made ready once for ranking and explaining."""

    cases: DataFrame
    profiled: DataFrame
    hits: DataFrame
    tokens: DataFrame


def prepare(cases: DataFrame, sessions: DataFrame, texts: DataFrame, tokens: DataFrame) -> MatchInputs:
    """Write the tables that ranking reads several times.

    ``cases`` has the FINDER_CASE columns with ``id`` renamed to ``case_id``; ``sessions`` has
    session_id, goal, goal_explicit, experiences, location and proof; ``texts`` and ``tokens`` are the
    keyword tables.
    """
    # Spread by case first: the files of a catalog may be few, and normalizing its texts is most of the work on them.
    made = {"_alias_keys": _alias_keys(cases), "_identity": _identity()}
    cases = written_once(cases.repartition("case_id").withColumns(made), "match-cases")
    return MatchInputs(
        cases,
        written_once(_profiles(sessions, texts, tokens), "match-profiles"),
        written_once(alias_hits(texts, cases), "match-aliases"),
        tokens,
    )


def rank_cases(inputs: MatchInputs, k: int = 3) -> DataFrame:
    """The best ``k`` cases of each session: session_id, rank, case_id, score, kind, signal, layer.

    A session without any specific wish has no rows.
    """
    k = max(1, k)
    claims = _claim_matches(inputs.profiled, inputs.hits, inputs.cases, k)
    related = _related_matches(inputs.profiled, inputs.tokens, inputs.cases, k)
    best = _best(claims.unionByName(related), ["session_id"], k, "rank")
    signal = F.lit(BROAD)
    for floor, label in reversed(BANDS):
        signal = F.when(F.col("score") >= floor, label).otherwise(signal)
    return best.select(
        "session_id", "rank", "case_id", "score", "kind", signal.alias("signal"),
        F.when(F.col("kind") == CLAIM, "open_claim").otherwise("related_source").alias("layer"),
    )


def explain_matches(ranked: DataFrame, inputs: MatchInputs) -> DataFrame:
    """Add ``reasons`` (at most five) and ``questions`` (at most two) to ranked matches."""
    ranked, cases, tokens = written_once(ranked, "match-ranked"), inputs.cases, inputs.tokens
    detail = (
        ranked.join(cases.drop("kind", "signal"), "case_id")
        .join(_of_sessions(inputs.profiled.drop("profile").withColumnRenamed("proof", "proof_wanted")), "session_id")
    )
    alias = (
        ranked.select("session_id", "case_id").join(cases.select("case_id", "kind", "aliases", "_alias_keys"), "case_id")
        .filter(F.col("kind") == CLAIM)
        .select("session_id", "case_id", F.posexplode(F.arrays_zip("aliases", "_alias_keys")).alias("_at", "_a"))
        .select("session_id", "case_id", "_at", F.col("_a.aliases").alias("alias"), F.col("_a._alias_keys").alias("alias_key"))
        .join(_of_sessions(inputs.hits), ["session_id", "alias_key"])
        .groupBy("session_id", "case_id").agg(F.min_by("alias", "_at").alias("alias"))
    )
    shared = (
        ranked.filter(F.col("kind").isin(AGENCY, DOCKET)).select("session_id", "case_id")
        .join(_related_cases(cases).select("case_id", F.explode("identity").alias("token")), "case_id")
        .join(_of_sessions(tokens), ["session_id", "token"])
        .groupBy("session_id", "case_id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "token"))), 1, 3).alias("_shared"))
    )
    rows = detail.join(_of_sessions(alias), ["session_id", "case_id"], "left").join(_of_sessions(shared), ["session_id", "case_id"], "left")
    is_claim = F.col("kind") == CLAIM
    issues = F.slice(F.array_intersect("experiences", "issue_types"), 1, 2)
    labels = F.create_map(*[F.lit(x) for pair in ISSUE_LABELS.items() for x in pair])
    in_span = F.col("covered_start").isNotNull() & F.col("covered_end").isNotNull() & (F.size("years") > 0)
    wanted = F.col("proof_wanted")
    kind_reason = F.create_map(*[F.lit(x) for pair in KIND_REASONS.items() for x in pair])[F.col("kind")]
    reasons = F.array(
        kind_reason,
        F.when(~is_claim, F.concat(F.lit("Company or case name mentions "), F.array_join(F.transform("_shared", lambda s: s["token"]), ", "))),
        F.when(is_claim & F.col("alias").isNotNull(), F.concat(F.lit("Company or product matches "), F.col("alias"))),
        F.when(is_claim & (F.size(issues) > 0), F.concat(F.lit("Connected to "), F.array_join(F.transform(issues, lambda i: labels[i]), " and "))),
        F.when(is_claim & (F.col("location") != "") & F.col("eligible_states").isNotNull(), F.concat(F.lit("The reviewed class definition includes "), F.col("location"))),
        F.when(is_claim & in_span, F.lit("The year overlaps the reviewed covered period")),
        F.when(is_claim & (wanted != "Any") & (F.col("proof") == wanted), F.concat(F.lit("Source summary says: "), F.lower("proof")))
        .when(is_claim & (wanted == NOTICE) & F.col("notice_required"), F.lit("The reviewed class definition mentions a notice")),
    )
    return rows.select(
        *ranked.columns,
        F.slice(F.array_distinct(F.array_compact(reasons)), 1, 5).alias("reasons"),
        follow_up_questions().alias("questions"),
    )


def follow_up_questions() -> Column:
    """At most two questions for a match, over joined case and preference columns."""
    claim = F.col("kind") == CLAIM
    asked = F.array(
        F.when(
            claim & F.col("has_criteria") & (F.col("location") == "") & F.col("eligible_states").isNotNull(),
            F.concat(F.lit("Were you in "), F.array_join("eligible_states", " or "), F.lit(" during the covered period?")),
        ),
        F.when(claim & F.col("has_criteria") & (F.size("years") == 0) & F.col("covered_start").isNotNull(), F.lit("Did this happen during the official covered dates?")),
        F.when(
            claim & F.col("has_criteria") & F.col("notice_required") & (F.col("proof_wanted") != NOTICE),
            F.lit("Did you receive the notice described by the official settlement site?"),
        ),
        F.when(claim, F.lit("Does the official class definition apply to you?")),
        F.when(F.col("kind") == AGENCY, F.lit("Does the agency page provide instructions for you, or is distribution automatic?")),
        F.when(F.col("kind") == DOCKET, F.lit("Has the court later certified a class or opened any participation process?")),
        F.when(F.col("proof") == NOT_STATED, F.lit("What records or notice does the official source require?")),
    )
    return F.slice(F.array_distinct(F.array_compact(asked)), 1, 2)


# ---- questionnaire ----


def coerce_situations(situations: Column) -> Column:
    """``not_sure`` excludes every other situation."""
    return F.when(F.array_contains(situations, "not_sure"), F.array(F.lit("not_sure"))).otherwise(
        F.array_distinct(situations)
    )


def situation_candidates(cases: DataFrame, as_of: Column) -> DataFrame:
    """(situation, case_id, deadline) of reviewed open claims; ``not_sure`` admits all of them."""
    return _prompts(cases.filter(is_reviewed_open(as_of)).select("case_id", "deadline", "situations"))


def _admitting(situations: Column) -> Column:
    """What a session may have chosen to be prompted with a case of these situations."""
    return F.array_union(situations, F.array(F.lit("not_sure")))


def _prompts(offered: DataFrame) -> DataFrame:
    return offered.withColumn("situation", F.explode(_admitting(F.col("situations")))).select("situation", *[c for c in offered.columns if c != "situations"])


def _choices(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", F.array_sort(coerce_situations(F.col("situations"))).alias("chosen"))


def _recognized_prompts(prompts: DataFrame, chosen: DataFrame, recognized: DataFrame) -> DataFrame:
    """The prompted ones of the cases that a session recognized: session_id and the columns of a prompt's case."""
    marked = recognized.select("session_id", "case_id").distinct().join(chosen, "session_id")
    admitted = marked.select("session_id", "case_id", F.explode("chosen").alias("situation")).join(prompts, ["situation", "case_id"])
    return admitted.select("session_id", *[c for c in prompts.columns if c != "situation"]).distinct()


def candidate_lists(
    cases: DataFrame, sessions: DataFrame, recognized: DataFrame, as_of: Column, block: int = 1 << 16
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All prompted cases of all sessions in deadline order, without a cap, as three tables.

    (chosen, rank, case_id, deadline): the list of each distinct choice of situations; (session_id, chosen): whose list it
    is, for sessions that recognized no case; (session_id, rank, case_id, deadline): the others' recognized cases. The open
    cases are placed in one order first, and lists are numbered by ``block`` places at a time, so that no day of deadlines, nor the
    cases without one, is one task's work; no session is multiplied by the catalog.
    """
    offers = cases.filter(is_reviewed_open(as_of)).select("case_id", "deadline", "situations")
    placed, chosen = global_position(offers, deadline_order(), "_place"), _choices(sessions)
    prompts, choices = _prompts(placed), without_keys(chosen, recognized, ["session_id"])
    # Distinct choices are sets of the questionnaire's few situations. They go to the cases: the other way round, a situation's cases, or all of
    # them, are one task's work, as Spark sends the cases to the choices while it takes their file for small.
    wanted = F.broadcast(choices.select("chosen").distinct().select("chosen", F.explode("chosen").alias("situation")))
    # A case stands in a list once, for the first of its situations that were chosen.
    placed = _prompts(placed.withColumn("_every", _admitting(F.col("situations"))))
    offered = placed.join(wanted, "situation").filter(F.array_intersect("chosen", "_every")[0] == F.col("situation")).drop("situation", "_every")
    numbered = lambda rows, key: running_position(rows, [key], [F.col("_place")], F.floor(F.col("_place") / block), "rank").drop("_place")
    return numbered(offered, "chosen"), choices, numbered(_recognized_prompts(prompts, chosen, recognized), "session_id")


def session_candidates(
    cases: DataFrame, sessions: DataFrame, recognized: DataFrame, as_of: Column, size: int
) -> DataFrame:
    """(session_id, rank, case_id, deadline): the first ``size`` prompted cases of each session in deadline order.

    ``sessions`` has session_id and situations. A session that recognized cases is shown only those. The others
    share one page for each distinct choice of situations, so no session meets the whole catalog. ``candidate_lists``
    has all cases.
    """
    prompts, chosen = situation_candidates(cases, as_of), _choices(sessions)
    choices = chosen.select("chosen").distinct().select("chosen", F.explode("chosen").alias("situation"))
    # A case stands in a page once, whichever of its situations were chosen.
    first = top_k(prompts, ["situation"], deadline_order(), size)
    offered = choices.join(first, "situation").select("chosen", "case_id", "deadline").distinct()
    pages = top_k(offered, ["chosen"], deadline_order(), size, "rank")
    shared = without_keys(chosen, recognized, ["session_id"]).join(pages, "chosen")
    own = top_k(_recognized_prompts(prompts, chosen, recognized), ["session_id"], deadline_order(), size, "rank")
    columns = ["session_id", "rank", "case_id", "deadline"]
    return shared.select(*columns).unionByName(own.select(*columns))


def screen_claims(
    cases: DataFrame, sessions: DataFrame, answers: DataFrame, recognized: DataFrame, as_of: Column
) -> DataFrame:
    """Screened claims of each session, without a cap.

    ``answers`` has one (session_id, case_id, answer) for each answered case, ``recognized`` the cases a
    session recognized from the prompted list. Only answered cases are joined, so the work grows
    with the answers.
    """
    told = answers.filter(F.col("answer").isin("yes", "unsure"))
    marked = recognized.select("session_id", "case_id").distinct().withColumn("recognized", F.lit(True))
    any_marked = recognized.select("session_id").distinct().withColumn("_has", F.lit(True))
    situations = sessions.select("session_id", coerce_situations(F.col("situations")).alias("chosen"))
    rows = (
        told.join(cases.filter(is_reviewed_open(as_of)), "case_id")
        .join(situations, "session_id")
        .join(marked, ["session_id", "case_id"], "left")
        .join(any_marked, "session_id", "left")
        .withColumn("recognized", F.coalesce("recognized", F.lit(False)))
    )
    prompted = F.array_contains("chosen", "not_sure") | F.arrays_overlap("chosen", "situations")
    admitted = rows.filter(prompted & (F.col("_has").isNull() | F.col("recognized")))
    yes = F.col("answer") == "yes"
    labels = F.create_map(*[F.lit(x) for pair in SITUATION_LABELS.items() for x in pair])
    why = (
        F.when(F.col("recognized"), F.concat(F.lit("You recognized "), F.col("recognition_label"), F.lit(" from the prompted list")))
        .when(F.arrays_overlap("chosen", "situations"), F.concat(F.lit("You selected: "), F.array_join(F.transform(F.array_intersect("situations", "chosen"), lambda s: labels[s]), "; ")))
        .otherwise("You asked to review every prompted possibility")
    )
    return admitted.select(
        "session_id", "case_id", "kind", "deadline", "answer", "recognized",
        (F.when(yes, 100).otherwise(50) + F.when(F.col("recognized"), 20).otherwise(0)).alias("score"),
        F.when(yes, "Worth reviewing").otherwise("Needs confirmation").alias("signal"),
        F.array(why, F.when(yes, ANSWERED["yes"]).otherwise(ANSWERED["unsure"])).alias("reasons"),
        F.when(yes, F.array(*[F.lit(q) for q in CONFIRM["yes"]])).otherwise(F.array(*[F.lit(q) for q in CONFIRM["unsure"]])).alias("questions"),
    )
