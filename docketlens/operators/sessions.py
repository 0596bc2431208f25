"""Folding the messages of a session into finder preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.functions.finder import ISSUES, parse_message, sensitive_reason
from docketlens.operators.keyed import computed_once, keep_first, running_position


def message_preferences(messages: DataFrame, text: str = "text") -> DataFrame:
    """Preferences stated in each message, and why a message must be rejected, if so."""
    message = F.col(text)
    return computed_once(messages, **parse_message(message), sensitive=sensitive_reason(message))


def session_preferences(parsed: DataFrame, session: str, turn: str) -> DataFrame:
    """One row for each session: the last stated goal, place and proof, and all issues in order.

    Rejected messages take no part. All aggregates are partial; a session holds at most one issue
    row for each known issue.
    """
    kept = parsed.filter(F.col("sensitive").isNull())
    at = F.col(turn)
    stated = kept.groupBy(session).agg(
        F.max_by("goal", F.when(F.col("goal").isNotNull(), at)).alias("_goal"),
        F.max_by("location", F.when(F.col("location") != "", at)).alias("location"),
        F.max_by("proof", F.when(F.col("proof").isNotNull(), at)).alias("proof"),
    )
    names = F.array(*[F.lit(name) for name, _ in ISSUES])
    issue = (
        kept.select(session, at.alias("_turn"), F.explode("experiences").alias("issue"))
        .groupBy(session, "issue").agg(F.min("_turn").alias("_turn"))
        .groupBy(session)
        .agg(F.array_sort(F.collect_list(F.struct("_turn", F.array_position(names, F.col("issue")).alias("_i"), "issue"))).alias("_e"))
    )
    return stated.join(issue, session, "left").select(
        session,
        F.coalesce("_goal", F.lit("open_claims")).alias("goal"),
        F.col("_goal").isNotNull().alias("goal_explicit"),
        F.coalesce(F.transform("_e", lambda e: e["issue"]), F.expr("array()").cast("array<string>")).alias("experiences"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("proof", F.lit("Any")).alias("proof"),
    )


def session_keywords(parsed: DataFrame, session: str, turn: str) -> DataFrame:
    """Distinct keyword tokens of each session with their 1-based position, as rows.

    Positions are counted turn by turn, so one very long session is spread over its turns.
    """
    kept = parsed.filter(F.col("sensitive").isNull())
    tokens = kept.select(session, F.col(turn).alias("_turn"), F.posexplode("keywords").alias("_at", "token"))
    first = keep_first(tokens, [session, "token"], [F.col("_turn"), F.col("_at")])
    return running_position(first, [session], [F.col("_turn"), F.col("_at")], F.col("_turn"), "position").select(
        session, "token", "position"
    )
