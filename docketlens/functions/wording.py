"""Classifiers over free wording: ordered patterns, the first match decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlens.functions.text import WHITESPACE, bind, clean_text, matches_any, words

# Label and pattern in deciding order, over lower-cased clean text.
SETTLEMENT_CATEGORIES = [
    ("Privacy and data",
     "data breach|cyber|privacy|biometric|tracking pixel|personal information|security incident"),
    ("Employment", "employee|employment|worker|wage|overtime|payroll|labor"),
    ("Healthcare", "patient|hospital|health|medical|drug|pharma|prescription|dental"),
    ("Finance and insurance", "bank|credit|loan|mortgage|interest|insurance|financial|debit"),
    ("Automotive", "vehicle|automotive|" + words("auto") + "|" + words("car") + "|truck|dealership"),
    ("Telecommunications", "wireless|telephone|telecom|text message|phone call"),
]
DOCKET_CATEGORIES = [
    ("Employment", "employ|labor|wage|civil rights.*employment"),
    ("Healthcare", "health|medical|hospital"),
    ("Privacy and data", "privacy|personal property|copyright|patent|trademark"),
    ("Consumer", "securities|bank|credit|fraud|truth-in-lending|contract|consumer"),
]
PARTICIPATION_MODES = [
    ("automatic_distribution",
     "no action (?:is )?needed|automatically (?:receive|receiving|sent|distributed)"
     "|do not need to (?:apply|file|submit)"),
    ("agency_invitation_only",
     "only (?:people|consumers|investors) (?:who are )?(?:contacted|invited)"
     "|if you (?:receive|received) (?:an? )?(?:notice|invitation|letter)|agency invitation"),
]
WINDOW_STATUSES = [
    ("closed", "no longer accepting (?:claims|forms)|claim (?:window|period) (?:has )?closed"),
    ("open", "accepting claims|claim (?:form|window) is open|submit (?:a )?claim by"),
]
PROOF_ANSWERS = [("yes", "^yes(?![A-Za-z0-9_])"), ("no", "^no(?![A-Za-z0-9_])")]


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The label of the first rule whose pattern occurs in ``text``, which is evaluated once."""

    def judge(bound: Column) -> Column:
        chain = None
        for label, pattern in rules:
            hit = matches_any(bound, pattern)
            chain = F.when(hit, label) if chain is None else chain.when(hit, label)
        return chain.otherwise(F.lit(otherwise))

    return bind(text, judge)


def settlement_category(*values: Column) -> Column:
    joined = F.concat_ws(" ", *[F.coalesce(v, F.lit("")) for v in values])
    return first_match(F.lower(clean_text(joined)), SETTLEMENT_CATEGORIES, "Consumer")


def docket_category(cause: Column, suit_nature: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(cause, F.lit("")), F.lit(" "), F.coalesce(suit_nature, F.lit(""))))
    return first_match(text, DOCKET_CATEGORIES, "Federal court cases")


def participation_mode(wording: Column) -> Column:
    return first_match(F.lower(clean_text(wording)), PARTICIPATION_MODES, "unknown")


def window_status(wording: Column, mode: Column) -> Column:
    stated = first_match(F.lower(clean_text(wording)), WINDOW_STATUSES, None)
    return F.coalesce(stated, F.when(mode == "automatic_distribution", "not_applicable").otherwise("unknown"))


def proof_answer(value: Column) -> Column:
    return first_match(F.lower(clean_text(value)), PROOF_ANSWERS, "unknown")


def dollar_amounts(text: Column) -> Column:
    """Array of (raw, value) for each distinct ``$`` amount, in order of appearance."""
    found = F.regexp_extract_all(clean_text(text), F.lit(r"\$\s*[0-9][0-9,]*(?:\.\d{1,2})?"), F.lit(0))
    raw = F.array_distinct(F.transform(found, lambda a: F.regexp_replace(a, WHITESPACE + "+", "")))
    return F.transform(
        raw,
        lambda a: F.struct(
            a.alias("raw"),
            F.regexp_replace(a, r"[$,]", "").try_cast("double").alias("value"),
        ),
    )
