"""Free text to finder preferences: goal, issues, keywords, place, proof, and the sensitive-text gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlens.functions.text import WHITESPACE, WORD_END, WORD_START, bind, matches_any, strip, words
from docketlens.functions.wording import first_match

# Word lists, state names and patterns, in deciding order.
STOP_WORDS = [
    "a", "about", "an", "and", "are", "case", "cases", "claim", "claims", "connected", "do", "find", "for",
    "from", "had", "have", "i", "in", "is", "me", "my", "of", "on", "or", "please", "relevant", "show",
    "that", "the", "to", "used", "want", "what", "which", "with",
]
GENERIC_WORDS = [
    "act", "action", "now", "received", "notice", "documents", "needed", "need", "everything", "government",
    "refund", "redress", "lawsuit", "watch", "open", "settlement", "data", "breach",
]
GENERIC_IDENTITY_WORDS = [
    "action", "bank", "case", "class", "company", "complaint", "consumer", "corp", "corporation", "federal",
    "group", "inc", "lawsuit", "llc", "privacy", "service", "services", "settlement",
]
STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california",
    "CO": "colorado", "CT": "connecticut", "DE": "delaware", "DC": "district of columbia",
    "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois",
    "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine",
    "MD": "maryland", "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi",
    "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada", "NH": "new hampshire",
    "NJ": "new jersey", "NM": "new mexico", "NY": "new york", "NC": "north carolina",
    "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania",
    "RI": "rhode island", "SC": "south carolina", "SD": "south dakota", "TN": "tennessee",
    "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia", "WA": "washington",
    "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming",
}
STATE_NAMES = sorted(STATES.values())
ISSUES = [
    ("consumer", "consumer|product|purchase|retail|subscription|service|fee|advertis|marketing|customer"),
    ("privacy", "privacy|data breach|breach|tracking|pixel|biometric|hack|security incident|personal information"),
    ("communications", "email|text message|sms|phone call|telemarket|commercial message|communication"),
    ("employment", "employ|worker|workplace|wage|salary|hiring|job|labor|gig work|overtime|discrimination"),
    ("healthcare", "health|medical|patient|hospital|clinic|therapy|provider|hipaa"),
    ("finance", "bank|credit|debit|loan|mortgage|securit|broker|invest|payment app|financial|interest rate"),
]
GOALS = [
    ("government_redress", "government|agency|ftc|cfpb|sec|official refund|redress"),
    ("watch_cases", "watch|track|lawsuit|docket|proposed case|pending case"),
    ("explore", "every catalog|everything|all source|mix of"),
    ("open_claims", "act on|file|claim form|open claim|deadline|submit"),
]
NO_PROOF = "no (?:receipt|receipts|proof|document|documents)|without (?:proof|receipts|documents)"
DENIES_NOTICE = (
    words(rf"(?:no|never|did not|didn't){WHITESPACE}+(?:receive[A-Za-z0-9_]*{WHITESPACE}+)?(?:a{WHITESPACE}+)?notice")
)
MENTIONS_NOTICE = "notice|claim id|notice id|confirmation"
MENTIONS_RECORDS = "receipt|record|invoice|statement"
YEAR = words(r"(?:19|20)\d{2}")

_SEP = rf"(?:{WHITESPACE}|[.-])?"
SENSITIVE = [
    ("email address", rf"(?i){WORD_START}(?=[A-Za-z0-9_])[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[a-z]{{2,}}{WORD_END}"),
    ("Social Security information", words(r"\d{3}-\d{2}-\d{4}") + "|(?i:social security|" + words("ssn") + ")"),
    ("phone number", rf"(?:\+?1{_SEP})?(?:\(?\d{{3}}\)?{_SEP})\d{{3}}{_SEP}\d{{4}}{WORD_END}"),
    ("payment-card-like number", words(r"\d(?:[ -]*\d){12,18}")),
    ("private identifier",
     rf"(?i){WORD_START}(?:claim|notice|confirmation|account|routing|tax){WHITESPACE}*(?:number|no|id){WORD_END}"),
    ("private number", words(r"\d{5,12}")),
    ("account credential", "(?i)" + words("password|passcode|bank credentials?")),
    ("street address",
     rf"(?i){WORD_START}\d{{1,6}}{WHITESPACE}+[a-z0-9 .'-]{{2,40}}{WHITESPACE}"
     rf"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr){WORD_END}"),
    ("sensitive personal detail",
     "(?i)" + words("my diagnosis|medical record|patient id|information about my child|minor's information")),
]


def normalize(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def tokenize(value: Column) -> Column:
    """Tokens of two or more characters without stop words and generic words, duplicates kept."""
    ignored = [*STOP_WORDS, *GENERIC_WORDS]
    return F.filter(
        F.split(normalize(value), " "), lambda t: (F.length(t) >= 2) & ~t.isin(ignored)
    )


def identity_tokens(value: Column) -> Column:
    """Distinct tokens of a company or title that can identify it."""
    ignored = F.array(*[F.lit(w) for w in GENERIC_IDENTITY_WORDS])
    return F.array_except(F.split(normalize(value), " "), F.array_union(ignored, F.array(F.lit(""))))


def normalize_location(value: Column) -> Column:
    """A state abbreviation becomes its name; other text is normalized."""
    code = F.upper(strip(value))
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), normalize(strip(value)))


def location_of(message: Column) -> Column:
    """The first state name in list order, else the first upper-case abbreviation, else empty."""
    # A lookahead finds names inside longer names too (virginia in west virginia).
    names = "|".join(n.replace(" ", WHITESPACE + "+") for n in STATE_NAMES)
    found = F.regexp_extract_all(
        F.lower(message), F.lit(f"{WORD_START}(?=({names}){WORD_END})"), F.lit(1)
    )
    listed = F.array(*[F.lit(n) for n in STATE_NAMES])
    first = F.array_min(
        F.transform(found, lambda n: F.array_position(listed, F.regexp_replace(n, WHITESPACE + "+", " ")))
    )
    codes = F.regexp_extract_all(message, F.lit(words("[A-Z]{2}")), F.lit(0))
    known = F.filter(codes, lambda c: c.isin(list(STATES)))
    by_code = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(
        F.get(listed, (first - 1).cast("int")), F.try_element_at(by_code, F.get(known, F.lit(0))), F.lit("")
    )


def goal_of(message: Column) -> Column:
    return first_match(F.lower(message), GOALS, None)


def proof_of(message: Column) -> Column:
    def judge(text: Column) -> Column:
        return (
            F.when(matches_any(text, NO_PROOF), "No documents stated")
            .when(matches_any(text, MENTIONS_NOTICE) & ~text.rlike(DENIES_NOTICE), "Notice or ID")
            .when(matches_any(text, MENTIONS_RECORDS), "Records may be requested")
        )

    return bind(F.lower(message), judge)


def issues_of(message: Column) -> Column:
    def judge(text: Column) -> Column:
        return F.array_compact(F.array(*[F.when(matches_any(text, p), F.lit(name)) for name, p in ISSUES]))

    return bind(F.lower(message), judge)


def years_of(value: Column) -> Column:
    return F.transform(
        F.array_distinct(F.regexp_extract_all(value, F.lit(YEAR), F.lit(0))), lambda y: y.cast("int")
    )


# What a text must hold before the pattern of the reason is worth trying, in lower case.
SENSITIVE_WORDS = {
    "email address": ["@"],
    "private identifier": ["claim", "notice", "confirmation", "account", "routing", "tax"],
    "account credential": ["password", "passcode", "bank credential"],
    "sensitive personal detail": [
        "my diagnosis", "medical record", "patient id", "information about my child", "minor's information",
    ],
}
SENSITIVE_DIGITS = ["phone number", "payment-card-like number", "private number", "street address"]


def sensitive_reason(value: Column) -> Column:
    """The first reason a text must not be kept, else null. Literal lookups guard the wide patterns."""

    def judge(v: Column) -> Column:
        chain = None
        for name, pattern in SENSITIVE:
            hit = v["text"].rlike(pattern)
            if name in SENSITIVE_DIGITS:
                hit = v["digits"] & hit
            elif name in SENSITIVE_WORDS:
                held = F.lit(False)
                for word in SENSITIVE_WORDS[name]:
                    held = held | v["lower"].contains(word)
                hit = held & hit
            else:
                hit = (v["digits"] | v["lower"].contains("ssn") | v["lower"].contains("social security")) & hit
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain

    parts = F.struct(value.alias("text"), F.lower(value).alias("lower"), value.rlike("[0-9]").alias("digits"))
    return bind(parts, judge)


def parse_message(message: Column) -> dict[str, Column]:
    """Columns of the preferences stated in one message; what is not stated is null or empty."""
    return {
        "goal": goal_of(message),
        "experiences": issues_of(message),
        "keywords": F.array_distinct(tokenize(message)),
        "location": location_of(message),
        "proof": proof_of(message),
        "years": years_of(message),
    }
