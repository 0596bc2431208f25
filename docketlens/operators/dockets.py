"""Docket hits: classification, normalization, in-batch dedupe and the sticky merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.dates import iso_date
from docketlens.functions.text import WHITESPACE, bind, clean_text, null_if_blank, words
from docketlens.functions.urls import pinned_url
from docketlens.operators.keyed import computed_once, keep_first, only_keys, without_keys

# Fixed values of the docket source.
ORIGIN = "https://www.courtlistener.com"
MAX_SAFE_ID = 2**53 - 1
HEADER_LENGTH = 600
# Characters that nearly always hold the header; where they do not, the whole text is cleaned.
HEADER_REACH = 4000
TERMINATED_CAVEAT = "CourtListener reports a PACER termination date."
NOT_TERMINATED_CAVEAT = "No termination date was returned; this does not prove the matter remains active."

_W = f"{WHITESPACE}+"
# The boundary is looked at behind the word, so that a text is searched for the word itself.
COMPLAINT_ANYWHERE = rf"(?i)class(?<![A-Za-z0-9_]class){_W}(?:and{_W}collective{_W})?action{_W}complaint(?![A-Za-z0-9_])"
ATTACHMENTS = r"(?i)\(?(?<![A-Za-z0-9_])attachments?\s*:"
OPENS_AS_COMPLAINT = (
    rf"(?i)^{WHITESPACE}*(?:(?:first|second|third|fourth){_W})?(?:amended{_W})?complaint(?![A-Za-z0-9_])"
)
MENTIONS_CLASS = "(?i)" + words(
    r"class\s+action|class\s+and\s+collective|collective\s+and(?:\s+r\.?\s*23)?\s+class\s+action"
)

SEMANTIC = [
    "case_name", "docket_number", "docket_url", "court", "court_id", "date_filed", "date_terminated",
    "termination_state", "active", "active_status_caveat", "cause", "suit_nature",
]
LIFECYCLE = ["first_seen_at", "last_seen_at", "last_changed_at", "freshness"]
FILING = [
    "document_id", "docket_entry_id", "document_number", "entry_date_filed", "description",
    "document_type", "available_in_recap", "url",
]
DIGEST = "filings_digest"
FILING_KEY = ["docket_id", "document_id", "docket_entry_id"]


def is_class_complaint(description: Column) -> Column:
    """A class complaint phrase anywhere, or a header that opens as a complaint and mentions a class.

    The patterns read the text as it is, with white space of any kind and length between words; only the header of a text that opens
    as a complaint is cleaned.
    """
    text = F.coalesce(description.cast("string"), F.lit(""))

    def header_fits(reach: Column) -> Column:
        # A header, and any mark that ends it, lies within what is a hundred characters longer.
        cleaned = F.when(F.length(reach) >= HEADER_LENGTH + 100, reach).otherwise(clean_text(text))
        header = F.substring(F.element_at(F.split(cleaned, ATTACHMENTS, 2), 1), 1, HEADER_LENGTH)
        return header.rlike(MENTIONS_CLASS)

    return text.rlike(COMPLAINT_ANYWHERE) | (text.rlike(OPENS_AS_COMPLAINT) & bind(clean_text(F.substring(text, 1, HEADER_REACH)), header_fits))


def filing_sort_key(filing: Column) -> Column:
    return F.struct(
        F.coalesce(filing["entry_date_filed"], F.lit("")),
        F.coalesce(filing["document_number"].cast("string"), F.lit("")),
        F.coalesce(filing["document_id"], F.lit("")),
    )


def _filing(document: Column, fallback: Column) -> Column:
    return F.struct(
        document["id"].cast("string").alias("document_id"),
        document["docket_entry_id"].cast("string").alias("docket_entry_id"),
        document["document_number"].alias("document_number"),
        iso_date(document["entry_date_filed"]).cast("string").alias("entry_date_filed"),
        null_if_blank(clean_text(document["description"])).alias("description"),
        null_if_blank(clean_text(document["document_type"])).alias("document_type"),
        F.coalesce(document["is_available"], F.lit(False)).alias("available_in_recap"),
        pinned_url(document["absolute_url"], fallback, ORIGIN).alias("url"),
    )


def _distinct_filings(filings: Column) -> Column:
    key = lambda f: F.struct(f["document_id"], f["docket_entry_id"])

    def firsts(b: Column) -> Column:
        first = F.filter(b["filings"], lambda f, at: F.array_position(b["keys"], key(f)) == at + 1)
        keyed = F.transform(first, lambda f: F.struct(filing_sort_key(f).alias("k"), f.alias("f")))
        return F.transform(F.array_sort(keyed), lambda e: e["f"])

    with_keys = lambda fs: F.struct(fs.alias("filings"), F.transform(fs, key).alias("keys"))
    return bind(filings, lambda fs: F.when(F.size(fs) < 2, fs).otherwise(bind(with_keys(fs), firsts)))


def normalize_hits(hits: DataFrame, observed_at: str) -> DataFrame:
    """Docket records with their matched filings; hits without a usable id or a match are dropped."""
    text = lambda name: null_if_blank(clean_text(F.col(name)))
    matched = F.filter("recap_documents", lambda d: is_class_complaint(d["description"]))
    path = F.concat(F.lit("/docket/"), F.col("docket_id").cast("string"), F.lit("/"))
    accepted = (
        hits.filter((F.col("docket_id") > 0) & (F.col("docket_id") <= MAX_SAFE_ID))
        .transform(lambda df: computed_once(df, _matched=matched))
        .filter(F.size("_matched") > 0)
    )
    terminated = iso_date(F.col("dateTerminated"))
    ended = terminated.isNotNull()
    carried = [c for c in ("hit_order",) if c in hits.columns]
    return accepted.select(
        "docket_id",
        F.coalesce(text("caseName"), F.lit("Unnamed federal matter")).alias("case_name"),
        text("docketNumber").alias("docket_number"),
        pinned_url(F.col("docket_absolute_url"), path, ORIGIN).alias("docket_url"),
        text("court").alias("court"),
        text("court_id").alias("court_id"),
        iso_date(F.col("dateFiled")).alias("date_filed"),
        terminated.alias("date_terminated"),
        F.when(ended, "terminated_date_reported").otherwise("termination_not_reported").alias("termination_state"),
        (~ended).alias("active"),
        F.when(ended, TERMINATED_CAVEAT).otherwise(NOT_TERMINATED_CAVEAT).alias("active_status_caveat"),
        text("cause").alias("cause"),
        text("suitNature").alias("suit_nature"),
        _distinct_filings(F.transform("_matched", lambda d: _filing(d, path))).alias("matched_filings"),
        F.lit(observed_at).alias("first_seen_at"),
        F.lit(observed_at).alias("last_seen_at"),
        F.lit(observed_at).alias("last_changed_at"),
        F.lit("current").alias("freshness"),
        *carried,
    )


def filings_of(records: DataFrame, order: str = "hit_order") -> DataFrame:
    """One row for each distinct (docket, document, entry): the first in batch order.

    Filings stay rows rather than one array for a docket, so no docket is ever gathered whole.
    """
    rows = records.select("docket_id", F.col(order).alias("_hit"), F.posexplode("matched_filings").alias("_at", "_f"))
    return keep_first(
        rows.select("docket_id", "_f.*", F.struct("_hit", "_at").alias("_order")),
        FILING_KEY, [F.col("_order")],
    ).drop("_order")


def dedupe_dockets(records: DataFrame, order: str = "hit_order", recompute_active: bool = False) -> DataFrame:
    """One record for each docket in a batch: the later hit wins, a known termination date is kept.

    The termination state stays that of the later hit, so it may disagree with a kept date;
    ``recompute_active`` derives it from the date instead.
    """
    latest = records.groupBy("docket_id").agg(
        F.max_by(F.struct(*SEMANTIC, *LIFECYCLE), F.col(order)).alias("r"),
        F.max_by("date_terminated", F.when(F.col("date_terminated").isNotNull(), F.col(order))).alias("_known"),
    )
    merged = latest.select("docket_id", "r.*", "_known").withColumn(
        "date_terminated", F.coalesce("date_terminated", "_known")
    )
    if recompute_active:
        ended = F.col("date_terminated").isNotNull()
        merged = merged.withColumn("active", ~ended).withColumn(
            "termination_state",
            F.when(ended, "terminated_date_reported").otherwise("termination_not_reported"),
        ).withColumn(
            "active_status_caveat",
            F.when(ended, TERMINATED_CAVEAT).otherwise(NOT_TERMINATED_CAVEAT),
        )
    return merged.drop("_known")


def filings_digest(filings: DataFrame) -> DataFrame:
    """(docket_id, filings_digest) of distinct filing rows: their number and two sums of hashes, the same in any order.

    A partial aggregate, so a docket of any number of filings is one row for each task.
    """
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *FILING).cast("decimal(38,0)")).cast("string")
    digest = F.concat_ws(":", F.count(F.lit(1)).cast("string"), hashed(1), hashed(2))
    return filings.select("docket_id", *FILING).distinct().groupBy("docket_id").agg(digest.alias(DIGEST))


def merge_dockets(
    previous: DataFrame,
    previous_filings: DataFrame,
    observed: DataFrame,
    observed_filings: DataFrame,
    observed_at: str,
    degraded: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Merge a deduplicated batch into the previous records; returns (records, filings).

    Absence never deactivates, a reported termination is sticky, filings are replaced by the
    incoming ones, and in a degraded run unseen records turn stale. Records carry a digest of their filings, so whether these changed is
    known without the previous ones; where previous records have none yet, only filings of observed dockets are read for it.
    """
    if DIGEST not in previous.columns:
        previous = previous.join(filings_digest(only_keys(previous_filings, observed, ["docket_id"])), "docket_id", "left")
    observed = observed.join(filings_digest(observed_filings), "docket_id", "left")
    old = previous.select("docket_id", F.struct(*SEMANTIC, *LIFECYCLE, DIGEST).alias("o"))
    new = observed.select("docket_id", F.struct(*SEMANTIC, *LIFECYCLE, DIGEST).alias("n"))
    joined = old.join(new, "docket_id", "full_outer")
    seen, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    keep_end = F.col("o.date_terminated").isNotNull() & F.col("n.date_terminated").isNull()

    def merged(name: str) -> Column:
        incoming = F.col(f"n.{name}")
        if name == "active":
            incoming = F.when(keep_end, F.lit(False)).otherwise(incoming)
        elif name in ("date_terminated", "termination_state", "active_status_caveat"):
            incoming = F.when(keep_end, F.col(f"o.{name}")).otherwise(incoming)
        return F.when(seen, incoming).otherwise(F.col(f"o.{name}"))

    table = joined.select(
        "docket_id", "o", "n", *[merged(name).alias(name) for name in SEMANTIC],
        (~F.col(f"o.{DIGEST}").eqNullSafe(F.col(f"n.{DIGEST}"))).alias("_filings_differ"),
    )
    same = F.struct(*SEMANTIC).eqNullSafe(F.struct(*[F.col(f"o.{name}").alias(name) for name in SEMANTIC]))
    changed = ~same | F.col("_filings_differ")
    now = F.lit(observed_at)
    unseen_freshness = F.lit("stale") if degraded else F.col("o.freshness")
    records = table.select(
        "docket_id",
        *SEMANTIC,
        F.when(seen & known, F.coalesce("o.first_seen_at", now)).when(seen, F.col("n.first_seen_at"))
        .otherwise(F.col("o.first_seen_at")).alias("first_seen_at"),
        F.when(seen & known, now).when(seen, F.col("n.last_seen_at"))
        .otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(seen & known, F.when(changed, now).otherwise(F.coalesce("o.last_changed_at", now)))
        .when(seen, F.col("n.last_changed_at")).otherwise(F.col("o.last_changed_at")).alias("last_changed_at"),
        F.when(seen & known, F.lit("current")).when(seen, F.col("n.freshness"))
        .otherwise(unseen_freshness).alias("freshness"),
        F.when(seen, F.col(f"n.{DIGEST}")).otherwise(F.col(f"o.{DIGEST}")).alias(DIGEST),
    )
    filings = without_keys(previous_filings, observed, ["docket_id"]).unionByName(observed_filings)
    return records, filings


def retained_count(records: DataFrame, observed: DataFrame) -> DataFrame:
    return without_keys(records, observed, ["docket_id"]).agg(F.count(F.lit(1)).alias("retained_from_previous"))


def docket_order() -> list[Column]:
    """Newest filing first, undated last, then docket id."""
    return [F.col("date_filed").desc_nulls_last(), F.col("docket_id").asc()]


def run_metrics(hits: DataFrame, accepted: DataFrame, previous_totals: DataFrame | None = None) -> DataFrame:
    """Raw and accepted counts of a run, with totals carried over from earlier runs."""

    def counted(raw: Column, accepted: Column, raw_before: Column, accepted_before: Column) -> list[Column]:
        return [raw.alias("raw"), accepted.alias("accepted"), raw_before.alias("raw_b"), accepted_before.alias("accepted_b")]

    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    rows = hits.select(*counted(one, none, none, none)).unionByName(accepted.select(*counted(none, one, none, none)))
    if previous_totals is not None:
        rows = rows.unionByName(previous_totals.select(
            *counted(none, none, F.col("raw_results_seen_total"), F.col("accepted_results_total"))
        ))
    total = lambda *names: sum((F.coalesce(F.sum(n), F.lit(0)) for n in names), F.lit(0)).cast("bigint")
    return rows.agg(
        total("raw").alias("raw_results_seen"), total("accepted").alias("accepted_results"),
        total("raw", "raw_b").alias("raw_results_seen_total"), total("accepted", "accepted_b").alias("accepted_results_total"),
    )
