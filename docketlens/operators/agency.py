"""Agency listing entries to government records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.dates import month_date
from docketlens.functions.text import clean_text, null_if_blank, short_hash, slugify
from docketlens.functions.urls import canonical_url, is_listing_detail, resolve_url, url_path
from docketlens.functions.wording import dollar_amounts, participation_mode, window_status
from docketlens.operators.keyed import computed_once, keep_first


@dataclass(frozen=True)
class ListingSource:
    """A pluggable source. The callables give columns over the elements of its page.

    ``entry`` selects the elements that are entries; of several matching tables the one with the
    smallest ``preference`` and then the earliest is read.
    """

    source_id: str
    agency: str
    agency_code: str
    url: str
    program_status: str
    entry: Callable[[], Column]
    title: Callable[[], Column]
    href: Callable[[], Column]
    summary: Callable[[], Column]
    compensation: Callable[[], Column] = lambda: F.lit(None).cast("string")
    contact: Callable[[], Column] = lambda: F.lit(None).cast("string")
    program_date: Callable[[], Column] = lambda: F.lit(None).cast("string")
    preference: Callable[[], Column] = lambda: F.lit(0)
    accept: Callable[[], Column] = lambda: F.lit(True)
    #: What a record reproduces from its page besides title and URL: a name and whether the entry has it.
    confidence: Callable[[], dict[str, Column]] = dict
    minimum_records: int = 1
    minimum_share: float = 0.8
    required: bool = True


def cell(at: int) -> Column:
    return clean_text(F.get(F.col("cells"), F.lit(at)))


def cell_title() -> Column:
    """The text of the first cell's link, or of the cell."""
    link = clean_text(F.get(F.col("link_texts"), F.lit(0)))
    return F.when(link != "", link).otherwise(cell(0))


def first_href() -> Column:
    return F.get(F.col("hrefs"), F.lit(0))


def has_headers(*patterns: str) -> Column:
    def one(pattern: str) -> Column:
        return F.exists("headers", lambda h: F.lower(clean_text(h)).rlike(pattern))

    found = F.lit(True)
    for pattern in patterns:
        found = found & one(pattern)
    return found


# The three agency sources.
_SEC_PREFIXES = [
    "/enforcement-litigation/distributions-harmed-investors/",
    "/enforcement-litigation/distributions-for-harmed-investors/",
]
_SEC_URL = "https://www.sec.gov/enforcement-litigation/distributions-harmed-investors"


def refund_source(minimum_records: int = 3) -> ListingSource:
    return ListingSource(
        "ftc_refunds", "Federal Trade Commission", "FTC", "https://www.ftc.gov/enforcement/refunds",
        "active_refund_program",
        entry=lambda: (F.col("kind") == "row") & has_headers(r"refund\s*program", "^date$", "contact"),
        title=cell_title, href=first_href,
        summary=lambda: F.lit("The FTC lists this as an active refund program managed by the agency."),
        compensation=lambda: F.lit("FTC-managed refund program"),
        contact=lambda: null_if_blank(cell(2)),
        program_date=lambda: month_date(cell(1)),
        accept=lambda: F.size("cells") >= 2,
        confidence=lambda: {"activeProgramListMembership": F.lit(True), "programDate": cell(1) != "", "contact": cell(2) != ""},
        minimum_records=minimum_records,
    )


def payments_source(minimum_records: int = 3) -> ListingSource:
    kind = lambda: null_if_blank(cell(1))
    ongoing = lambda: F.array_contains("block_ids", "ongoing-cases")
    return ListingSource(
        "cfpb_payments_by_case", "Consumer Financial Protection Bureau", "CFPB",
        "https://www.consumerfinance.gov/enforcement/payments-harmed-consumers/payments-by-case/",
        "ongoing_payment_case",
        entry=lambda: (F.col("kind") == "row")
        & (ongoing() | has_headers(r"defendant\s*name", "type of compensation")),
        title=cell_title, href=first_href,
        summary=lambda: F.when(
            kind().isNotNull(),
            F.concat(F.lit("The CFPB lists this as an ongoing payment case using "), kind(), F.lit(".")),
        ).otherwise("The CFPB lists this as an ongoing payment case."),
        compensation=kind,
        preference=lambda: F.when(ongoing(), 0).otherwise(1),
        accept=lambda: F.size("cells") >= 2,
        confidence=lambda: {"ongoingCaseListMembership": F.lit(True), "compensationType": kind().isNotNull(), "sourcePageModifiedDate": F.col("modified").isNotNull()},
        minimum_records=minimum_records,
    )


def distributions_source(minimum_records: int = 10) -> ListingSource:
    def detail() -> Column:
        return is_listing_detail(
            resolve_url(first_href(), F.lit(_SEC_URL)), ["www.sec.gov", "sec.gov"], _SEC_PREFIXES,
            r"(?i)(archive-completed-distributions|receiverships?)/?$",
        )

    title = lambda: clean_text(F.get(F.col("link_texts"), F.lit(0)))
    return ListingSource(
        "sec_distributions_harmed_investors", "Securities and Exchange Commission", "SEC", _SEC_URL,
        "listed_distribution_matter",
        entry=lambda: (F.col("kind") == "anchor") & detail(),
        title=title, href=first_href,
        summary=lambda: F.lit("The SEC lists this matter on its distributions-to-harmed-investors page."),
        compensation=lambda: F.lit("SEC harmed-investor distribution"),
        accept=lambda: ~title().rlike("(?i)archive|search cases"),
        confidence=lambda: {"distributionListMembership": F.lit(True), "sourcePageModifiedDate": F.col("modified").isNotNull()},
        minimum_records=minimum_records, minimum_share=0.0,
    )


def listing_entries(elements: DataFrame, source: ListingSource) -> DataFrame:
    """The elements of ``source``'s entries: on each page only those of the preferred table."""
    candidates = elements.filter(source.entry()).withColumn(
        "_rank", F.struct(source.preference().alias("p"), F.col("table_at").alias("t"))
    )
    chosen = candidates.groupBy("page_id").agg(F.min("_rank").alias("_rank"))
    return candidates.join(chosen, ["page_id", "_rank"], "left_semi").drop("_rank")


def agency_records(
    entries: DataFrame, source: ListingSource, checked_at: str, modified: DataFrame | None = None
) -> DataFrame:
    """Government records of a source's entries; entries without title or usable URL are dropped.

    The first entry of a record id on a page stays.
    """
    wording = clean_text(F.col("context"))
    parsed = computed_once(
        entries.filter(source.accept()),
        title=source.title(),
        program_url=canonical_url(source.href(), F.lit(source.url)),
        wording=wording,
        participation_mode=participation_mode(wording),
    ).filter((F.col("title") != "") & F.col("program_url").isNotNull())
    identity = F.concat_ws("|", F.lit(source.source_id), F.col("program_url"), F.col("title"))
    path_slug = slugify(url_path(F.col("program_url")))
    if modified is None:
        parsed = parsed.withColumn("modified", F.lit(None).cast("date"))
    else:
        parsed = parsed.join(modified, "page_id", "left")
    compensation = source.compensation()
    scope = {"title": F.lit(True), "programUrl": F.lit(True), **source.confidence()}
    date = lambda kind, value, precision, raw: F.when(
        value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(precision).alias("precision"), raw.alias("raw"))
    )
    modified_day = F.date_format("modified", "yyyy-MM-dd")
    parsed = parsed.withColumn("page_modified", modified_day) if "modified_raw" in parsed.columns else parsed.withColumns({"page_modified": modified_day, "modified_raw": F.lit(None).cast("string")})
    action = F.concat(F.lit("View "), F.lit(source.agency_code), F.lit(" program"))
    records = parsed.select(
        "page_id", "table_at", "at",
        F.concat_ws(
            "-", F.lit("gov"), F.lit(source.agency_code.lower()),
            F.substring(slugify(F.col("title")), 1, 72), short_hash(identity, 8),
        ).alias("record_id"),
        short_hash(identity).alias("fingerprint"),
        F.lit(source.source_id).alias("source_id"),
        F.coalesce(null_if_blank(path_slug), short_hash(F.col("program_url"))).alias("source_record_id"),
        F.lit("government_redress").alias("kind"),
        F.lit(source.agency).alias("agency"),
        F.lit(source.agency_code).alias("agency_code"),
        "title", "program_url",
        F.lit(source.program_status).alias("program_status"),
        "participation_mode",
        window_status(F.col("wording"), F.col("participation_mode")).alias("window_status"),
        F.lit(True).alias("active"),
        F.lit(None).cast("string").alias("inactive_reason"),
        F.lit("current").alias("freshness"),
        source.summary().alias("summary"),
        F.lit(None).cast("string").alias("eligibility"),
        compensation.alias("benefit"),
        compensation.alias("compensation_type"),
        source.contact().alias("contact"),
        source.program_date().alias("program_date"),
        "page_modified",
        F.array_compact(F.array(
            date("program_date", source.program_date(), "month", cell(1)),
            date("source_page_modified", F.col("page_modified"), "day", F.col("modified_raw")),
        )).alias("dates"),
        F.struct(action.alias("label"), F.col("program_url").alias("url"), F.lit("agency_program_page").alias("url_role")).alias("action"),
        F.struct(
            F.lit("agency_source_only").alias("state"), F.lit("agency_program_page").alias("authority"), F.lit("HIGH").alias("confidence"),
            F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in scope.items()])).alias("confidence_scope"),
        ).alias("verification"),
        F.array(F.struct(
            F.lit(source.source_id).alias("source_id"), F.lit(source.agency).alias("source_name"), F.lit(source.url).alias("source_url"),
            F.col("program_url").alias("record_url"), F.lit("agency_program_page").alias("source_type"), F.lit(checked_at).alias("observed_at"),
        )).alias("provenance"),
        dollar_amounts(F.col("wording")).alias("amounts"),
        F.lit(checked_at).alias("first_seen_at"),
        F.lit(checked_at).alias("last_seen_at"),
        F.lit(checked_at).alias("last_changed_at"),
        F.lit(source.url).alias("source_url"),
    )
    return keep_first(records, ["page_id", "record_id"], [F.col("table_at"), F.col("at")]).drop("table_at", "at")


def page_counts(entries: DataFrame, records: DataFrame, pages: DataFrame, source: ListingSource) -> DataFrame:
    """Raw and parsed rows of each of the source's ``pages``, for ``check_sources``; a page without entries counts zero."""
    sides = pages.select("page_id", F.lit(0).alias("raw"), F.lit(0).alias("parsed")).unionByName(
        entries.select("page_id", F.lit(1).alias("raw"), F.lit(0).alias("parsed"))
    ).unionByName(records.select("page_id", F.lit(0).alias("raw"), F.lit(1).alias("parsed")))
    return sides.groupBy("page_id").agg(F.sum("raw").alias("raw_rows"), F.sum("parsed").alias("parsed_rows")).select(
        "page_id", F.lit(source.source_id).alias("source_id"), F.lit(source.required).alias("required"),
        F.lit(source.minimum_records).alias("minimum_records"), "raw_rows", "parsed_rows",
    )


def listing_counts(entries: DataFrame, records: DataFrame, source: ListingSource) -> DataFrame:
    """Raw and parsed rows of a source, for ``check_sources``; a source without entries counts zero."""
    sides = entries.select(F.lit(1).alias("raw"), F.lit(0).alias("parsed")).unionByName(
        records.select(F.lit(0).alias("raw"), F.lit(1).alias("parsed"))
    )
    counted = sides.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_rows"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed_rows")
    )
    return counted.select(
        F.lit(source.source_id).alias("source_id"), F.lit(source.required).alias("required"),
        F.lit(source.minimum_records).alias("minimum_records"), "raw_rows", "parsed_rows",
    )
