"""The unified catalog: projections of three layers, browsing, facets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.dates import days_until
from docketlens.functions.text import stable_bucket
from docketlens.functions.wording import docket_category

# Fixed values of the projections.
ACCENTS = ["cobalt", "coral", "mint", "violet", "amber"]
DEADLINE_WINDOWS = [30, 45, 60]
PAGE_SIZE = 24
COMPACT_COLUMNS = [
    "id", "source_record_id", "kind", "participation_mode", "window_status", "case_name", "docket_number",
    "docket_url", "court", "court_id", "date_filed", "date_terminated", "active", "active_status_caveat",
    "cause", "suit_nature", "action", "coverage_caveat", "first_seen_at", "last_seen_at", "last_changed_at",
    "freshness",
]
COVERAGE_CAVEAT = (
    "CourtListener's RECAP index is broad but not a complete, continuously current copy of PACER. "
    "A missing docket, filing, or termination date does not prove that none exists."
)
DOCKET_FIXED = {
    "title": "Proposed federal class action",
    "geography": "Not yet verified",
    "deadline_label": "No participation deadline shown",
    "status": "Proposed class — not certified",
    "phase": "Putative federal class action",
    "fund": "No settlement announced",
    "benefit": "No open claim window",
    "proof": "Requirements not stated",
    "eligibility": (
        "This is a docket-discovery record, not an application opportunity. The matching complaint alleges "
        "a class action; certification and any future settlement have not been verified."
    ),
    "class_period": "Not established in this catalog",
    "action_label": "View CourtListener docket",
    "action_role": "source_only",
    "administrator": "CourtListener RECAP",
    "kind": "potential_class_case",
    "participation_mode": "no_current_action",
    "window_status": "not_applicable",
    "verification_state": "court_docket_metadata",
    "verification_note": (
        "CourtListener supplied federal docket metadata. The complaint match does not establish "
        "certification, current activity, or a right to participate."
    ),
    "discovery_source_name": "CourtListener RECAP Archive",
}
DOCKET_CHECKLIST = [
    "Treat this as a proposed class, not a certified class",
    "No claim form or opt-in action is shown on this record",
    "Review the docket for later certification, settlement, or dismissal activity",
]
AGENCY_FIXED = {
    "category": "Government redress",
    "geography": "Not yet verified",
    "case_number": "Agency redress program",
    "deadline_label": "Agency page does not state an action deadline",
    "status": "Government redress program",
    "proof": "Requirements not stated",
    "class_period": "See agency program record",
    "action_role": "agency_program",
    "kind": "government_redress",
    "verification_state": "agency_source_only",
    "verification_note": (
        "HIGH confidence applies only to the listed facts reproduced directly from the agency page. "
        "Participation and claim-window status remain unknown unless the agency page states them explicitly."
    ),
}
AGENCY_PHASES = {
    "automatic_distribution": "Agency says distribution is automatic",
    "agency_invitation_only": "Agency invitation only",
    "unknown": "Participation instructions not stated",
}
AGENCY_CHECKLIST = [
    "Confirm whether the agency contacted you directly",
    "Do not assume this program has a public claim form",
    "Use only contact information published on the official agency page",
]
CURATED_FIXED = {
    "action_label": "Open official settlement site",
    "action_role": "verified_official_settlement_site",
    "kind": "settlement_claims_open",
    "participation_mode": "claim_form_required",
    "verification_state": "official_settlement_site_checked",
    "verification_note": "This destination was manually checked against the settlement website.",
    "discovery_source_name": "Manual official-source review",
}
PASSED_STATUS = "Listed deadline passed · source recheck required"


def _fixed(values: dict[str, str]) -> list[Column]:
    return [F.lit(value).alias(name) for name, value in values.items()]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def accent(identifier: Column) -> Column:
    return F.element_at(_texts(ACCENTS), stable_bucket(identifier, len(ACCENTS)) + 1)


def _step(label: str, date: Column, state: str) -> Column:
    return F.struct(F.lit(label).alias("label"), date.alias("date"), F.lit(state).alias("state"))


def docket_records(dockets: DataFrame) -> DataFrame:
    """Merged dockets in the published record shape."""
    ident = F.concat(F.lit("courtlistener-docket-"), F.col("docket_id"))
    return dockets.select(
        "*", ident.alias("id"), F.col("docket_id").cast("string").alias("source_record_id"),
        F.lit("potential_class_case").alias("kind"), F.lit("no_current_action").alias("participation_mode"),
        F.lit("not_applicable").alias("window_status"),
        F.struct(
            F.lit(DOCKET_FIXED["action_label"]).alias("label"), F.col("docket_url").alias("url"),
            F.lit("source_only").alias("type"), F.lit(False).alias("allows_participation"),
        ).alias("action"),
        F.lit(COVERAGE_CAVEAT).alias("coverage_caveat"),
    )


def compact(records: DataFrame) -> DataFrame:
    """The public projection: active records, 22 columns."""
    return records.filter("active").select(*COMPACT_COLUMNS)


def from_dockets(records: DataFrame) -> DataFrame:
    filed = F.coalesce(F.date_format("date_filed", "yyyy-MM-dd"), F.lit("Date not reported"))
    return records.select(
        "id", "source_record_id", F.col("case_name").alias("company"),
        docket_category(F.col("cause"), F.col("suit_nature")).alias("category"),
        F.concat(F.lit("Federal · "), F.col("court")).alias("jurisdiction"),
        F.when(F.col("docket_number") != "", F.col("docket_number")).otherwise("Docket number unavailable").alias("case_number"),
        "court", F.date_format("date_filed", "yyyy-MM-dd").alias("filed_date"),
        F.lit(None).cast("string").alias("deadline"),
        F.col("docket_url").alias("source_url"), F.col("action.url").alias("action_url"),
        F.col("last_seen_at").alias("verified_at"),
        F.concat_ws(" ", "active_status_caveat", "coverage_caveat").alias("source_note"),
        accent(F.col("id")).alias("accent"), _texts(DOCKET_CHECKLIST).alias("checklist"),
        F.array(
            _step("Class-action complaint filed", filed, "done"),
            _step("Docket metadata checked", F.substring("last_seen_at", 1, 10), "current"),
        ).alias("timeline"),
        "freshness", "first_seen_at", "last_changed_at",
        F.lit(False).alias("official_destination_verified"),
        F.col("docket_url").alias("discovery_source_url"),
        *_fixed(DOCKET_FIXED),
    )


def from_agency(records: DataFrame) -> DataFrame:
    """Active agency records as catalog cases."""
    phases = F.create_map(*[F.lit(x) for pair in AGENCY_PHASES.items() for x in pair])
    listed = _step("Program listed by agency", F.lit("Ongoing list"), "current")
    return records.filter("active").select(
        F.col("record_id").alias("id"), F.coalesce("source_record_id", "record_id").alias("source_record_id"),
        F.col("title").alias("company"),
        F.concat(F.col("agency_code"), F.lit(" harmed-consumer payment program")).alias("title"),
        F.concat(F.lit("Federal agency · "), F.col("agency_code")).alias("jurisdiction"),
        F.col("agency").alias("court"), F.lit(None).cast("string").alias("filed_date"),
        F.lit(None).cast("string").alias("deadline"),
        phases[F.col("participation_mode")].alias("phase"),
        F.coalesce("compensation_type", "benefit", F.lit("Agency redress")).alias("fund"),
        F.coalesce("benefit", F.lit("See the agency program page")).alias("benefit"),
        F.coalesce(
            "eligibility",
            F.concat_ws(
                " ", "summary",
                F.lit("The source list does not say that visitors can file a claim; review the agency page for any instructions or contact requirements."),
            ),
        ).alias("eligibility"),
        F.col("program_url").alias("source_url"), F.col("program_url").alias("action_url"),
        F.concat(F.lit("View "), F.col("agency_code"), F.lit(" program")).alias("action_label"),
        F.col("agency").alias("administrator"), F.col("last_seen_at").alias("verified_at"),
        F.lit(AGENCY_FIXED["verification_note"]).alias("source_note"),
        accent(F.col("record_id")).alias("accent"), _texts(AGENCY_CHECKLIST).alias("checklist"),
        F.array_compact(F.array(
            F.when(F.col("page_modified").isNotNull(), _step("Agency page modified", F.col("page_modified"), "done")), listed,
        )).alias("timeline"),
        "participation_mode", "window_status", "freshness", "first_seen_at", "last_changed_at",
        F.lit(True).alias("official_destination_verified"),
        F.col("agency").alias("discovery_source_name"), F.col("source_url").alias("discovery_source_url"),
        *_fixed(AGENCY_FIXED),
    )


def from_curated(cases: DataFrame, as_of: Column) -> DataFrame:
    """Reviewed cases; once the deadline (a zoned timestamp text) is before ``as_of`` the window closes."""
    passed = F.coalesce(F.col("deadline").try_cast("timestamp") < as_of, F.lit(False))
    return cases.select(
        *[c for c in cases.columns if c not in ("status", "claim_url")],
        F.when(passed, PASSED_STATUS).otherwise(F.col("status")).alias("status"),
        F.concat(F.lit("manual-"), F.col("id")).alias("source_record_id"),
        F.col("claim_url").alias("action_url"),
        F.when(passed, "closed").otherwise("open").alias("window_status"),
        F.when(passed, "stale").otherwise("current").alias("freshness"),
        F.col("verified_at").alias("first_seen_at"), F.col("verified_at").alias("last_changed_at"),
        F.lit(True).alias("official_destination_verified"),
        F.col("source_url").alias("discovery_source_url"),
        *_fixed(CURATED_FIXED),
    )


def unify(*layers: DataFrame) -> DataFrame:
    whole = layers[0]
    for layer in layers[1:]:
        whole = whole.unionByName(layer, allowMissingColumns=True)
    return whole


CRITERIA_COLUMNS = [
    "aliases", "issue_types", "situations", "eligible_states", "covered_start", "covered_end", "notice_required", "recognition_label",
]


def finder_cases(catalog: DataFrame, criteria: DataFrame) -> DataFrame:
    """The unified catalog as the finder's cases: FINDER_CASE with ``id`` as ``case_id``.

    ``criteria`` has at most one row for each reviewed case: its ``id`` and the columns of ``CRITERIA_COLUMNS``. A case
    without one, as every agency record and docket, is never matched by aliases, places, years or situations. A deadline that is no
    time counts as none.
    """
    reviewed = criteria.select(F.col("id").alias("_id"), *CRITERIA_COLUMNS)
    cases = catalog.select("id", "company", "title", "kind", "window_status", "freshness", F.col("deadline").try_cast("timestamp").alias("deadline"), "proof")
    return cases.join(reviewed, cases["id"] == reviewed["_id"], "left").select(
        F.col("id").alias("case_id"), *cases.columns[1:], *[c for c in CRITERIA_COLUMNS if c not in ("notice_required", "recognition_label")],
        F.coalesce("notice_required", F.lit(False)).alias("notice_required"), F.col("_id").isNotNull().alias("has_criteria"), "recognition_label",
    )


# ---- browsing ----

SEARCHED = ["company", "title", "category", "eligibility", "jurisdiction", "case_number", "discovery_source_name", "kind"]


def browse(
    catalog: DataFrame, as_of: Column, *, query: str = "", within_days: int | None = None, **facets: str | None
) -> DataFrame:
    """Rows matching every given facet (kind, category, geography, proof), window and search text."""
    rows = catalog
    for name, value in facets.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if within_days is not None:
        left = days_until(F.col("deadline").try_cast("timestamp"), as_of)
        rows = rows.filter((left >= 0) & (left <= within_days))
    wanted = query.strip().lower()
    if wanted:
        text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in SEARCHED]))
        rows = rows.filter(text.contains(wanted))
    return rows


def browse_order(sort: str = "deadline", tie: str = "id") -> list[Column]:
    """Orders of the listing; date texts compare as texts, missing ones come last."""
    orders = {
        "deadline": F.col("deadline").asc_nulls_last(),
        "new": F.col("verified_at").desc(),
        "company": F.collate(F.col("company"), "UNICODE").asc(),
        "age": F.col("filed_date").asc_nulls_last(),
    }
    return [orders.get(sort, orders["deadline"]), F.col(tie)]


def page(rows: DataFrame, order: list[Column], size: int = PAGE_SIZE) -> DataFrame:
    return rows.orderBy(*order).limit(size)


def record_order() -> list[Column]:
    """Kind, deadline (none last), title without case and accents, id."""
    return [
        F.collate(F.col("kind"), "UNICODE"), F.coalesce("deadline", F.lit("9999-12-31")),
        F.collate(F.col("title"), "UNICODE_CI_AI"), F.collate(F.col("id"), "UNICODE"),
    ]


# ---- counts ----


def facet_counts(catalog: DataFrame, as_of: Column) -> DataFrame:
    """(facet, value, records) over the whole catalog in one scan; each row adds to each of its facets."""
    left = days_until(F.col("deadline").try_cast("timestamp"), as_of)
    entry = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    entries = [entry(name, F.col(name)) for name in ("kind", "category", "geography", "proof")]
    entries += [
        entry("deadline", F.when((left >= 0) & (left <= n), F.lit(f"within {n} days"))) for n in DEADLINE_WINDOWS
    ]
    entries.append(entry("all", F.lit("all")))
    return (
        catalog.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("records"))
    )


def summary(catalog: DataFrame) -> DataFrame:
    """Records and stale records by kind, by category and in all."""
    kind, category = F.col("kind"), F.col("category")
    grouped = catalog.groupingSets([[kind], [category], []], kind, category).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("freshness") == "stale").alias("stale")
    )
    return grouped.select(
        F.when(F.col("_g") == 1, "kind").when(F.col("_g") == 2, "category").otherwise("all").alias("dimension"),
        F.when(F.col("_g") == 1, kind).when(F.col("_g") == 2, category).otherwise("all").alias("value"),
        "records", "stale",
    )


def stats(catalog: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return catalog.agg(
        F.count(F.lit(1)).alias("record_count"),
        of("settlement_claims_open").alias("open_claim_count"),
        of("government_redress").alias("government_redress_count"),
        of("potential_class_case").alias("potential_case_count"),
        of("legal_counsel_intake").alias("legal_intake_count"),
        F.count_if(F.col("freshness") == "stale").alias("stale_record_count"),
        F.max("verified_at").alias("generated_at"),
    )


def published_totals(catalog: DataFrame) -> DataFrame:
    """Totals of what is served, out of a catalog of ``layer`` (curated, docket, agency), ``kind``, ``active`` and ``freshness``.

    Curated and agency records are served while active and dockets always; stale ones are counted of agency records only.
    """
    layer, active = F.col("layer"), F.coalesce("active", F.lit(False))
    docket = layer == "docket"
    served = active & ~docket
    return catalog.agg(
        (F.count_if(layer == "curated") + F.count_if(docket) + F.count_if((layer == "agency") & active)).alias("record_count"),
        (F.count_if(served) + F.count_if(docket)).alias("active_record_count"),
        F.count_if(served & (F.col("kind") == "settlement_claims_open")).alias("open_claim_count"),
        F.count_if(served & (F.col("kind") == "legal_counsel_intake")).alias("legal_intake_count"),
        F.count_if(docket).alias("potential_case_count"),
        F.count_if(served & (F.col("kind") == "government_redress")).alias("government_redress_count"),
        F.count_if((layer == "agency") & (F.col("freshness") == "stale")).alias("stale_count"),
    )

def categories(catalog: DataFrame) -> DataFrame:
    return catalog.select("category").distinct().orderBy(F.collate(F.col("category"), "UNICODE"))


def freshness_stamp(*stamps: DataFrame) -> DataFrame:
    """The greatest of the ``stamp`` texts, compared as texts; the epoch when there is none."""
    merged = unify(*[s.select("stamp") for s in stamps])
    return merged.agg(F.coalesce(F.max("stamp"), F.lit("1970-01-01T00:00:00.000Z")).alias("generated_at"))
