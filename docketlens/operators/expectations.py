"""Table quality rules: counted violations and a quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.text import strip

# Allowed codes and lengths.
STATUSES = [
    "tracking", "started", "submitted", "confirmation_recorded", "under_review", "approved", "denied",
    "payment_pending", "paid", "closed", "withdrawn", "unknown",
]
PROVENANCES = [
    "user_reported", "confirmation_email", "official_claim_portal", "settlement_administrator_notice",
    "court_document", "government_agency_notice", "system_import", "unknown",
]
AMOUNT_SOURCES = [
    "user_reported", "official_claim_portal", "settlement_administrator_notice", "payment_record",
    "government_agency_notice", "system_import", "unknown",
]
EVENT_TYPES = [
    "claim_created", "status_updated", "submission_recorded", "confirmation_recorded", "approval_recorded",
    "denial_recorded", "payment_recorded", "note_added",
]
AMOUNT_KINDS = ["approved", "received"]
PROFILE_LENGTHS = {
    "full_name": 300, "contact_email": 320, "phone": 80, "address_line1": 500, "address_line2": 500,
    "city": 200, "region": 200, "postal_code": 40,
}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
COUNTRY = "^[A-Z]{2}$"


def at_most(column: str, length: int) -> Column:
    return F.length(column) <= length


def between(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def profile_rules() -> dict[str, Column]:
    rules = {f"{name}_length": at_most(name, length) for name, length in PROFILE_LENGTHS.items()}
    return rules | {"country_code_format": F.col("country_code").rlike(COUNTRY), "user_id_uuid": strip(F.col("user_id")).rlike(UUID)}


def saved_case_rules() -> dict[str, Column]:
    return {
        "case_id_length": between("case_id", 1, 256),
        "title_length": at_most("case_title_snapshot", 500),
        "source_url_length": at_most("source_url_snapshot", 2048),
    }


def claim_rules() -> dict[str, Column]:
    return {
        "case_id_length": between("case_id", 1, 256),
        "title_length": at_most("case_title_snapshot", 500),
        "company_length": at_most("company_snapshot", 300),
        "confirmation_length": at_most("confirmation_number", 250),
        "note_length": at_most("private_note", 5000),
        "personal_status_check": F.col("personal_status").isin(STATUSES),
        "status_provenance_check": F.col("status_provenance").isin(PROVENANCES),
        "amount_source_check": F.col("amount_source").isin(AMOUNT_SOURCES),
        "approved_amount_nonnegative": F.col("approved_amount_cents") >= 0,
        "received_amount_nonnegative": F.col("received_amount_cents") >= 0,
        "paid_status_has_date": (F.col("personal_status") != "paid") | F.col("paid_at").isNotNull(),
        "paid_after_submission": F.col("paid_at") >= F.col("submitted_at"),
    }


def claim_event_rules() -> dict[str, Column]:
    amount, kind = F.col("amount_cents"), F.col("amount_kind")
    return {
        "type_check": F.col("event_type").isin(EVENT_TYPES),
        "status_check": F.col("personal_status").isin(STATUSES),
        "provenance_check": F.col("provenance").isin(PROVENANCES),
        "confirmation_length": at_most("confirmation_number", 250),
        "amount_nonnegative": amount >= 0,
        "note_length": at_most("note", 5000),
        "metadata_object": F.when(F.col("metadata").isNotNull(), F.json_object_keys("metadata").isNotNull()),
        "amount_kind_check": F.when(amount.isNull(), kind.isNull()).otherwise(F.coalesce(kind.isin(AMOUNT_KINDS), F.lit(False))),
    }


def text_refusal(text: Column, name: str, maximum: int) -> Column:
    """Why a stripped text is refused, null if it is not."""
    return F.when(text == "", f"{name} is required").when(F.length(text) > maximum, f"{name} must be {maximum} characters or fewer")


def checked_write(rows: DataFrame, required: dict[str, int], uuids: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` as they may be written, texts stripped, with the first ``refusal`` in the order of ``uuids`` and ``required``; null if none.

    ``required`` gives the longest text of each column that must not be blank; ``uuids`` must be UUIDs of version 1 to 8.
    """
    stripped = rows.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in [*uuids, *required]})
    refusals = [F.when(~F.col(c).rlike(UUID), f"{c} must be a UUID") for c in uuids]
    refusals += [text_refusal(F.col(c), c, maximum) for c, maximum in required.items()]
    return stripped.withColumn("refusal", F.coalesce(*refusals))


def violated(rule: Column) -> Column:
    """A rule that is null (its column is null) holds, as in a table constraint."""
    return ~F.coalesce(rule, F.lit(True))


def violation_counts(rows: DataFrame, rules: dict[str, Column], table: str) -> DataFrame:
    """(table, rule, violations) in one pass."""
    counts = rows.agg(*[F.count_if(violated(rule)).alias(name) for name, rule in rules.items()])
    entries = [F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules]
    return counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


def split_quarantine(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with the names of the rules they break)."""
    broken = F.array_compact(F.array(*[F.when(violated(rule), F.lit(name)) for name, rule in rules.items()]))
    marked = rows.withColumn("broken_rules", broken)
    return marked.filter(F.size("broken_rules") == 0).drop("broken_rules"), marked.filter(F.size("broken_rules") > 0)


def duplicate_keys(rows: DataFrame, keys: list[str], table: str) -> DataFrame:
    """(table, rule, violations): rows beyond the first of each key."""
    sizes = rows.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return sizes.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit("unique_" + "_".join(keys)).alias("rule"), "violations"
    )
