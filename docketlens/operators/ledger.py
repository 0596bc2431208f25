"""The private claim ledger: patches, versions, activity, upserts, purges and owner scoping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.functions.text import bind, null_if_blank, strip
from docketlens.operators.keyed import fill_forward, keep_first, keep_last, only_keys, previous_row, running_position, top_k, without_keys

# Statuses and their classes.
OPENED_STATUSES = [
    "official_site_opened", "publisher_destination_opened", "legal_intake_opened", "continued_to_official_site",
]
FINISHED = ["paid", "denied", "closed", "withdrawn"]
NEEDS_UPDATE = ["tracking", "started", "unknown"]
EVENT_LIMIT = (1, 500)
MAX_SAFE_CENTS = 2**53 - 1
CONFIRMATION_LENGTH = 250
NOTE_LENGTH = 5000
VERSION_COLUMNS = [
    "personal_status", "status_provenance", "confirmation_number", "submitted_at", "approved_at",
    "approved_amount_cents", "paid_at", "received_amount_cents", "amount_source", "private_note",
]


def draft_status(status: Column) -> Column:
    return F.when(status.isin(OPENED_STATUSES), "started").otherwise(status)


def is_finished(status: Column) -> Column:
    return draft_status(status).isin(FINISHED)


def needs_update(status: Column) -> Column:
    return draft_status(status).isin(NEEDS_UPDATE)


def status_tone(status: Column) -> Column:
    return F.when(is_finished(status), "paid").when(needs_update(status), "review").otherwise("progress")


def to_cents(amount: Column) -> Column:
    """Amount text to whole cents; blank, unreadable and negative amounts and those beyond exact cents are null."""

    def whole(number: Column) -> Column:
        cents = F.floor(number * 100 + 0.5)
        return F.when((number >= 0) & (number <= MAX_SAFE_CENTS / 100), F.when(cents <= MAX_SAFE_CENTS, cents.cast("bigint")))

    def read(text: Column) -> Column:
        return bind(F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")), whole)

    return bind(strip(amount), read)


def invalid_amount(amount: Column, cents: Column | None = None) -> Column:
    """Whether a text that is not blank is no amount; ``cents``: its ``to_cents``, where that is known already."""
    return (strip(amount) != "") & (to_cents(amount) if cents is None else cents).isNull()


def refusal(invalid_amount: Column) -> Column:
    """Why an operation is refused, null if it is accepted: an amount that is none, a confirmation without a number."""
    number = F.coalesce(strip(F.col("confirmation")), F.lit(""))
    return (
        F.when(invalid_amount, "invalid_amount")
        .when((F.col("operation") == "confirmation") & (number == ""), "confirmation_required")
        .when(F.length(number) > CONFIRMATION_LENGTH, "confirmation_too_long")
    )


# ---- patches and versions ----


def _set(value: Column) -> Column:
    """A value a patch sets, possibly null, is wrapped; what a patch leaves alone is a plain null."""
    return F.struct(value.alias("value"))


def operation_patches() -> dict[str, dict[str, Column]]:
    """What each recorded operation sets, over the columns of an operations table.

    Columns read: at, status, provenance, confirmation, submitted_on, occurred_on, approved_cents,
    received_cents, source, note. Where occurred_on is null the time of the operation counts.
    """
    given = lambda name, default: F.coalesce(F.col(name), default)
    confirmation = null_if_blank(strip(F.col("confirmation")))
    amount_source = F.when(
        F.col("approved_cents").isNotNull() | F.col("received_cents").isNotNull(), F.col("source")
    )
    provenance = given("provenance", F.lit("user_reported"))
    return {
        "status": {"personal_status": F.col("status"), "status_provenance": provenance},
        "submission": {
            "personal_status": F.when(confirmation.isNotNull(), "confirmation_recorded").otherwise("submitted"),
            "status_provenance": provenance, "confirmation_number": confirmation,
            "submitted_at": given("occurred_on", F.col("at")),
        },
        "confirmation": {
            "personal_status": F.lit("confirmation_recorded"),
            "status_provenance": given("provenance", F.lit("confirmation_email")),
            "confirmation_number": confirmation,
        },
        "approval": {
            "personal_status": F.lit("approved"), "status_provenance": provenance,
            "approved_at": given("occurred_on", F.col("at")), "approved_amount_cents": F.col("approved_cents"),
            "amount_source": F.col("source"),
        },
        "denial": {"personal_status": F.lit("denied"), "status_provenance": provenance},
        "payment": {
            "personal_status": F.lit("paid"), "status_provenance": provenance,
            "paid_at": given("occurred_on", F.col("at")), "received_amount_cents": F.col("received_cents"),
            "amount_source": F.col("source"),
        },
        "note": {"private_note": null_if_blank(strip(F.col("note")))},
        # approved_at and paid_at of an outcome keep the first value, see apply_operations.
        "outcome": {
            "personal_status": F.col("status"), "status_provenance": provenance,
            "confirmation_number": confirmation, "submitted_at": F.col("submitted_on"),
            "approved_amount_cents": F.col("approved_cents"), "received_amount_cents": F.col("received_cents"),
            "amount_source": amount_source,
        },
    }


def apply_operations(operations: DataFrame, order: list[Column], block: Column) -> DataFrame:
    """The version of a claim after each operation: the key columns, at, and ``VERSION_COLUMNS``.

    Each column holds the last value set so far. An outcome save sets approved_at (paid_at) only while
    it is empty and the status is approved (paid). ``block`` splits a claim's operations, see
    ``previous_row``.
    """
    patches = operation_patches()

    def patched(column: str) -> Column:
        chain = None
        for name, sets in patches.items():
            if column in sets:
                here = F.col("operation") == name
                chain = F.when(here, _set(sets[column])) if chain is None else chain.when(here, _set(sets[column]))
        return chain.alias(column)

    outcome = lambda status: F.when((F.col("operation") == "outcome") & (F.col("status") == status), _set(F.col("at")))
    kept = [c for c in ("claim_id", "user_id", "case_id", "seq", "at") if c in operations.columns]
    rows = operations.select(
        *kept, *[patched(c) for c in VERSION_COLUMNS], outcome("approved").alias("_approved_offer"), outcome("paid").alias("_paid_offer")
    )
    # The first outcome of a kind offers its time to every version from there on.
    filled = fill_forward(rows, ["claim_id"], order, block, VERSION_COLUMNS, ("_approved_offer", "_paid_offer"))
    offered = lambda name: F.col(f"_{name}_offer.value")
    values = {c: F.col(f"{c}.value") for c in VERSION_COLUMNS}
    values["approved_at"] = F.coalesce(values["approved_at"], offered("approved"))
    values["paid_at"] = F.coalesce(values["paid_at"], offered("paid"))
    return filled.select(*kept, *[value.alias(c) for c, value in values.items()])


def current_claims(versions: DataFrame, order: list[Column]) -> DataFrame:
    """The last version of each claim, stamped with the time of its last change."""
    return keep_last(versions, ["claim_id"], order).withColumn("updated_at", F.col("at"))


def claim_activity(
    versions: DataFrame, order: list[Column], block: Column, extra: tuple[str, ...] = ()
) -> DataFrame:
    """The activity log derived from row versions: at most one event for each change, by precedence.

    ``extra`` names columns of the versions to keep.
    """
    return version_events(previous_row(versions, ["claim_id"], order, block, VERSION_COLUMNS, "_old"), extra)


def version_events(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The event of each version that has the one before it as ``_old``; null for a claim's first."""
    old = lambda c: F.col(f"_old.{c}")
    differs = lambda *cs: ~F.struct(*cs).eqNullSafe(F.struct(*[old(c).alias(c) for c in cs]))
    kind = (
        F.when(F.col("_old").isNull(), "claim_created")
        .when(differs("paid_at", "received_amount_cents"), "payment_recorded")
        .when(differs("approved_at", "approved_amount_cents"), "approval_recorded")
        .when(differs("submitted_at"), "submission_recorded")
        .when(differs("confirmation_number"), "confirmation_recorded")
        .when((F.col("personal_status") == "denied") & differs("personal_status"), "denial_recorded")
        .when(differs("personal_status", "status_provenance"), "status_updated")
    )
    named = rows.withColumn("event_type", kind).filter(F.col("event_type").isNotNull())
    event = F.col("event_type")
    amount = F.when(event == "payment_recorded", F.col("received_amount_cents")).when(
        event == "approval_recorded", F.col("approved_amount_cents")
    )
    occurred = (
        F.when(event == "payment_recorded", F.col("paid_at"))
        .when(event == "approval_recorded", F.col("approved_at"))
        .when(event == "submission_recorded", F.col("submitted_at"))
    )
    return named.select(
        *[c for c in ("user_id", "claim_id") if c in rows.columns], *extra,
        "event_type", "personal_status", F.col("status_provenance").alias("provenance"), "confirmation_number",
        amount.alias("amount_cents"),
        F.when(amount.isNotNull(), F.when(event == "payment_recorded", "received").otherwise("approved")).alias("amount_kind"),
        F.coalesce(occurred, F.col("at")).alias("occurred_at"),
    )


# ---- keyed writes ----


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows untouched plus the first incoming row of each new key."""
    fresh = keep_first(incoming, keys, order).select(*existing.columns)
    return existing.unionByName(without_keys(fresh, existing, keys))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last incoming row of each key replaces the existing one."""
    newest = keep_last(incoming, keys, order).select(*existing.columns)
    return without_keys(existing, newest, keys).unionByName(newest)


def purge_subjects(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Remove users from every table by user id, and events of purged claims by claim id."""
    kept = {name: without_keys(df, users, ["user_id"]) for name, df in tables.items()}
    if "claims" in tables and "claim_events" in kept:
        gone = only_keys(tables["claims"], users, ["user_id"])
        kept["claim_events"] = without_keys(kept["claim_events"], gone, ["claim_id"])
    return kept


def delete_owned(rows: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key and owner: a removal of someone else's row changes nothing."""
    return without_keys(rows, removals, [*keys, "user_id"])


def scoped_to(rows: DataFrame, entitled: DataFrame) -> DataFrame:
    """Only rows of entitled owners."""
    return only_keys(rows, entitled, ["user_id"])


def newest_events(events: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` events of each claim."""
    low, high = EVENT_LIMIT
    if not isinstance(limit, int) or not low <= limit <= high:
        raise ValueError(f"limit must be an integer from {low} through {high}")
    return top_k(events, ["user_id", "claim_id"], [F.col("occurred_at").desc(), F.col("event_id").desc()], limit)


def newest_first(rows: DataFrame, time: str, tie: str) -> DataFrame:
    """Add ``position``: the place of each row among its owner's, the newest first; days are counted apart."""
    day = F.datediff(F.lit("9999-12-31").cast("date"), F.coalesce(F.to_date(time), F.lit("0001-01-01").cast("date")))
    return running_position(rows, ["user_id"], [F.col(time).desc(), F.col(tie)], day, "position")


def note_events(notes: DataFrame) -> DataFrame:
    """Activity of a note for each row with a ``note``, or its ``refusal``; the note is stored stripped.

    A refused note has no event, hence null event columns.
    """
    stripped = notes.withColumn("note", strip(F.coalesce(F.col("note"), F.lit(""))))
    size = F.length("note")
    told = stripped.withColumn("refusal", F.when(size == 0, "note_required").when(size > NOTE_LENGTH, "note_too_long"))
    accepted = lambda value: F.when(F.col("refusal").isNull(), value)
    return told.withColumns({"event_type": accepted(F.lit("note_added")), "provenance": accepted(F.lit("user_reported")), "note": accepted(F.col("note"))})


def orphan_events(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Events whose (claim, owner) pair does not exist."""
    return without_keys(events, claims, ["claim_id", "user_id"])


def admitted_events(events: DataFrame, claims: DataFrame) -> DataFrame:
    return only_keys(events, claims, ["claim_id", "user_id"])


# ---- reads ----


def ledger_stats(claims: DataFrame) -> DataFrame:
    status = F.col("personal_status")
    return claims.groupBy("user_id").agg(
        F.count_if(is_finished(status)).alias("finished"),
        F.count_if(needs_update(status)).alias("needs_update"),
        (F.count(F.lit(1)) - F.count_if(is_finished(status))).alias("in_progress"),
        F.sum(F.coalesce("received_amount_cents", F.lit(0))).alias("received_cents"),
    )


def ledger_view(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """Claims beside their catalog case, with fallbacks for cases no longer listed."""
    item = catalog.select(
        F.col("id").alias("case_id"), F.col("company").alias("_company"), F.col("title").alias("_title"),
        F.col("status").alias("_status"), F.col("kind").alias("_kind"), F.lit(True).alias("_listed"),
    )
    docket = F.col("_kind") == "potential_class_case"
    status = F.when(docket, "Indexed · no termination reported · not confirmed active").otherwise(
        F.coalesce("_status", F.lit("Current case status unavailable"))
    )
    return claims.join(item, "case_id", "left").select(
        "user_id", "claim_id", "case_id",
        F.coalesce("_company", F.lit("Tracked claim")).alias("company"),
        F.coalesce("_title", "case_id").alias("title"),
        status.alias("case_status"), F.coalesce("_listed", F.lit(False)).alias("listed"),
        status_tone(F.col("personal_status")).alias("tone"),
        F.when(
            F.col("received_amount_cents").isNotNull(),
            F.concat(F.lit("$"), (F.col("received_amount_cents") / 100).cast("decimal(18,2)").cast("string"), F.lit(" received")),
        ).otherwise("Outcome unknown").alias("amount"),
    )


def action_gate(openings: DataFrame, catalog: DataFrame, claims: DataFrame) -> DataFrame:
    """What opening a case's action does: paused, source only, or an activity that may start a claim."""
    role = F.col("action_role")
    activity = (
        F.when(F.col("freshness") == "stale", "paused")
        .when(role.isin("source_only", "agency_program"), "source_only")
        .when(role == "verified_official_settlement_site", "official_site_opened")
        .when(role == "legal_intake", "legal_intake_opened")
        .otherwise("publisher_destination_opened")
    )
    existing = claims.select("user_id", "case_id").distinct().withColumn("_has", F.lit(True))
    items = catalog.select(F.col("id").alias("case_id"), "freshness", "action_role")
    gated = openings.join(items, "case_id").join(existing, ["user_id", "case_id"], "left")
    return gated.select(
        *openings.columns, activity.alias("activity"),
        (~activity.isin("paused", "source_only") & F.col("_has").isNull()).alias("starts_claim"),
    )


def seed_profiles(users: DataFrame, synthetic_suffix: str) -> DataFrame:
    """Profiles of new users (user_id, email, metadata JSON): first non-blank name, synthetic e-mail blanked."""
    name = lambda path: null_if_blank(strip(F.get_json_object("metadata", path)))
    email = F.coalesce("email", F.lit(""))
    return users.select(
        "user_id",
        F.coalesce(name("$.full_name"), name("$.name"), F.lit("")).alias("full_name"),
        F.when(F.lower(email).endswith(synthetic_suffix.lower()), "").otherwise(email).alias("contact_email"),
    )
