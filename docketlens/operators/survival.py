"""Docket survival: row accounting, docket collapse, cohorts and Kaplan-Meier estimates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions.dates import days_to_months, stripped_date
from docketlens.functions.text import strip
from docketlens.operators.keyed import computed_once

# Fixed values of the court extract.
REQUIRED_COLUMNS = [
    "CIRCUIT", "DISTRICT", "OFFICE", "DOCKET", "ORIGIN", "FILEDATE", "JURIS", "NOS", "CLASSACT",
    "MDLDOCK", "TERMDATE", "TRCLACT", "DISP", "STATUSCD", "TAPEYEAR",
]
TRANSFER_ORIGINS = ["6", "13"]
PENDING_SENTINELS = ["01/01/1900", "1900-01-01"]
SETTLED = "13"
QUANTILES = [("p25", 0.75), ("median", 0.5), ("p75", 0.25)]
QUANTILE_SLACK = 2.220446049250313e-16
SKIP_STATUSES = [
    "invalid_filing_date", "invalid_termination_date", "ambiguous_endpoint", "negative_or_post_snapshot",
]
DEFAULT_COHORT = "class_alleged_excluding_mdl_transfer_origins"


def cohort_definitions(include_certified: bool = False) -> list[tuple[str, Column]]:
    """(id, predicate over lifecycles). Callers may append their own pairs."""
    transferred = F.col("is_mdl_transfer_origin")
    definitions = [
        ("class_alleged_all_origins", F.lit(True)),
        ("class_alleged_excluding_mdl_transfer_origins", ~transferred),
        ("class_alleged_mdl_transfer_origins", transferred),
    ]
    if include_certified:
        granted = F.col("trclact_granted")
        definitions += [
            ("class_certification_granted_all_origins", granted),
            ("class_certification_granted_excluding_mdl_transfer_origins", granted & ~transferred),
        ]
    return definitions


def check_required(columns: list[str]) -> None:
    missing = [c for c in REQUIRED_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"docket extract lacks required columns: {', '.join(missing)}")


def snapshot_literal(snapshot: str) -> Column:
    return F.lit(dt.date.fromisoformat(snapshot))


def class_rows(rows: DataFrame) -> DataFrame:
    """The rows of the class filter alone, of an extract whose cells are stripped, as ``read_court_extract`` returns it.

    A plain comparison before anything is derived, so that the scan can apply it.
    """
    return rows.filter(F.col("CLASSACT") == "1")


def classify_rows(rows: DataFrame, snapshot: str) -> DataFrame:
    """Trimmed class rows with parsed dates and ``row_status``; the first failing check names the row.

    Rows outside the class filter keep the status ``not_class``.
    """
    field = lambda name: strip(F.coalesce(F.col(name), F.lit("")))
    end = snapshot_literal(snapshot)
    # Two generators: what is inside one is written out as often as it is named there.
    stripped = computed_once(
        rows,
        is_class=field("CLASSACT") == "1",
        pending=(field("STATUSCD") == "S") | (field("TAPEYEAR") == "2099"),
        _filing=strip(F.col("FILEDATE")),
        raw_termination=field("TERMDATE"),
    )
    base = computed_once(
        stripped,
        # Dates are parsed for class rows only, a fiftieth of a real extract.
        filed=F.when(F.col("is_class"), stripped_date(F.col("_filing"))),
        terminated=F.when(F.col("is_class") & ~F.col("pending"), stripped_date(F.col("raw_termination"))),
    ).drop("_filing")
    blank = F.col("raw_termination").isin("", "-8")
    last = F.when(F.col("pending"), end).otherwise(F.col("terminated"))
    status = (
        F.when(~F.col("is_class"), "not_class")
        .when(F.col("filed").isNull(), "invalid_filing_date")
        .when(~F.col("pending") & F.col("terminated").isNull() & ~blank, "invalid_termination_date")
        .when(~F.col("pending") & F.col("terminated").isNull(), "ambiguous_endpoint")
        .when((F.datediff(last, F.col("filed")) < 0) | (last > end), "negative_or_post_snapshot")
        .otherwise("valid")
    )
    return base.select(
        "*",
        status.alias("row_status"),
        (F.col("pending") & F.col("raw_termination").isin(PENDING_SENTINELS)).alias("sentinel"),
        F.concat_ws(":", *[field(c) for c in ["CIRCUIT", "DISTRICT", "OFFICE", "DOCKET"]]).alias("docket_key"),
    )


def collapse_dockets(classified: DataFrame, order: list[str], snapshot: str) -> DataFrame:
    """One lifecycle for each docket key.

    ``order`` names the columns that give file order; the earliest row wins ties on the latest
    termination. All aggregates are partial, so a docket with many rows collapses map-side.
    """
    field = lambda name: strip(F.coalesce(F.col(name), F.lit("")))
    disposition = field("DISP")
    mdl = field("MDLDOCK")
    end = snapshot_literal(snapshot)
    valid = classified.filter(F.col("is_class") & (F.col("row_status") == "valid"))
    lifecycles = valid.groupBy("docket_key").agg(
        F.min("filed").alias("filed_at"),
        F.max("terminated").alias("final_terminated_at"),
        F.min_by(
            F.when(disposition == "", "missing").otherwise(disposition),
            F.when(
                F.col("terminated").isNotNull(),
                F.struct(F.datediff(end, F.col("terminated")).alias("age"), *[F.col(c) for c in order]),
            ),
        ).alias("final_disposition"),
        F.min(F.when(disposition == SETTLED, F.col("terminated"))).alias("first_settlement_at"),
        F.bool_or("pending").alias("pending"),
        F.bool_or(field("TRCLACT") == "3").alias("trclact_granted"),
        F.bool_or(field("ORIGIN").isin(TRANSFER_ORIGINS)).alias("is_mdl_transfer_origin"),
        F.bool_or(~mdl.isin("", "-8")).alias("mdl_docket_present"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    last = F.when(F.col("pending"), end).otherwise(F.col("final_terminated_at"))
    return lifecycles.select(
        "*",
        F.datediff(last, F.col("filed_at")).alias("lifecycle_days"),
        F.datediff(F.coalesce(F.col("first_settlement_at"), last), F.col("filed_at")).alias("settlement_days"),
        F.col("first_settlement_at").isNotNull().alias("settled"),
    )


def row_accounting(classified: DataFrame) -> DataFrame:
    """One row of counters, with the distinct valid dockets and the reconciliation difference."""
    cls = F.col("is_class")
    of = lambda status: F.count_if(F.col("row_status") == status)
    # Dockets are counted through a grouped partial aggregate, not a distinct inside the global one.
    per_docket = classified.groupBy(
        F.when(F.col("row_status") == "valid", F.col("docket_key")).alias("docket_key")
    ).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(cls).alias("class_rows"),
        F.count_if(cls & F.col("pending")).alias("explicit_pending_rows"),
        F.count_if(cls & F.col("sentinel")).alias("sentinel_rows"),
        *[of(s).alias(f"{s}_rows") for s in SKIP_STATUSES],
        of("valid").alias("valid_rows"),
        F.bool_or(cls & F.col("pending") & (F.col("row_status") == "valid")).alias("docket_pending"),
    )
    counters = [
        "rows_read", "class_rows", "explicit_pending_rows", "sentinel_rows",
        *[f"{s}_rows" for s in SKIP_STATUSES],
    ]
    total = per_docket.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters],
        F.count("docket_key").alias("dockets"),
        F.count_if(F.col("docket_key").isNotNull() & F.col("docket_pending")).alias("pending_dockets"),
        F.coalesce(F.sum("valid_rows"), F.lit(0)).alias("valid_rows"),
    )
    skipped = sum((F.col(f"{s}_rows") for s in SKIP_STATUSES), F.lit(0))
    return (
        total.withColumn("repeated_rows_collapsed", F.col("valid_rows") - F.col("dockets"))
        .withColumn(
            "unreconciled_rows",
            F.col("class_rows") - (skipped + F.col("repeated_rows_collapsed") + F.col("dockets")),
        )
        .drop("valid_rows")
    )


def check_accounting(accounting: DataFrame) -> None:
    """Raise when the counters do not reconcile (reads the single accounting row)."""
    row = accounting.first()
    if row["unreconciled_rows"] != 0:
        raise ValueError(f"row accounting differs by {row['unreconciled_rows']}")
    if row["explicit_pending_rows"] > 0 and row["pending_dockets"] == 0:
        raise ValueError("pending rows produced no censored dockets")


def check_lifecycles(lifecycles: DataFrame) -> None:
    """Raise when a docket that is not pending has no end (reads one row at most)."""
    if lifecycles.filter(~F.col("pending") & F.col("final_terminated_at").isNull()).select("docket_key").head(1):
        raise ValueError("a docket that is not pending has no end")


def with_cohorts(lifecycles: DataFrame, definitions: list[tuple[str, Column]]) -> DataFrame:
    """One row for each (docket, cohort it belongs to)."""
    members = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in definitions]))
    return lifecycles.withColumn("cohort", F.explode(members))


def cohort_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("included"),
        F.count_if(~F.col("pending")).alias("terminated"),
        F.count_if(F.col("pending")).alias("pending_at_snapshot"),
        F.count_if(F.col("mdl_docket_present")).alias("mdl_docket_present"),
    )


def disposition_histogram(members: DataFrame) -> DataFrame:
    return (
        members.filter(~F.col("pending"))
        .groupBy("cohort", F.coalesce("final_disposition", F.lit("missing")).alias("disposition"))
        .agg(F.count(F.lit(1)).alias("dockets"))
    )


def observations(members: DataFrame) -> DataFrame:
    """Two right-censored observations for each member: lifecycle and settlement clock."""
    pending = F.when(F.col("pending"), "pending_at_snapshot")
    lifecycle = F.struct(
        F.lit("lifecycle").alias("clock"),
        F.col("lifecycle_days").alias("days"),
        (~F.col("pending")).alias("event"),
        pending.alias("reason"),
    )
    settlement = F.struct(
        F.lit("settlement").alias("clock"),
        F.col("settlement_days").alias("days"),
        F.col("settled").alias("event"),
        F.when(~F.col("settled"), F.coalesce(pending, F.lit("other_termination_disposition"))).alias("reason"),
    )
    return members.select("cohort", F.inline(F.array(lifecycle, settlement)))


def survival_buckets(
    observed: DataFrame, groups: list[str], days: str = "days", event: str = "event"
) -> DataFrame:
    """Mergeable state: events and censored for each whole day. Negative or fractional days raise."""
    value = F.col(days)
    whole = value.cast("int")
    checked = F.when((whole == value) & (whole >= 0), whole).otherwise(
        F.raise_error(F.concat(F.lit("durations must be non-negative integers: "), value.cast("string"))).cast("int")
    )
    return (
        observed.select(*groups, checked.alias("days"), F.col(event).alias("_event"))
        .groupBy(*groups, "days")
        .agg(F.count_if(F.col("_event")).alias("events"), F.count_if(~F.col("_event")).alias("censored"))
    )


def censor_reasons(observed: DataFrame) -> DataFrame:
    return (
        observed.filter(~F.col("event"))
        .groupBy("cohort", "clock", "reason")
        .agg(F.count(F.lit(1)).alias("dockets"))
    )


def survival_curve(buckets: DataFrame, groups: list[str]) -> DataFrame:
    """Product-limit curve for each bucketed day. Windows see one row for each day, not each docket."""
    by_day = Window.partitionBy(*groups).orderBy("days")
    to_here = by_day.rowsBetween(Window.unboundedPreceding, 0)
    # All of the group less those before: linear, where a frame to the end is read anew for each row.
    left = F.col("events") + F.col("censored")
    before = F.coalesce(F.sum(left).over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_risk = F.sum(left).over(Window.partitionBy(*groups)) - before
    return buckets.withColumn("at_risk", at_risk).withColumn(
        "survival", F.product(1 - F.col("events") / F.col("at_risk")).over(to_here)
    )


def survival_quantiles(curve: DataFrame, groups: list[str]) -> DataFrame:
    """Counts, quantile days (null when unreached), follow-up and end survival for each group."""
    hit = F.col("events") > 0
    quantiles = [
        F.min(F.when(hit & (F.col("survival") <= level + QUANTILE_SLACK), F.col("days"))).alias(f"{name}_days")
        for name, level in QUANTILES
    ]
    summary = curve.groupBy(*groups).agg(
        F.sum(F.col("events") + F.col("censored")).alias("n"),
        F.sum("events").alias("events"),
        F.sum("censored").alias("censored"),
        *quantiles,
        F.max(F.when(hit, F.col("days"))).alias("last_event_days"),
        F.max("days").alias("last_observed_days"),
        F.round(F.max_by("survival", "days"), 6).alias("survival_at_end"),
    )
    months = [
        days_to_months(F.col(f"{name}_days")).alias(f"{name}_months") for name, _ in QUANTILES
    ]
    return summary.select("*", *months)


def kaplan_meier(
    observed: DataFrame, groups: list[str], days: str = "days", event: str = "event"
) -> DataFrame:
    """Quantile summary of right-censored observations for any grouping."""
    return survival_quantiles(survival_curve(survival_buckets(observed, groups, days, event), groups), groups)


def complete_cohorts(
    summary: DataFrame, definitions: list[tuple[str, Column]], clocks: tuple[str, ...] = ("lifecycle", "settlement")
) -> DataFrame:
    """Add a row with n = 0 for each (cohort, clock) without observations."""
    spark = summary.sparkSession
    wanted = spark.createDataFrame([(name, clock) for name, _ in definitions for clock in clocks], "cohort string, clock string")
    zero = ["n", "events", "censored"]
    return wanted.join(summary, ["cohort", "clock"], "left").fillna(0, zero).select(*summary.columns)


def serving_quantiles(
    summary: DataFrame, snapshot: str, cohort: str = DEFAULT_COHORT, **metadata: str
) -> DataFrame:
    """Months for the default cohort, one row for each clock, with source metadata attached."""
    extra = [F.lit(value).alias(name) for name, value in sorted(metadata.items())]
    return summary.filter(F.col("cohort") == cohort).select(
        "cohort", "clock", "n", "p25_months", "median_months", "p75_months",
        F.lit(snapshot).alias("snapshot_date"), *extra,
    )
