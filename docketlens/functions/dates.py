"""Strict date parsing and calendar arithmetic. Unparsable text is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlens.functions.text import bind, clean_text, strip

# Month names in calendar order, and mean days per month (365.2425 / 12).
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
DAYS_PER_MONTH = 365.2425 / 12
TWO_DIGIT_YEAR_PIVOT = 70


def extract_date(value: Column) -> Column:
    """``MM/DD/YYYY`` or ``YYYY-MM-DD``; blank, ``-8``, other text and years below 100 are null.

    Both shapes are rearranged to ISO text and cast: the cast checks the calendar and, unlike a
    pattern parser, does not raise and catch an exception for each bad value.
    """
    return stripped_date(strip(value))


def stripped_date(text: Column) -> Column:
    """``extract_date`` of a text that is stripped already, which is read several times here."""
    iso = F.when(
        text.rlike(r"^\d{2}/\d{2}/(?!00)\d{4}$"),
        F.concat(text.substr(7, 4), F.lit("-"), text.substr(1, 2), F.lit("-"), text.substr(4, 2)),
    ).when(text.rlike(r"^(?!00)\d{4}-\d{2}-\d{2}$"), text)
    return iso.try_cast("date")


def iso_date(value: Column) -> Column:
    """``YYYY-MM-DD`` only. A text without white space around it needs no cleaning."""
    plain = lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    cleaned = bind(clean_text(value), lambda t: F.when(plain(t), t.try_cast("date")))
    return F.when(plain(value), value.try_cast("date")).when(value.isNotNull(), cleaned)


def claim_date(value: Column) -> Column:
    """``M/D/YY`` or ``M/D/YYYY``; two-digit years pivot at 70."""

    def from_parts(parts: Column) -> Column:
        year = parts[2].cast("int")
        full = F.when(year >= 100, year).otherwise(
            year + F.when(year >= TWO_DIGIT_YEAR_PIVOT, 1900).otherwise(2000)
        )
        iso = F.concat_ws(
            "-", F.lpad(full.cast("string"), 4, "0"), F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0")
        )
        return iso.try_cast("date")

    def parse(text: Column) -> Column:
        fits = text.rlike(r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$")
        return F.when(fits, bind(F.split(text, "/"), from_parts))

    return bind(clean_text(value), parse)


def month_date(value: Column) -> Column:
    """``Month YYYY`` as ``YYYY-MM`` text."""
    names = F.array(*[F.lit(m) for m in MONTHS])

    def from_parts(parts: Column) -> Column:
        return bind(
            F.array_position(names, F.lower(parts[0])),
            lambda month: F.when(month > 0, F.concat_ws("-", parts[1], F.lpad(month.cast("string"), 2, "0"))),
        )

    return bind(
        clean_text(value),
        lambda text: F.when(text.rlike(r"^[A-Za-z]+ \d{4}$"), bind(F.split(text, " "), from_parts)),
    )


def claim_deadline(raw: Column, as_of: Column) -> Column:
    """Struct (raw, date, status past/upcoming/unknown); null when the text is blank."""

    def judge(parsed: Column) -> Column:
        date = parsed["date"]
        status = F.when(date.isNull(), "unknown").when(date < as_of, "past").otherwise("upcoming")
        return F.when(parsed["raw"] != "", F.struct(parsed["raw"].alias("raw"), date.alias("date"), status.alias("status")))

    return bind(F.struct(clean_text(raw).alias("raw"), claim_date(raw).alias("date")), judge)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def days_to_months(days: Column) -> Column:
    return F.round(days / F.lit(DAYS_PER_MONTH), 1)


def days_until(deadline: Column, as_of: Column) -> Column:
    """Calendar days from ``as_of``; negative once passed, null without a deadline."""
    return F.datediff(deadline.cast("date"), as_of)


def elapsed_months(filed: Column, as_of: Column) -> Column:
    whole = (F.year(as_of) - F.year(filed)) * 12 + F.month(as_of) - F.month(filed)
    return whole - F.when(F.dayofmonth(as_of) < F.dayofmonth(filed), 1).otherwise(0)


def urgency_band(days: Column) -> Column:
    """Bands over days until the deadline: today, closing soon (0-14), urgent (0-21), later, passed."""
    return (
        F.when(days.isNull(), "none")
        .when(days < 0, "passed")
        .when(days == 0, "today")
        .when(days <= 14, "closing_soon")
        .when(days <= 21, "urgent")
        .otherwise("later")
    )


def window_start(end: Column, *, years: int | None = None, days: int | None = None) -> Column:
    """Start of a lookback window ending at ``end``: calendar years (clamped to month end) or days."""
    if (years is None) == (days is None) or (years or days) < 1:
        raise ValueError("give a positive number of years or of days")
    return F.add_months(end, -12 * years) if years is not None else F.date_sub(end, days)
