"""Text, hashing and canonical-JSON column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the whitespace class of the reference's regular expressions, as a Java character class.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WHITESPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# ASCII word boundaries. Java's \b treats accented letters as word characters, so it is spelled out.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"



def strip(value: Column) -> Column:
    """Without white space of any kind at both ends; ``F.trim`` removes U+0020 alone."""
    return F.btrim(value, F.lit(WHITE))


def words(pattern: str) -> str:
    """Wrap ``pattern`` (which starts and ends with a word character) in ASCII word boundaries."""
    return f"{WORD_START}(?:{pattern}){WORD_END}"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(value: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed, null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), WHITESPACE + "+", " "))


def null_if_blank(value: Column) -> Column:
    return bind(value, lambda v: F.when(v != "", v))


def matches_any(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs in ``text``; its plain alternatives are looked up without a regex."""
    alternatives, depth, part = [], 0, ""
    for ch in pattern:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "|" and depth == 0:
            alternatives.append(part)
            part = ""
        else:
            part += ch
    alternatives.append(part)
    plain = [a for a in alternatives if re.fullmatch(r"[a-z0-9 \-]+", a)]
    rest = "|".join(a for a in alternatives if a not in plain)
    found = F.lit(False)
    for literal in plain:
        found = found | text.contains(literal)
    return found | text.rlike(rest) if rest else found


def _without_accents(value: Column) -> Column:
    # Defined inside, so that executors receive the code itself and need no copy of this package.
    def strip(values: pd.Series) -> pd.Series:
        marks = re.compile("[\u0300-\u036f]")
        return values.map(
            lambda text: None if text is None else marks.sub("", unicodedata.normalize("NFKD", text))
        )

    return F.pandas_udf(strip, StringType())(value)


def slugify(value: Column) -> Column:
    """ASCII slug of at most 100 characters.

    Spark has no Unicode decomposition, so that step alone runs in Python, and only texts
    with a non-ASCII character are handed over (the others are passed as null).
    """
    text = F.coalesce(value.cast("string"), F.lit(""))
    plain = F.coalesce(_without_accents(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
    dashed = F.regexp_replace(F.replace(F.lower(plain), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    return F.substring(F.btrim(dashed, F.lit("-")), 1, 100)


def short_hash(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)


def stable_bucket(value: Column, buckets: int = 5) -> Column:
    """Rolling base-31 hash over UTF-16 lead units, reduced to ``buckets``."""
    point = lambda ch: F.ascii(ch).cast("bigint")
    unit = lambda ch: F.when(
        point(ch) > 0xFFFF, F.lit(0xD800) + F.shiftright(point(ch) - 0x10000, 10)
    ).otherwise(point(ch))
    folded = F.aggregate(
        F.split(value, ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: F.when(ch == "", acc).otherwise(
            (acc * F.lit(31).cast("bigint") + unit(ch)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        ),
    )
    return (folded % buckets).cast("int")


def json_value(value: Column) -> Column:
    """One value as JSON text; null becomes ``null``. Struct fields must already be name-sorted."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object text with the names in sorted order and nulls kept."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def distinct_in_order(values: Column) -> Column:
    """Distinct array elements, first occurrence first."""
    return F.array_distinct(values)


def sorted_union(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_union(left, right))
