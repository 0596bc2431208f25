"""Column helpers shared by the operators of this folder.

Conventions that hold for all of them: an operator reads only the columns it is told to read, so other columns of
any name are ignored; its own working columns never meet those of the caller, as it first selects into fresh names;
rows that repeat each other are separate documents with equal results; a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte table: A-Z to a-z, other ASCII that is no digit or letter to a space; bytes from 0x80 stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Byte table: A-Z to a-z and nothing else.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def document_key(id_column: str, text_column: str) -> Column:
    """128 bits that name a document by id and text: never null, evenly spread, equal only for equal rows."""
    parts = [F.col(id_column).cast("string"), F.col(text_column)]
    nulls = [F.col(id_column).isNull(), F.col(text_column).isNull()]
    return F.struct(
        F.xxhash64(F.lit(1), *nulls, *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts), *nulls).alias("b")
    )


def crc_class(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
