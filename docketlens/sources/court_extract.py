"""Tab-delimited court extract: header row, no quoting, ragged rows allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.functions.text import strip
from docketlens.operators.survival import REQUIRED_COLUMNS, check_required

# File order of a row: file, split within the file, row within the split.
ROW_ORDER = ["_file", "_split", "_row"]


def read_court_extract(spark: SparkSession, path: str) -> DataFrame:
    """All required columns as strings, plus the ``ROW_ORDER`` columns.

    Every file starts with the same header line; lines equal to it are not data. Missing cells are
    empty strings, blank lines are skipped.
    """
    text = spark.read.text(path)
    lines = text.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    ).filter(F.col("value").rlike("[^\\s\\x{00a0}\\x{feff}]"))
    # Each file's first line must be the same header: cells are read by position.
    heads = lines.groupBy("_file").agg(F.min_by("value", F.struct("_split", "_row")).alias("value"))
    headers = heads.select(F.regexp_replace("value", "^\\x{feff}", "").alias("value")).distinct().limit(2).collect()
    if not headers:
        raise ValueError("court extract has no header row")
    if len(headers) > 1:
        raise ValueError("the files of a court extract have different headers")
    header = headers[0]["value"]
    names = [name.strip() for name in header.lstrip("﻿").split("\t")]
    check_required(names)
    index = {name: at for at, name in enumerate(names)}
    cells = F.split(F.col("value"), "\t", -1)
    cell = lambda name: F.coalesce(strip(F.get(F.col("_cells"), index[name])), F.lit(""))
    body = F.regexp_replace(F.col("value"), "^\\x{feff}", "") != F.lit(header.lstrip("﻿"))
    return (
        lines.filter(body)
        .select(cells.alias("_cells"), *ROW_ORDER)
        .select(*[cell(name).alias(name) for name in REQUIRED_COLUMNS], *ROW_ORDER)
    )


def write_court_extract(rows: DataFrame, path: str) -> None:
    """Write the required columns back as headed tab-delimited text."""
    (
        rows.select(*REQUIRED_COLUMNS)
        .write.mode("errorifexists")
        .option("header", "true").option("sep", "\t").option("quote", "\u0000").option("emptyValue", "")
        .csv(path)
    )
