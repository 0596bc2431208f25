"""Cleaning and packing of the documents table: five stages, each one operator of docketlens.llm.

Every stage but the last returns the columns of documents; each is written as Parquet and read again by the next.

Defined results: a text that is null, empty or without a letter has no language and leaves with the first stage; rows that repeat each
other are near duplicates, of which one stays; rows of a null id are documents like others; an empty table gives no pieces. Columns besides those
of documents pass through every stage but the last, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.llm import dart_minhash, decontaminate, language_id, packing, secret_scan
from docketlens.llm.common import crc_class, table
from docketlens.session import written_once


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from four fifths of the labelled documents; those whose language it rejects go."""
    dictionaries = language_id.learn(docs.where(crc_class("doc_id", 5) != 0), "lang", "text")
    return language_id.identify(docs, "text", dictionaries).where("not rejected").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the least id."""
    return dart_minhash.keep_one(docs, "doc_id", "text")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; others stay as they are."""
    found = decontaminate.find_contamination(docs, "text", table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.hits(found)[1]).select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; the documents stay."""
    return secret_scan.redact(docs, "doc_id", "text", F.concat_ws("/", "source", "lang"), F.col("source"), length_column="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 4096 tokens."""
    pieces = packing.pack(docs, "text", ["doc_id"], public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pieces.select("doc.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("secrets", secrets), ("packed", packed)]
#: Compression, dart signatures and a tokenizer are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
