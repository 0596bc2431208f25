"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled text. A text is encoded
with the dictionary of each language, in blocks of a few kilobytes so that the dictionary matters as much at the end
of a long text as at its start; the language of the smallest encoding wins. Where the runner-up needs hardly more
bytes, the decision is rejected.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected; ties go to the language
with more training text, then to the smaller name; with no labelled text at all every text is ``und``. Null labels are
not learned from. Repeated rows get equal results.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import WORD_BYTES

UNKNOWN = "und"
#: Bytes of normalized text in each dictionary.
DICTIONARY_BYTES = 256 * 1024
#: Binary digits of the hash in whose order texts are drawn.
DRAW_BITS = 30
#: Languages that may be learned; more are an error, as each costs one encoding of every text.
MOST_LANGUAGES = 500
BLOCK_BYTES = 32 * 1024
#: Greedy matching from four bytes on: stems are short, and the fastest levels only look for longer matches.
ENCODING = dict(
    window_log=20, chain_log=18, hash_log=18, search_log=4, min_match=4, target_length=16,
    strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0, write_checksum=0,
)
#: A decision is rejected if the runner-up's encoding is larger by less than this share.
MARGIN = 0.004
#: What ``normalized`` keeps something of: a letter, a digit or anything beyond ASCII.
_KEPT = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_LETTER = regex.compile(r"\p{L}")


def normalized(text: str) -> bytes:
    """Lower case, letters and digits only, single spaces."""
    return b" ".join(text.lower().encode().translate(WORD_BYTES).split())


def learn(labelled: DataFrame, lang_column: str, text_column: str, dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary), languages with more text first.

    Bytes are counted over distinct texts of all labelled rows. Each language's texts are taken in the order of a hash,
    until their normalized bytes fill the dictionary or all are taken, so that every language with text has one.
    Only the first ``dictionary_bytes`` of those texts come to the driver.
    """
    rows = labelled.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).where("lang is not null and text is not null")
    # Texts of marks alone leave nothing for a dictionary, however many are drawn.
    rows = rows.where(F.col("text").rlike(_KEPT))
    digest = F.xxhash64(F.lit("draw"), "text")
    draw = F.pmod(digest, F.lit(1 << DRAW_BITS))
    # A copied text counts and is drawn once, however often it stands in the corpus.
    texts = rows.groupBy("lang", digest.alias("digest"), F.length(F.bin(draw)).alias("bits")).agg(F.max(F.octet_length("text")).alias("n"))
    # One row for each language and binary digits of the draw, so the limit holds more rows than MOST_LANGUAGES can have.
    told = texts.groupBy("lang", "bits").agg(F.sum("n").cast("long").alias("n")).limit((MOST_LANGUAGES + 1) * DRAW_BITS).collect()
    below: dict[str, list[int]] = {}
    for r in told:
        below.setdefault(r["lang"], [0] * (DRAW_BITS + 1))[r["bits"]] = r["n"]
    if len(below) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = {name: sum(n) for name, n in below.items()}
    # The fewest binary digits below which a language's texts hold a little more than its dictionary.
    wanted = dictionary_bytes * 5 // 4
    bits = {name: next((b for b in range(DRAW_BITS) if sum(n[: b + 1]) >= wanted), DRAW_BITS) for name, n in below.items()}
    parts: dict[str, bytes] = {}
    while bits:
        share = F.create_map(*[x for name, b in bits.items() for x in (F.lit(name), F.lit(1 << b))])
        drawn = rows.select("lang", "text", draw.alias("draw")).where(F.col("draw") < F.element_at(share, F.col("lang"))).distinct()

        def run(batches):
            for batch in batches:
                found = [normalized(t.as_py())[:dictionary_bytes] for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(found, pa.binary())], names=["lang", "draw", "content"])

        held: dict[str, list[bytes]] = {name: [] for name in bits}
        kind = drawn.select("lang", "draw", F.lit(b"").alias("content")).schema
        for r in sorted(drawn.mapInArrow(run, kind).collect(), key=lambda r: (r["lang"], r["draw"], r["content"])):
            held[r["lang"]].append(r["content"])
        parts.update((name, b" ".join(filter(None, contents))[:dictionary_bytes]) for name, contents in held.items())
        # Texts of much punctuation fill less than their bytes: those languages draw twice as many.
        bits = {name: b + 1 for name, b in bits.items() if b < DRAW_BITS and len(parts[name]) < dictionary_bytes}
    order = sorted(sizes, key=lambda name: (-sizes[name], name))
    return [(name, parts[name]) for name in order if parts[name]]


class Detector:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.names, self.encoders = [], []
        settings = zstandard.ZstdCompressionParameters(**ENCODING)
        for name, content in dictionaries:
            if not content:
                continue
            if len(content) < 8:  # the shortest raw dictionary there is
                content = b" ".join([content] * 8)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.names.append(name)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))

    def detect(self, text: str | None) -> tuple[str, float]:
        """(language, margin): by what share the runner-up's encoding is larger."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0
        content = normalized(text)
        blocks = [content[i : i + BLOCK_BYTES] for i in range(0, len(content), BLOCK_BYTES)] or [text.lower().encode()]
        sizes = sorted((sum(len(e.compress(b)) for b in blocks), k) for k, e in enumerate(self.encoders))
        best = sizes[0]
        margin = (sizes[1][0] - best[0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        return self.names[best[1]], margin


def identify(docs: DataFrame, text_column: str, dictionaries: list[tuple[str, bytes]], carry: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc, lang_pred, score, rejected): ``doc`` holds the columns ``carry`` (all, if None) of each row of ``docs``.

    ``score`` is the margin, 0 to 1. ``dictionaries`` are bounded by MOST_LANGUAGES times their size.
    """
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text_column).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        detector = Detector(held.value)
        for batch in batches:
            found = [detector.detect(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([n for n, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64()),
                 pa.array([n == UNKNOWN or m < margin for n, m in found], pa.bool_())],
                names=["doc", "lang_pred", "score", "rejected"],
            )

    kind = rows.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return rows.mapInArrow(run, kind)
