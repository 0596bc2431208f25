"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard is a bounded run of documents of one task. Words that no phrase of the benchmark holds cannot be part of an
occurrence, so the indexed sequence is the shard's runs of benchmark words, with separators between runs. The index is
the Burrows-Wheeler transform of that sequence in a wavelet matrix plus sampled suffix positions; all phrases are
searched backwards at once through its ranks, occurrences are located by walking to the next sampled position, and
overlapping occurrences merge into removal spans.

A phrase is a window of 13 consecutive words of a benchmark item, or the whole item where it has fewer. Documents are
never shuffled. The benchmark is read in blocks of a documented size; each block is one more pass over the documents.

Defined results: a null or empty text has no words and is clean; an item without words has no phrase; a null item id
is the empty text; items of equal id are one item; repeated documents have equal results; without any item all
documents are clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlens.llm.common import words_of

WINDOW = 13
#: Words of one index, which bounds a task's memory. One document may exceed it.
SHARD_WORDS = 1 << 19
#: Characters of benchmark text that are held at a time on the driver and in each task.
BLOCK_CHARS = 8_000_000
SAMPLE_EVERY = 16
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Phrases:
    """Distinct phrases over a word table; symbol 0 is the separator."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of((text or "").encode())]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.items = [sorted(v) for v in owners.values()]
        self.shortest = min(map(len, owners), default=0)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p in owners}):
            chosen = [(n, p) for n, p in enumerate(owners) if len(p) == length]
            self.by_length[length] = (np.array([n for n, _ in chosen]), np.array([p for _, p in chosen], dtype=np.int64))


class FMIndex:
    """Backward search and location over a sequence of symbols below ``sigma``; 0 separates, and ends the sequence."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.n = n = len(sequence)
        suffixes = _suffix_order(sequence)
        before = np.concatenate([sequence[-1:], sequence[:-1]])
        self.bwt = before[suffixes]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=sigma))])
        # A position after a separator is sampled too, so that no walk ever crosses one.
        sampled = (suffixes % SAMPLE_EVERY == 0) | (self.bwt == 0)
        self.sampled, self.sample_at = sampled, np.cumsum(sampled) - 1
        self.samples = suffixes[sampled].astype(np.int32)
        # Wavelet matrix: for each bit, from the highest, the zeros before each place; ones go behind the zeros.
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.bwt
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (row >> bit) & 1
            zeros = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(1 - ones, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            row = np.concatenate([row[ones == 0], row[ones == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low = np.zeros_like(at)
        for bit, zeros, n_zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            z_low, z_at = zeros[low], zeros[at]
            low = np.where(one, n_zeros + low - z_low, z_low)
            at = np.where(one, n_zeros + at - z_at, z_at)
        return at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases`` its interval of suffixes, empty if it does not occur."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, column]
            low[alive] = self.first[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes at ``rows``."""
        found = np.empty(len(rows), dtype=np.int64)
        waiting, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(waiting):
            done = self.sampled[rows]
            found[waiting[done]] = self.samples[self.sample_at[rows[done]]] + steps
            waiting, rows = waiting[~done], rows[~done]
            symbol = self.bwt[rows]
            rows = self.first[symbol] + self.rank(symbol, rows)
            steps += 1
        return found


def _suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. Each separator is a symbol of its own, in order of position."""
    n = len(sequence)
    stops = sequence == 0
    rank = np.where(stops, np.cumsum(stops) - 1, sequence + int(stops.sum()))
    order = np.argsort(rank, kind="stable")
    step = 0
    while True:
        later = rank
        if step:
            later = np.zeros(n, dtype=np.int64)
            later[: n - step] = rank[step:] + 1
            keys = rank.astype(np.int64) * (int(rank.max()) + 2) + later
            order = np.argsort(keys, kind="stable")
        else:
            keys = rank
        sorted_keys = keys[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        rank = new
        if int(rank.max()) == n - 1:
            return order
        step = max(1, step * 2)


def _shard_hits(runs: list[tuple[int, int, list[int]]], phrases: Phrases) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Merged spans and occurring items for each document of a shard. ``runs``: (document, first word, symbols)."""
    sequence = np.zeros(sum(len(s) + 1 for _, _, s in runs), dtype=np.int64)
    starts = np.empty(len(runs), dtype=np.int64)
    at = 0
    for k, (_, _, symbols) in enumerate(runs):
        starts[k] = at
        sequence[at : at + len(symbols)] = symbols
        at += len(symbols) + 1
    index = FMIndex(sequence, len(phrases.symbols) + 1)
    change = np.zeros(len(sequence) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for length, (numbers, rows) in phrases.by_length.items():
        low, high = index.search(rows)
        count = high - low
        hit = np.flatnonzero(count)
        if not len(hit):
            continue
        count = count[hit]
        begin = np.repeat(np.cumsum(count) - count, count)
        places = index.locate(np.repeat(low[hit], count) + np.arange(int(count.sum())) - begin)
        np.add.at(change, places, 1)
        np.add.at(change, places + length, -1)
        run = np.searchsorted(starts, places, side="right") - 1
        phrase = np.repeat(numbers[hit], count)
        for r, p in np.unique(np.stack([run, phrase]), axis=1).T.tolist():
            items.setdefault(runs[r][0], set()).update(phrases.items[p])
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.diff(covered)
    spans: dict[int, list[tuple[int, int]]] = {}
    for begin, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        r = int(np.searchsorted(starts, begin, side="right")) - 1
        document, first, _ = runs[r]
        offset = first - int(starts[r])
        spans.setdefault(document, []).append((begin + offset, end + offset))
    return spans, items


def _runs(words: list[bytes], symbols: dict[bytes, int], shortest: int) -> list[tuple[int, list[int]]]:
    """Maximal runs of known words that are long enough to hold a phrase."""
    found, run = [], []
    known = [symbols.get(w, 0) for w in words]
    if not any(known):
        return []
    for i, symbol in enumerate([*known, 0]):
        if symbol:
            run.append(symbol)
        elif run:
            if len(run) >= shortest:
                found.append((i - len(run), run))
            run = []
    return found


def batch_hits(texts: list[bytes | None], phrases: Phrases, shard_words: int = SHARD_WORDS):
    """(number of words, spans, items) for each text."""
    counts, spans, items = [], {}, {}
    runs: list[tuple[int, int, list[int]]] = []
    held = 0

    def flush():
        if runs:
            more_spans, more_items = _shard_hits(runs, phrases)
            spans.update(more_spans)
            items.update(more_items)

    for d, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if phrases.shortest:
            for first, symbols in _runs(words, phrases.symbols, phrases.shortest):
                runs.append((d, first, symbols))
                held += len(symbols)
        if held >= shard_words:
            flush()
            runs.clear()
            held = 0
    flush()
    return counts, [spans.get(d, []) for d in range(len(texts))], [sorted(items.get(d, ())) for d in range(len(texts))]


def _merged(one: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted([*one, *other]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of about ``block_chars`` characters, one block on the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_chars))
    for b in range(blocks):
        yield [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()]


def find_contamination(
    docs: DataFrame, text_column: str, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text",
    carry: list[str] | None = None, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc, n_words, spans, items): ``doc`` holds the columns ``carry`` (all, if None) of each row of ``docs``.

    ``spans`` are merged [start, end) word positions of all occurrences, ``items`` the ids of the occurring items as text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text_column).alias("text"))
    rows = rows.select("doc", "text", F.lit(0).alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_chars)
    for block in blocks:
        held = spark.sparkContext.broadcast((block, window))

        def mark(batches, held=held):
            phrases = Phrases(*held.value)
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                counts, spans, items = batch_hits(texts, phrases)
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                spans = [s if not o else _merged(s, [(x["start"], x["end"]) for x in o]) for s, o in zip(spans, old_spans, strict=True)]
                items = [i if not o else sorted({*i, *o}) for i, o in zip(items, old_items, strict=True)]
                marked = [[{"start": a, "end": b} for a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("text"), pa.array(counts, pa.int32()), pa.array(marked, _ARROW_SPANS), pa.array(items, pa.list_(pa.string()))],
                    names=["doc", "text", "n_words", "spans", "items"],
                )

        rows = rows.mapInArrow(mark, rows.schema)
    return rows.drop("text")


def hits(found: DataFrame):
    """Columns of the contamination rule over ``find_contamination``'s rows: words hit, and whether they are many enough."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return n_hit, (n_hit > 0) & (n_hit * 20 >= F.col("n_words"))
