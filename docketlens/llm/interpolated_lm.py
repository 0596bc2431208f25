"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how often the context was seen: contexts
fall into buckets by the power of two of their count. The weights are learned by expectation-maximisation on deleted
counts: each training token is held out in turn, that is, taken off the counts that predict it.

    p(w | v) = l2(v) * p2(w | v) + l1(v) * c(w) / N + l0(v) / (V + 1)

Every training word has its own place in the bigrams; words below a larger ``min_count`` share one class: p2(w | v) = c(v, class) / c(v) * c(w) / c(class). Counts are exact
and cover the whole corpus; the tables grow with it, and no machine ever holds them:

1. Each task turns its documents into blocks of word numbers, and asks, for each slice of the hash space, for the counts
   of its distinct words, adding its own. Requests are compressed sorted arrays, a few bytes for each distinct word.
2. Each slice sums its requests and answers each block with the corpus counts and codes of the words it asked about.
3. With the answers each block asks likewise for its distinct bigrams of codes.
4. Each slice answers with the bigram counts, and sums what the mixture weights are learned from.
5. Each block scores its documents.

Every step's result is written to the shared folder before the next reads it, so that lost executors repeat one step
at most. Tokens are ``[^\\x20\\x09-\\x0D]+`` in A-Z lower case and one end token for each document, which is also the context of
the first word. Defined results: a null or empty text is its end token alone; repeated rows count and are scored each;
without training rows every estimate is uniform.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import LOWER_BYTES
from docketlens.session import written_once

END = b"\n"  # no word can hold it
MIN_COUNT = 1
#: Tokens of a block; bounds a task's memory.
BLOCK_TOKENS = 1_500_000
EM_ROUNDS = 60
_RARE = 0  # the code of the class of rare and unseen words


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then zstandard: small numbers cost little more than their entropy."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(data: bytes, dtype) -> np.ndarray:
    planes = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().reshape(-1).view(dtype)


def _pack_sorted(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    return pickle.dumps((_squeeze(steps), _squeeze(counts.astype(np.uint32))))


def _unpack_sorted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = pickle.loads(data)
    return np.cumsum(_expand(steps, np.uint64), dtype=np.uint64), _expand(counts, np.uint32).astype(np.int64)


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each slice of the key space begins in sorted 64-bit keys; the slices are even ranges."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Bigram keys spread evenly and reversibly over 64 bits (multiplication by an odd number, high bits folded in)."""
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class _Block:
    """Documents of a block as numbers into its distinct words, which are sorted by hash."""

    def __init__(self, doc_type: pa.DataType | None = None):
        self.doc_type = doc_type
        self.words: dict[bytes, int] = {END: 0}
        self.tokens: list[np.ndarray] = []
        self.documents: list = []
        self.lengths: list[int] = []
        self.trains: list[bool] = []
        self.size = 0

    def add(self, document, text: bytes | None, train: bool) -> None:
        number = self.words
        found = [number.setdefault(w, len(number)) for w in text.translate(LOWER_BYTES).split()] if text else []
        found.append(0)
        self.tokens.append(np.array(found, dtype=np.uint32))
        self.documents.append(document)
        self.lengths.append(len(found))
        self.trains.append(train)
        self.size += len(found)

    def finish(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(payload, hashes, training counts)."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), dtype=np.uint64, count=len(self.words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        tokens = place[np.concatenate(self.tokens)]
        lengths = np.array(self.lengths, dtype=np.uint32)
        in_training = np.repeat(np.array(self.trains), lengths)
        counts = np.bincount(tokens[in_training], minlength=len(order))
        payload = pickle.dumps((self.documents, self.doc_type, lengths, np.array(self.trains), int(place[0]), _squeeze(tokens)))
        return payload, hashes[order], counts


def _number_words(batches, parts: int, block_tokens: int):
    task, number, block = TaskContext.get().partitionId(), 0, _Block()

    def rows(block: _Block, number: int) -> pa.RecordBatch:
        payload, hashes, counts = block.finish()
        cuts = _slices(hashes, parts)
        asked = [_pack_sorted(hashes[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(task << 24) + number] * (parts + 1), pa.int64()), pa.array([-1, *range(parts)], pa.int32()),
                pa.array([payload] + [None] * parts, pa.binary()), pa.array([None, *asked], pa.binary()),
            ],
            names=["block", "part", "docs", "asked"],
        )

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        block.doc_type = batch.column("doc").type
        for document, text, train in zip(batch.column("doc").to_pylist(), texts.to_pylist(), batch.column("train").to_pylist(), strict=True):
            block.add(document, text, bool(train))
            if block.size >= block_tokens:
                yield rows(block, number)
                block, number = _Block(block.doc_type), number + 1
    if block.size:
        yield rows(block, number)


def _summed(asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts. Requests are folded in as they come, so that a key is held once."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    waiting, held = [], 0
    for k, c in [*asked, (None, None)]:
        if k is not None:
            waiting.append((k, c))
            held += len(k)
        if held > max(2_000_000, len(keys)) or k is None:
            together = np.concatenate([keys, *(x for x, _ in waiting)])
            order = np.argsort(together, kind="stable")
            sums = np.concatenate([counts, *(x for _, x in waiting)])[order]
            together = together[order]
            first = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1]])) if len(together) else np.empty(0, np.int64)
            keys, counts = together[first], np.add.reduceat(sums, first) if len(first) else np.empty(0, np.int64)
            waiting, held = [], 0
    return keys, counts


def _answer_words(table: pa.Table, parts: int, min_count: int) -> pa.Table:
    part = table.column("part")[0].as_py()
    blocks, asked = table.column("block").to_pylist(), table.column("asked").to_pylist()
    keys, counts = _summed([_unpack_sorted(a) for a in asked])
    common = counts >= min_count
    room = (1 << 32) // parts
    if int(common.sum()) >= room - 1:
        raise ValueError("more frequent words in a slice than codes: raise spark.sql.shuffle.partitions or min_count")
    codes = np.where(common, part * room + np.cumsum(common), _RARE).astype(np.uint32)
    answers = []
    for a in asked:
        at = np.searchsorted(keys, _unpack_sorted(a)[0])
        answers.append(pickle.dumps((_squeeze(counts[at]), _squeeze(codes[at]))))
    n = len(blocks)
    rare = ~common & (counts > 0)
    totals = [int((counts > 0).sum()), int(counts.sum()), int(counts[rare].sum()), int(rare.sum()), int((counts == 1).sum())]
    columns = [pa.array(blocks + [-1], pa.int64()), pa.array([part] * (n + 1), pa.int32()), pa.array([*answers, None], pa.binary())]
    columns += [pa.array([None] * n + [t], pa.int64()) for t in totals]
    return pa.Table.from_arrays(columns, names=["block", "part", "words", "distinct", "total", "rare", "rare_distinct", "once"])


class _Open:
    """A block's documents with the corpus counts and codes of its words."""

    def __init__(self, table: pa.Table):
        docs, words = None, {}
        for row in table.select(["part", "docs", "words"]).to_pylist():
            if row["docs"] is not None:
                docs = pickle.loads(row["docs"])
            elif row["words"] is not None:
                words[row["part"]] = pickle.loads(row["words"])
        self.documents, self.doc_type, self.lengths, self.trains, end, tokens = docs
        self.lengths = self.lengths.astype(np.int64)
        self.tokens = _expand(tokens, np.uint32)
        self.counts = np.concatenate([_expand(words[p][0], np.int64) for p in sorted(words)])
        self.codes = np.concatenate([_expand(words[p][1], np.uint32) for p in sorted(words)])
        # The token before the first of a document is the end of another.
        before = np.concatenate([[end], self.tokens[:-1]]).astype(np.uint32)
        before[np.cumsum(self.lengths) - self.lengths] = end
        self.before = before
        pairs = (self.codes[before].astype(np.uint64) << np.uint64(32)) | self.codes[self.tokens].astype(np.uint64)
        self.keys, self.pair_of = np.unique(pairs, return_inverse=True)
        self.order = np.argsort(_mixed(self.keys), kind="stable")

    def grade(self, pick: np.ndarray, rare: int) -> np.ndarray:
        """Eighths of the binary logarithm of each distinct pair's context (0) or word (1) count."""
        side = [self.before, self.tokens][int(pick)]
        count = np.zeros(len(self.keys), dtype=np.int64)
        count[self.pair_of] = np.where(self.codes[side] == _RARE, rare, self.counts[side])
        return np.round(8 * np.log2(np.maximum(count, 1))).astype(np.uint8)


def _ask_pairs(table: pa.Table, parts: int, rare: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    opened = _Open(table)
    in_training = np.repeat(opened.trains, opened.lengths)
    counts = np.bincount(opened.pair_of[in_training], minlength=len(opened.keys))
    context, word = opened.grade(0, rare), opened.grade(1, rare)
    mixed = _mixed(opened.keys)[opened.order]
    cuts = _slices(mixed, parts)
    asked = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        # Within a slice pairs go by their codes, which lie closer together than mixed keys.
        mine = np.sort(opened.order[a:b])
        asked.append(pickle.dumps((_pack_sorted(opened.keys[mine], counts[mine]), _squeeze(context[mine]), _squeeze(word[mine]))))
    return pa.table({"block": pa.array([block] * parts, pa.int64()), "part": pa.array(range(parts), pa.int32()), "asked": pa.array(asked, pa.binary())})


_PAIR_ROWS = "block long, part int, pairs binary, context int, r2 int, r1 int, weight double"


def _answer_pairs(table: pa.Table, distinct: int, total: int, rare: int, rare_distinct: int, once: int) -> pa.Table:
    part = table.column("part")[0].as_py()
    blocks, asked = table.column("block").to_pylist(), [pickle.loads(a) for a in table.column("asked").to_pylist()]
    keys, counts = _summed([_unpack_sorted(a) for a, _, _ in asked])
    context, word = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
    answers = []
    for a, c, w in asked:
        at = np.searchsorted(keys, _unpack_sorted(a)[0])
        context[at], word[at] = _expand(c, np.uint8), _expand(w, np.uint8)
        answers.append(_squeeze(counts[at].astype(np.uint32)))
    # Deleted estimates of each training pair, as ratios to the uniform one in quarters of powers of two; -999 is zero.
    on = counts > 0
    c, cv, cw = counts[on].astype(float), np.exp2(context[on] / 8.0), np.exp2(word[on] / 8.0)
    is_rare = (keys[on] & np.uint64(0xFFFFFFFF)) == _RARE
    spread = np.where(is_rare, 1.0 / max(1, rare_distinct), 1.0)
    p2 = (c - 1) / np.maximum(cv - 1, 1) * spread * (distinct + 1)
    p1 = np.maximum(cw - 1, 0) / max(1, total - 1) * spread * (distinct + 1)
    lone = np.where(is_rare, once / max(1, rare), 0.0)  # of rare tokens, those whose word is seen nowhere else
    grade = lambda p: np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-60))), -999).astype(np.int64)
    bucket = (context[on] // 8).astype(np.int64)
    rows = np.concatenate([np.stack([bucket, grade(p2), grade(p1)]), np.stack([bucket, np.full(len(c), -999), np.full(len(c), -999)])], axis=1)
    weights = np.concatenate([c * (1 - lone), c * lone])
    rows, weights = rows[:, weights > 0], weights[weights > 0]
    kinds, which = np.unique(rows, axis=1, return_inverse=True)
    sums = np.bincount(which.reshape(-1), weights=weights, minlength=kinds.shape[1])
    n, m = len(blocks), kinds.shape[1]
    return pa.Table.from_arrays(
        [
            pa.array(blocks + [-1] * m, pa.int64()), pa.array([part] * (n + m), pa.int32()), pa.array(answers + [None] * m, pa.binary()),
            *(pa.array([None] * n + kinds[k].tolist(), pa.int32()) for k in range(3)), pa.array([None] * n + sums.tolist(), pa.float64()),
        ],
        names=["block", "part", "pairs", "context", "r2", "r1", "weight"],
    )


def learn_weights(kinds: list[tuple[int, int, int, float]], rounds: int = EM_ROUNDS) -> dict[int, tuple[float, float, float]]:
    """Mixture weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation.

    ``kinds``: (bucket, bigram ratio, unigram ratio, weight), ratios to the uniform estimate in quarters of powers of two.
    Bucket -1 is all contexts together.
    """
    value = lambda g: 0.0 if g == -999 else 2.0 ** (g / 4)
    by: dict[int, list[tuple[float, float, float, float]]] = {}
    for bucket, r2, r1, weight in kinds:
        for b in (bucket, -1):
            by.setdefault(b, []).append((value(r2), value(r1), 1.0, weight))
    found = {}
    for bucket, rows in by.items():
        p = np.array(rows)
        mix = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p[:, :3] * mix
            share *= (p[:, 3] / share.sum(axis=1))[:, None]
            mix = share.sum(axis=0) / p[:, 3].sum()
        mix = np.maximum(mix, [0, 0, 1e-9])
        found[bucket] = tuple((mix / mix.sum()).tolist())
    return found


def _score(table: pa.Table, weights: dict, distinct: int, total: int, rare: int) -> pa.Table:
    opened = _Open(table)
    pair_rows = {r["part"]: r["pairs"] for r in table.select(["part", "pairs"]).to_pylist() if r["pairs"] is not None}
    cuts = _slices(_mixed(opened.keys)[opened.order], len(pair_rows))
    counts = np.zeros(len(opened.keys), dtype=np.int64)
    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        counts[np.sort(opened.order[a:b])] = _expand(pair_rows[p], np.uint32)
    own = opened.counts[opened.tokens].astype(float)
    seen = np.where(opened.codes[opened.before] == _RARE, rare, opened.counts[opened.before]).astype(float)
    share = np.where(opened.codes[opened.tokens] == _RARE, own / max(1, rare), 1.0)
    p2 = np.where(seen > 0, counts[opened.pair_of] / np.maximum(seen, 1) * share, 0.0)
    uniform = 1.0 / (distinct + 1)
    p1 = own / total if total else np.full(len(own), uniform)
    bucket = np.round(8 * np.log2(np.maximum(seen, 1))).astype(np.int64) // 8
    every = weights.get(-1, (0.0, 0.0, 1.0))
    mix = np.array([weights.get(b, every) for b in range(int(bucket.max()) + 1)])
    mix = mix[bucket]
    # An unseen context has no bigram estimate: its weight goes to the others.
    mix[seen == 0, 0] = 0
    mix /= mix.sum(axis=1, keepdims=True)
    score = np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] * uniform)
    base = np.log10((own + 1) / (total + distinct + 1))
    begin = np.cumsum(opened.lengths) - opened.lengths
    total_of = lambda x: np.add.reduceat(x, begin)
    return pa.table(
        {
            "doc": pa.array(opened.documents, opened.doc_type), "n_tokens": pa.array(opened.lengths, pa.int64()),
            "n_known": pa.array(total_of((own > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([total] * len(begin), pa.int64()),
            "base_score": pa.array(total_of(base), pa.float64()), "score": pa.array(total_of(score), pa.float64()),
        }
    )


def score(
    docs: DataFrame, text_column: str, train: Column, carry: list[str] | None = None,
    min_count: int = MIN_COUNT, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(doc, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of each whole text.

    ``train`` says which rows are learned from; ``doc`` holds the columns ``carry`` (all, if None). ``base_score`` is the
    add-one unigram estimate. The hash space has as many slices as spark.sql.shuffle.partitions, as any shuffle.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text_column).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    doc_kind = rows.schema["doc"].dataType.simpleString()

    first = written_once(rows.mapInArrow(lambda b: _number_words(b, parts, block_tokens), "block long, part int, docs binary, asked binary"), "lm-words")
    blocks = first.where("part = -1").select("block", "part", "docs")
    word_rows = "block long, part int, words binary, distinct long, total long, rare long, rare_distinct long, once long"
    asked = first.where("part >= 0").select("block", "part", "asked")
    answered = written_once(asked.groupBy("part").applyInArrow(lambda t: _answer_words(t, parts, min_count), word_rows), "lm-word-counts")
    names = ["distinct", "total", "rare", "rare_distinct", "once"]
    totals = answered.where("block = -1").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    sizes = {n: int(totals[n]) for n in names}

    nothing = F.lit(None).cast("binary")
    opened = blocks.withColumn("words", nothing).unionByName(answered.where("block >= 0").select("block", "part", nothing.alias("docs"), "words"))
    pairs = opened.groupBy("block").applyInArrow(lambda t: _ask_pairs(t, parts, sizes["rare"]), "block long, part int, asked binary")
    pair_counts = written_once(pairs.groupBy("part").applyInArrow(lambda t: _answer_pairs(t, **sizes), _PAIR_ROWS), "lm-pair-counts")
    # Grades are small numbers, so that the distinct rows are bounded whatever the corpus.
    graded = pair_counts.where("block = -1").groupBy("context", "r2", "r1").agg(F.sum("weight").alias("weight"))
    weights = learn_weights([(r["context"], r["r2"], r["r1"], r["weight"]) for r in graded.sort("context", "r2", "r1").collect()])

    whole = opened.withColumn("pairs", nothing).unionByName(
        pair_counts.where("block >= 0").select("block", "part", nothing.alias("docs"), nothing.alias("words"), "pairs")
    )
    out = f"doc {doc_kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.groupBy("block").applyInArrow(lambda t: _score(t, weights, sizes["distinct"], sizes["total"], sizes["rare"]), out)

