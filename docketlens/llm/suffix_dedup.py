"""Exact substring deduplication by a hash-compared suffix sort.

A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere in the corpus, the same document
included. Sorting all suffixes brings equal strings side by side; to do so on many machines, only suffixes that may
have an equal meet:

1. Every window of ``length`` bytes is named by the smallest hash among its ``GRAM``-byte strings, its anchor. Equal
   windows have equal anchors; consecutive windows of one anchor are one context, about one for each 85 bytes.
2. Anchors are counted over the corpus. A context whose anchor stands nowhere else holds no repeated window and ends
   here. A context that another one equals as a whole (by a 128-bit digest) is repeated as a whole.
3. The windows of the other contexts are sorted as suffixes, one of each set of equal contexts: a mergesort whose
   comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours
   that agree in ``length`` bytes are compared byte by byte, which settles hash collisions.
4. An anchor with more than ``MOST_CONTEXTS`` different contexts (a short line that stands in a third of all documents)
   is split by the digest of each window, so that no task holds all of it.
5. The repeated windows of each document merge into spans, and its text is cut.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; repeated rows are copies of each other,
so whatever is long enough goes from all of them; all copies go, the first one too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.session import written_once

LENGTH = 200
GRAM = 32
#: Different contexts of one anchor that one task sorts together.
MOST_CONTEXTS = 4096
#: Suffixes that are sorted at a time, in whole anchors; an anchor with more is sorted alone.
SORT_SUFFIXES = 150_000
#: Bytes of contexts that go out together.
SENT_BYTES = 4 << 20
_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -m, 1 << 64))])
        return self.up, self.down


_powers = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64."""
    up, _ = _powers.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchors, first windows, numbers of windows, digests, selves) of a text.

    ``selves`` marks contexts whose anchor stands more than once inside, as in periodic text: only these may hold a
    window twice.
    """
    n = len(text)
    if n < length:
        return [], [], [], [], []
    data = np.frombuffer(text, np.uint8)
    sums = prefix_hashes(data)
    _, down = _powers.to(n + 1)
    grams = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    grams = (grams ^ (grams >> np.uint64(31))) * _MULTIPLIER
    grams ^= grams >> np.uint64(29)
    width = length - gram + 1
    least = _sliding(grams, width, np.minimum)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(starts, append=len(least))
    anchors = least[starts]
    # A gram is an anchor place if it is the least of some window over it: the largest of those leasts.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(grams == _sliding(padded, width, np.maximum))
    values = grams[places]
    order = np.argsort(values, kind="stable")
    same = (values[order][1:] == values[order][:-1]) & (places[order][1:] - places[order][:-1] <= counts.max() + width)
    selves = np.zeros(len(starts), bool)
    for i in np.flatnonzero(same).tolist():
        one, two = places[order[i]], places[order[i + 1]]
        a = np.searchsorted(starts, max(0, one - width + 1), side="right") - 1
        b = np.searchsorted(starts, min(two, len(least) - 1), side="right")
        selves[a:b] |= anchors[a:b] == values[order[i]]
    ends = (starts + counts - 1 + length).tolist()
    begin = starts.tolist()
    digests = [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin, ends, strict=True)]
    return anchors.view(np.int64), starts, counts, digests, selves


class SuffixSorter:
    """Sorts suffixes of one byte sequence by their first ``length`` bytes; each suffix must have that many."""

    def __init__(self, data: bytes, length: int = LENGTH):
        self.data = np.frombuffer(data, np.uint8)
        self.length = length
        self.sums = prefix_hashes(self.data)
        self.up, _ = _powers.to(len(data) + 1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a and b, ``length`` at most: the longest equal hash, by binary search."""
        low, high = np.zeros(len(a), np.int32), np.full(len(a), self.length, np.int32)
        # Bring both hashes to one power of the base: that of the later suffix.
        later = np.maximum(a, b)
        lift_a, lift_b = self.up[later - a], self.up[later - b]
        base_a, base_b = self.sums[a], self.sums[b]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            equal = (self.sums[a + middle] - base_a) * lift_a == (self.sums[b + middle] - base_b) * lift_b
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, ties: bool | np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; for equal ones ``ties``."""
        common = self.extension(a, b)
        equal = common == self.length
        at = np.where(equal, 0, common)
        return np.where(equal, ties, self.data[a + at] < self.data[b + at])

    def sort(self, suffixes: np.ndarray) -> np.ndarray:
        """Mergesort, all merges of a level at once. Runs begin as suffixes that share their first eight bytes."""
        first = np.zeros(len(suffixes), np.uint64)
        for k in range(min(8, self.length)):
            first = (first << np.uint64(8)) | self.data[suffixes + k]
        begin = np.argsort(first, kind="stable")
        order, first = suffixes[begin], first[begin]
        del begin
        # Places fit 32 bits: a task holds far fewer bytes.
        heads = (np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.empty(0)).astype(np.int32)
        sizes = np.diff(heads, append=np.int32(len(first)))
        del first
        head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        width = np.int32(1)
        active = np.flatnonzero(size > width).astype(np.int32)
        while len(active):
            within = active - head[active]
            run = within // width
            pair = head[active] + (run // 2) * 2 * width
            left = run % 2 == 0
            end = head[active] + size[active]
            low = np.where(left, np.minimum(pair + width, end), pair)
            high = np.where(left, np.minimum(pair + 2 * width, end), np.minimum(pair + width, end))
            other = low.copy()
            open_ = np.flatnonzero(low < high).astype(np.int32)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                # Elements of the left run go before equal ones of the right run.
                before = self.less(order[middle], order[active[open_]], ~left[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            own = within - run * width
            moved = order[active]
            order = order.copy()
            order[pair + own + (low - other)] = moved
            width = np.int32(2 * width)
            active = active[size[active] > width]
        return order

    def repeated(self, suffixes: np.ndarray) -> np.ndarray:
        """The suffixes (sorted) whose first ``length`` bytes another of them has too, verified byte by byte."""
        order = self.sort(suffixes)
        if len(order) < 2:
            return np.empty(0, np.int64)
        equal = self.extension(order[:-1], order[1:]) == self.length
        pairs = np.flatnonzero(equal)
        span = np.arange(self.length, dtype=np.int32)
        wrong = []
        for at in range(0, len(pairs), 4000):
            p = pairs[at : at + 4000]
            match = (self.data[order[p][:, None] + span] == self.data[order[p + 1][:, None] + span]).all(axis=1)
            wrong += p[~match].tolist()
        mark = np.zeros(len(order), bool)
        mark[pairs] = mark[pairs + 1] = True
        for p in wrong:  # a collision of hashes: this run of seemingly equal suffixes is told apart by its bytes
            a, b = p, p + 1
            while a and equal[a - 1]:
                a -= 1
            while b < len(order) - 1 and equal[b]:
                b += 1
            seen: dict[bytes, list[int]] = {}
            for i in range(a, b + 1):
                seen.setdefault(self.data[order[i] : order[i] + self.length].tobytes(), []).append(i)
            for places in seen.values():
                mark[places] = len(places) > 1
        return np.sort(order[mark])


def merged_spans(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[start, end) runs that the windows at sorted starts cover."""
    if not len(windows):
        return []
    cut = np.flatnonzero(windows[1:] > windows[:-1] + length)
    return list(zip(windows[np.concatenate([[0], cut + 1])].tolist(), (windows[np.concatenate([cut, [len(windows) - 1]])] + length).tolist(), strict=True))


_CONTEXT_ROWS = "key struct<a:bigint,b:bigint>, anchor long, digest binary, start int, n int, self boolean"


def _context_rows(batches, length: int):
    for batch in batches:
        keys, texts = batch.column("key"), batch.column("text").cast(pa.binary())
        for at in range(0, batch.num_rows, 500):
            places, columns = [], [[], [], [], [], []]
            for i, text in enumerate(texts.slice(at, 500).to_pylist()):
                found = contexts(text or b"", length)
                places.append(np.full(len(found[1]), at + i))
                for column, values in zip(columns, found, strict=True):
                    column.append(np.asarray(values, dtype=object) if values is found[3] else np.asarray(values))
            place = np.concatenate(places) if places else np.empty(0, int)
            if not len(place):
                continue
            anchors, starts, counts, digests, selves = [np.concatenate([c for c in column if len(c)]) for column in columns]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(place)), pa.array(anchors, pa.int64()), pa.array(digests.tolist(), pa.binary()),
                 pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array(selves.astype(bool))],
                names=["key", "anchor", "digest", "start", "n", "self"],
            )


_SORT_ROWS = "anchor long, salt int, key struct<a:bigint,b:bigint>, start int, n int, settled boolean, content binary"


def _sort_rows(batches, length: int, most: int):
    """Contexts with their bytes; those of an anchor that is split come as the digests of their windows, by salt."""
    for batch in batches:
        texts = batch.column("doc").field("text").cast(pa.binary())
        kinds = [pa.int64(), pa.int32(), batch.column("key").type, pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        rows, size = [], 0

        def sent(rows, kinds=kinds):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              names=["anchor", "salt", "key", "start", "n", "settled", "content"])

        for key, text, listed in zip(batch.column("key").to_pylist(), texts, batch.column("listed"), strict=True):
            text = text.as_py()
            for c in listed.as_py():
                start, n, settled = c["start"], c["n"], c["n_same"] > 1
                if c["n_digests"] <= most:
                    rows.append((c["anchor"], -1, key, start, n, settled, text[start : start + n - 1 + length]))
                    size += n + length
                    continue
                salts = -(-c["n_digests"] // most)
                by: dict[int, list[bytes]] = {}
                for s in range(start, start + n):
                    digest = hashlib.blake2b(text[s : s + length], digest_size=16).digest()
                    by.setdefault(int.from_bytes(digest[:6], "little") % salts, []).append(digest + s.to_bytes(8, "little"))
                rows += [(c["anchor"], salt, key, start, n, settled, b"".join(d)) for salt, d in by.items()]
                size += 24 * n
                if size >= SENT_BYTES:
                    yield sent(rows)
                    rows, size = [], 0
        if rows:
            yield sent(rows)


def _sorted_spans(rows: list[dict], length: int):
    """(key, start, end) of the repeated windows of unsettled contexts; ``rows`` hold whole anchors."""
    out = []
    whole = [r for r in rows if r["salt"] < 0]
    if whole:
        starts = np.cumsum([0, *(len(r["content"]) for r in whole)])
        sorter = SuffixSorter(b"".join(r["content"] for r in whole), length)
        counts = np.array([r["n"] for r in whole])
        suffixes = np.concatenate([np.arange(a, a + n, dtype=np.int32) for a, n in zip(starts[:-1].tolist(), counts.tolist(), strict=True)])
        found = sorter.repeated(suffixes)
        cuts = np.searchsorted(found, starts)
        for k, r in enumerate(whole):
            if not r["settled"]:
                mine = found[cuts[k] : cuts[k + 1]] - starts[k] + r["start"]
                out += [(r["key"], a, b) for a, b in merged_spans(mine, length)]
    split = [r for r in rows if r["salt"] >= 0]
    if split:
        raw = np.frombuffer(b"".join(r["content"] for r in split), np.dtype([("digest", "V16"), ("at", "<i8")]))
        halves = raw["digest"].copy().view(np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        equal = (halves[order[1:]] == halves[order[:-1]]).all(axis=1)
        twice = np.zeros(len(raw), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        at = 0
        for r in split:
            part = slice(at, at + len(r["content"]) // 24)
            at = part.stop
            if not r["settled"]:
                out += [(r["key"], a, b) for a, b in merged_spans(np.sort(raw["at"][part][twice[part]]), length)]
    return out


def _suffix_sort(batches, length: int):
    """Sorts in chunks of whole (anchor, salt) groups; rows come ordered by them."""
    held, size, key_type = [], 0, None  # whole groups
    group, group_size = [], 0  # the one that comes in

    def emit(rows):
        spans = _sorted_spans(rows, length)
        return pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in spans], key_type), pa.array([s[1] for s in spans], pa.int32()), pa.array([s[2] for s in spans], pa.int32())],
            names=["key", "start", "end"],
        )

    for batch in batches:
        key_type = batch.column("key").type
        for at in range(0, batch.num_rows, 1000):
            for r in batch.slice(at, 1000).to_pylist():
                if group and (group[-1]["anchor"], group[-1]["salt"]) != (r["anchor"], r["salt"]):
                    if held and size + group_size > SORT_SUFFIXES:
                        yield emit(held)
                        held, size = [], 0
                    held += group
                    size, group, group_size = size + group_size, [], 0
                group.append(r)
                group_size += r["n"]
    if held and size + group_size > SORT_SUFFIXES:
        yield emit(held)
        held = []
    if held or group:
        yield emit(held + group)


def _cut(batches, length: int):
    for batch in batches:
        texts = batch.column("doc").field("text").cast(pa.binary()).to_pylist()
        kept, spans = [], []
        for text, listed in zip(texts, batch.column("spans").to_pylist(), strict=True):
            text, at, parts, merged = text or b"", 0, [], []
            for s in sorted((x["start"], x["end"]) for x in listed or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            for a, b in merged:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join([*parts, text[at:]]))
            spans.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").field("doc"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(kept, pa.binary()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["doc", "n_bytes", "kept", "spans"],
        )


def remove_repeats(docs: DataFrame, text_column: str, carry: list[str], length: int = LENGTH, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc, n_bytes, kept, spans): the remaining bytes of each text and the removed [start, end) byte runs.

    ``doc`` holds the columns ``carry``, which should name an id where there is one.
    """
    if length < GRAM:
        raise ValueError(f"repeats shorter than {GRAM} bytes are not searched for")
    source = docs.select(F.struct(F.struct(*carry).alias("doc"), F.col(text_column).alias("text")).alias("doc"))
    source = source.select(_key_of(), "doc")
    texts = source.select("key", F.col("doc.text").alias("text"))
    found = texts.mapInArrow(lambda b: _context_rows(b, length), _CONTEXT_ROWS)
    anchors = found.groupBy("anchor").agg(
        F.count("*").alias("n_all"), (F.min("digest") == F.max("digest")).alias("alike"), F.max("self").alias("any_self")
    )
    # Most anchors stand once; only the others' contexts go on.
    anchors = anchors.where("n_all > 1 or any_self")
    meeting = written_once(found.join(anchors, "anchor").drop("n_all", "any_self"), "meeting-contexts")

    digests = meeting.where("not alike or self").groupBy("anchor", "digest").agg(
        F.count("*").alias("n_same"), F.min(F.struct("key", "start", "n")).alias("rep"), F.max("self").alias("self")
    )
    different = digests.groupBy("anchor").agg(F.count("*").alias("n_digests"))
    reps = digests.join(different, "anchor").where("n_digests > 1 or (self and n_same = 1)")
    settled = meeting.where("alike and not self").unionByName(
        meeting.where("not alike or self").join(digests.where("n_same > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select(meeting.columns)
    )
    # Contexts that are alike and self, but single, are in ``reps``; alike ones that stand twice are settled above.
    whole = settled.select("key", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))

    listed = reps.select(F.col("rep.key").alias("key"), F.struct("anchor", "rep.start", "rep.n", "n_same", "n_digests").alias("c"))
    listed = listed.groupBy("key").agg(F.collect_list("c").alias("listed"))
    with_text = source.join(listed, "key").select("key", "doc", "listed")
    to_sort = with_text.mapInArrow(lambda b: _sort_rows(b, length, most_contexts), _SORT_ROWS)
    to_sort = to_sort.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    partly = to_sort.mapInArrow(lambda b: _suffix_sort(b, length), "key struct<a:bigint,b:bigint>, start int, end int")

    spans = whole.unionByName(partly).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = source.join(spans, "key", "left").select("doc", "spans")
    doc_kind = source.schema["doc"].dataType["doc"].dataType.simpleString()
    return cut.mapInArrow(lambda b: _cut(b, length), f"doc {doc_kind}, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")


def _key_of():
    flat = F.to_json("doc.doc")
    return F.struct(
        F.xxhash64(F.lit(1), flat, F.col("doc.text").isNull(), F.col("doc.text")).alias("a"),
        F.xxhash64(F.lit(2), F.col("doc.text"), F.col("doc.text").isNull(), flat).alias("b"),
    ).alias("key")
