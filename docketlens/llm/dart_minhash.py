"""Near-duplicate detection with DartMinHash signatures.

A text is a weighted set of five-word shingles. Hashed darts fall on every element's region of weight and rank, the same
darts for the same element in every text; each dart belongs to one coordinate, and the earliest dart of a coordinate
that lies under the element's weight is the coordinate's hash. Only as many darts are thrown as it takes to hit every
coordinate, some k ln k in all, whatever the size of the text. Two texts agree in a coordinate with the probability of
their weighted Jaccard similarity, so bands of coordinates find candidate pairs, and an exact comparison of the shingle
sets decides.

Equal texts are one node. In each bucket of a band the members are compared with the one that has most company in all its
buckets, as the original of many edited copies has. Buckets whose members are connected by then are done. The others go
as blocks of shingle sets to tasks that compare all members of different components by an index of their shingles and
report only links that join components, so that pairs never become rows. Classes are the connected components of the
pairs that are similar enough.

With the default bands a pair of similarity 0.8 shares no bucket with probability 4e-8. Defined results: a null text is
empty; a text of fewer than five words is one shingle; texts without words are alike only if they are equal; repeated
rows and equal texts are one class; the class is named by its least id, nulls last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import words_of
from docketlens.llm.components import connected_components
from docketlens.session import written_once

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)  # at least 4/5
BANDS = 24
BAND_ROWS = 3
#: Members of a bucket that one task compares with each other.
BLOCK_MEMBERS = 1024
_CACHE_WORDS = 250_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit shingle hashes of texts; word hashes are remembered."""

    def __init__(self, size: int = SHINGLE_WORDS):
        self.size = size
        self.known: dict[bytes, int] = {}

    def shingles(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.size, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = _mix(out * _GOLDEN + hashes[k : n + k])
        return out


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """k dart hashes (columns) of each of several weighted sets (rows), which lie one after the other.

    ``elements`` are 64-bit hashes, distinct within a set; ``weights`` are positive; no set is empty.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Layers of weight: [0, 1), [1, 2), [2, 4), ...; a layer's darts come at a rate of its width.
    top = max(0, int(np.ceil(np.log2(max(1.0, float(weights.max()))))))
    lows = np.array([0.0] + [2.0**i for i in range(top)])
    widths = np.array([1.0] + [2.0**i for i in range(top)])
    element, layer = np.nonzero(weights[:, None] > lows[None, :])
    seeds = _mix(elements[element] + _GOLDEN * (layer + 1).astype(np.uint64))
    low, width, limit, owner = lows[layer], widths[layer], weights[element], owner[element]
    totals = np.add.reduceat(weights, np.cumsum(sizes) - sizes)
    reach = k * (np.log(k) + 2) / totals
    out = np.zeros((len(sizes), k), np.uint64)
    missing = np.ones(len(sizes), bool)
    while missing.any():
        # Each cell's darts come one after the other; a cell is done when its next dart lies beyond its set's reach.
        cell = np.flatnonzero(missing[owner])
        last, step, found = np.zeros(len(cell)), 1, []
        while len(cell):
            # Several at a time where few cells have many.
            tries = np.arange(step, step + (1 if len(cell) > 5000 else 16), dtype=np.uint64)
            step += len(tries)
            darts = _mix(seeds[cell][:, None] + _GOLDEN * tries[None, :])
            gaps = -np.log(((darts >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / width[cell][:, None]
            ranks = last[:, None] + np.cumsum(gaps, axis=1)
            near = ranks <= reach[owner[cell]][:, None]
            row, column = np.nonzero(near)
            found.append((darts[row, column], ranks[row, column], cell[row]))
            going = np.flatnonzero(near[:, -1])
            cell, last = cell[going], ranks[going, -1]
        dart, rank, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        height = low[cell] + width[cell] * ((_mix(dart + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53)
        under = height < limit[cell]
        dart, rank, cell = dart[under], rank[under], cell[under]
        place = owner[cell] * k + (_mix(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, place))
        first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
        hits = np.bincount(place[first] // k, minlength=len(sizes))
        out[place[first] // k, place[first] % k] = dart[first]
        missing &= hits < k
        reach[missing] *= 2
    return out


def bands_of(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each set and band; the band's number is part of it."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for r in range(rows):
        out = _mix(out + hashes[:, r::rows][:, :bands])
    return out.view(np.int64)


def _weighted(shingles: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    distinct, counts = np.unique(shingles, return_counts=True)
    return distinct, counts.astype(float) if counted else np.ones(len(distinct))


def _signed(batches, bands: int, rows: int, counted: bool):
    shingler = Shingler()
    for batch in batches:
        # Texts are signed some hundred thousand shingles at a time.
        sets, found, held, places = [], {}, 0, []

        def sign():
            if sets:
                sizes = np.array([len(e) for e, _ in sets])
                signed = signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]), sizes, bands * rows)
                found.update(zip(places, bands_of(signed, bands, rows), strict=True))

        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            shingles = shingler.shingles(text)
            if not len(shingles):
                continue
            sets.append(_weighted(shingles, counted))
            places.append(i)
            held += len(shingles)
            if held > 200_000:
                sign()
                sets, held, places = [], 0, []
        sign()
        none = np.empty(0, np.int64)
        lists = [found.get(i, none) for i in range(batch.num_rows)]
        arrays = pa.ListArray.from_arrays(np.cumsum([0, *map(len, lists)]), pa.array(np.concatenate([none, *lists])))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), arrays], names=["id", "text_key", "buckets"])


def shingle_set(shingles: np.ndarray, counted: bool) -> np.ndarray:
    """A sorted set of 32-bit hashes for the exact comparison; the n-th copy of a shingle is an element of its own, if counted."""
    if not counted:
        return np.unique(shingles.astype(np.uint32))
    ordered = np.sort(shingles)
    heads = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]) != 0) if len(ordered) else np.empty(0, np.int64)
    copy = np.arange(len(ordered)) - np.repeat(heads, np.diff(heads, append=len(ordered)))
    return np.unique(_mix(ordered + _GOLDEN * copy.astype(np.uint64)).astype(np.uint32))


def _sets(batches, counted: bool):
    shingler = Shingler()
    for batch in batches:
        sets = [shingle_set(shingler.shingles(t), counted).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def similar(one: np.ndarray, other: np.ndarray, least: tuple[int, int] = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least the ratio."""
    small, large = sorted((len(one), len(other)))
    if small * least[1] < large * least[0]:
        return False
    both = np.sort(np.concatenate([one, other]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * least[1] >= (small + large - common) * least[0]


def _verify(batches, least: tuple[int, int]):
    for batch in batches:
        one, other = batch.column("one").to_pylist(), batch.column("other").to_pylist()
        keep = [similar(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), least) for a, b in zip(one, other, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def joining_links(sets: list[np.ndarray], components: list, sides: list[int] | None, least: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that join components, found by an index of shingles; ``sides``: only pairs across them."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holders, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    names = {c: k for k, c in enumerate(dict.fromkeys(components))}
    group = np.array([names[c] for c in components])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found = []
    for i in range(len(sets)):
        apart = group != group[i]
        if sides is not None:
            apart &= np.array(sides) != sides[i]
        apart[: i + 1] = False
        if not apart.any():
            continue
        mine = shingle[starts[i] : starts[i + 1]]
        lengths = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        common = np.bincount(holders[at], minlength=len(sets))
        for j in np.flatnonzero(apart & (common * least[1] >= (sizes + sizes[i] - common) * least[0])).tolist():
            if group[j] != group[i]:
                found.append((i, j))
                group[group == group[j]] = group[i]
    return found


def _compare_block(table: pa.Table, least: tuple[int, int]) -> pa.Table:
    nodes = table.column("node").combine_chunks()
    sets = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]
    components = [(c["a"], c["b"]) for c in table.column("component").to_pylist()]
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    links = joining_links(sets, components, table.column("block").to_pylist() if across else None, least)
    u, v = pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())
    return pa.table({"u": nodes.take(u), "v": nodes.take(v)})


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("one")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("other")), "v")
    return both.select("u", "v", "one", "other").mapInArrow(lambda b: _verify(b, least), pairs.select("u", "v").schema)


def near_duplicates(
    docs: DataFrame, id_column: str, text_column: str, bands: int = BANDS, band_rows: int = BAND_ROWS,
    least: tuple[int, int] = SIMILARITY, counted: bool = False,
) -> DataFrame:
    """(id, text_key, class_id, class_size, keeps): one row for each row of ``docs``.

    ``keeps`` marks one row of each class, of the least id and text. ``counted`` weighs a shingle by how often it stands
    in the text; otherwise texts are plain sets.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.select("id", text_key(F.col("text")).alias("text_key"), "text")
    signed = rows.mapInArrow(
        lambda b: _signed(b, bands, band_rows, counted), f"id {rows.schema['id'].dataType.simpleString()}, text_key struct<a:bigint,b:bigint>, buckets array<bigint>"
    )
    texts = written_once(signed.groupBy("text_key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("buckets").alias("buckets")), "signed-texts")
    placed = texts.select(F.col("text_key").alias("node"), F.explode("buckets").alias("bucket"))
    crowd = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written_once(placed.join(crowd, "bucket"), "shared-buckets")
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    centers = shared.join(company, "node").groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("center"))
    stars = shared.join(centers, "bucket").where("node <> center").select(F.col("node").alias("u"), F.col("center").alias("v")).distinct()

    wanted = shared.select(F.col("node").alias("text_key")).distinct()
    with_text = rows.select("text_key", "text").join(wanted, "text_key", "left_semi")
    sets = written_once(with_text.mapInArrow(lambda b: _sets(b, counted), "node struct<a:bigint,b:bigint>, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    links = written_once(_verified(stars, sets, least), "star-links")
    found = connected_components(links)

    # What the stars left apart: members of one bucket in different components.
    joined = shared.select("bucket", "node", "n").join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    apart = joined.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("bucket")
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    dealt = joined.join(apart, "bucket", "left_semi").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A block meets itself and each other block of its bucket once.
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "node", "component", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    met = dealt.join(sets, "node").groupBy("bucket", "i", "j")
    more = written_once(met.applyInArrow(lambda t: _compare_block(t, least), links.schema), "other-links")
    classes = connected_components(links.unionByName(more)) if more.limit(1).count() else found

    named = texts.join(classes.withColumnRenamed("node", "text_key"), "text_key", "left")
    named = named.select("text_key", "id", "copies", F.coalesce("component", "text_key").alias("component"))
    heads = named.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("head"), F.sum("copies").alias("class_size")
    )
    of_text = named.select("text_key", "component").join(heads, "component").select("text_key", "head", "class_size")
    keyed = written_once(rows.select("id", "text_key", F.monotonically_increasing_id().alias("row")), "keyed-rows")
    least_row = keyed.groupBy("text_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    out = keyed.join(of_text.join(least_row, "text_key"), "text_key")
    keeps = (F.col("head.text_key") == F.col("text_key")) & (F.col("row") == F.col("first.row"))
    return out.select("id", "text_key", F.col("head.id").alias("class_id"), "class_size", keeps.alias("keeps"))


def text_key(text: Column) -> Column:
    """128 bits of a text; a null one counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(text, F.lit(2)).alias("b"))


def keep_one(docs: DataFrame, id_column: str, text_column: str, **options) -> DataFrame:
    """``docs`` with one row of each class: the one of the least id, and of rows that repeat it, one."""
    kept = near_duplicates(docs, id_column, text_column, **options).where("keeps").select(F.col("id").alias("kept_id"), "text_key")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_column).alias("id"), text_key(F.col(text_column)).alias("text_key"))
    # A text has one kept row at most, so that rows that repeat it are dropped where they meet it.
    met = rows.join(kept, "text_key").where("id <=> kept_id").dropDuplicates(["text_key"])
    return met.select("doc.*")
