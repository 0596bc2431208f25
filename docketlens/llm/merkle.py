"""Merkle manifest of a dataset: one tree for each value of a column, and one over the roots of those.

A tree has fan-out 8. It is cut into blocks: aligned subtrees of four levels over up to 4096 leaves. A block stores its digests
in van Emde Boas order: the subtree of the upper half of its levels first, then the subtrees below it one after the other, each
laid out the same way, so that the nodes of a path lie near each other for a page or cache line of any size. Addresses are
arithmetic on (levels, depth, place), and construction and the siblings of a proof both use them. The roots of a layer's blocks
are the leaves of the next layer, until one block is left.

Defined results: leaves of a tree stand in the order given, then by digest; a null tree value is a tree of its own, before the
others; equal rows are separate leaves of equal digest; null and empty values have different leaves (see ``leaf_digest``); a tree
of one leaf is that leaf; an empty table has no trees and no root. Texts are hashed by the JVM where they are read and no further
step sees them, so their length does not matter. Other columns, of any name, are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.positions import positions
from docketlens.session import written_once

FANOUT = 8
BLOCK_LEVELS = 4
BLOCK_LEAVES = FANOUT**BLOCK_LEVELS
DIGEST = 32


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over the fields in order: ``-`` for a null, else the length in UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def height(leaves: int) -> int:
    """Levels above the leaves of a tree of so many."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


def nodes_of(rows: int) -> int:
    """Nodes of a full tree of so many rows of nodes."""
    return (FANOUT**rows - 1) // (FANOUT - 1)


def address(rows: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Where the nodes at ``depth`` and ``place`` (from the left) stand in the van Emde Boas order of a tree of ``rows`` rows of nodes."""
    if rows == 1:
        return place * 0
    upper = rows // 2
    if depth < upper:
        return address(upper, depth, place)
    span = FANOUT ** (depth - upper)
    return nodes_of(upper) + place // span * nodes_of(rows - upper) + address(rows - upper, depth - upper, place % span)


@functools.cache
def _addresses(levels: int) -> list[list[int]]:
    return [address(levels + 1, depth, np.arange(FANOUT**depth)).tolist() for depth in range(levels + 1)]


def _counts(leaves: int, levels: int) -> list[int]:
    """Nodes in use at each depth."""
    counts = [leaves]
    for _ in range(levels):
        counts.append(-(-counts[-1] // FANOUT))
    return counts[::-1]


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def build_block(leaves: list[bytes], levels: int) -> bytes:
    """The digests of a block in its order, up to the last place in use; the root is the first."""
    where, counts = _addresses(levels), _counts(len(leaves), levels)
    stored = bytearray(DIGEST * (1 + max(max(where[d][:n]) for d, n in enumerate(counts))))
    below = leaves
    for depth in range(levels, -1, -1):
        if depth < levels:
            below = [parent(below[FANOUT * i : FANOUT * (i + 1)]) for i in range(counts[depth])]
        for at, digest in zip(where[depth], below):
            stored[DIGEST * at : DIGEST * (at + 1)] = digest
    return bytes(stored)


def siblings(stored: bytes, levels: int, leaves: int, place: int) -> list[tuple[int, list[bytes]]]:
    """(place in its run, the run's other digests) of a leaf and of each node above it, up to below the block's root."""
    where, counts, found = _addresses(levels), _counts(leaves, levels), []
    for depth in range(levels, 0, -1):
        first = place // FANOUT * FANOUT
        run = [where[depth][j] for j in range(first, min(first + FANOUT, counts[depth]))]
        own = run.pop(place - first)
        assert own == where[depth][place]
        found.append((place - first, [stored[DIGEST * at : DIGEST * (at + 1)] for at in run]))
        place //= FANOUT
    return found


def write_path(steps: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([at, len(others)]) + b"".join(others) for at, others in steps)


def read_path(path: bytes) -> list[tuple[int, list[bytes]]]:
    steps, i = [], 0
    while i < len(path):
        at, n = path[i], path[i + 1]
        steps.append((at, [path[j : j + DIGEST] for j in range(i + 2, i + 2 + DIGEST * n, DIGEST)]))
        i += 2 + DIGEST * n
    return steps


def fold(digest: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that follows from a leaf and the siblings on its path."""
    for at, others in steps:
        digest = parent([*others[:at], digest, *others[at:]])
    return digest


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each (tree, block), of batches sorted by them; a block's rows are bounded."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if keys[at] != key:
                    if held:
                        yield key, pa.Table.from_batches(held)
                    key, held = keys[at], []
                held.append(batch.slice(at, i - at))
                at = i
    if held:
        yield key, pa.Table.from_batches(held)


_BLOCK = "tree string, block long, leaves long, of_tree long, levels int, root binary, nodes binary"
_BLOCK_ARROW = pa.schema([
    ("tree", pa.string()), ("block", pa.int64()), ("leaves", pa.int64()), ("of_tree", pa.int64()), ("levels", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary()),
])
#: Blocks that go out together.
_SENT_TOGETHER = 64


def _sent(rows: Iterator[tuple], schema: pa.Schema, together: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == together:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _build_layer(leaves: DataFrame, name: str) -> DataFrame:
    """Blocks over ``leaves`` (tree, pos, of_tree, digest)."""

    def run(batches):
        def blocks():
            for (tree, block), rows in _runs(batches):
                digests, of_tree = rows.column("digest").to_pylist(), rows.column("of_tree")[0].as_py()
                levels = min(BLOCK_LEVELS, height(of_tree))
                stored = build_block(digests, levels)
                yield tree, block, len(digests), of_tree, levels, stored[:DIGEST], stored

        yield from _sent(blocks(), _BLOCK_ARROW, _SENT_TOGETHER)

    dealt = leaves.select("tree", F.floor(F.col("pos") / BLOCK_LEAVES).alias("block"), "pos", "of_tree", "digest")
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return written_once(dealt.mapInArrow(run, _BLOCK), name)


@dataclass
class Forest:
    """``leaves`` (row, digest, tree, pos, of_tree) and the blocks of each layer, from the leaves up."""

    leaves: DataFrame
    layers: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, digest): the root of each tree."""
        tops = [layer.where(F.col("of_tree") <= BLOCK_LEAVES).select("tree", F.col("root").alias("digest")) for layer in self.layers]
        return functools.reduce(DataFrame.unionByName, tops)


def build(leaves: DataFrame, order: list[str], name: str = "merkle") -> Forest:
    """Trees over ``leaves`` (tree, digest and others), whose leaves ascend by ``order`` and digest."""
    placed = written_once(positions(leaves, "tree", [*order, "digest"], name).withColumnRenamed("of_key", "of_tree"), f"{name}-leaves")
    most = placed.agg(F.max("of_tree")).first()[0] or 0
    layers = [_build_layer(placed, f"{name}-layer")]
    while most > BLOCK_LEAVES:
        most = -(-most // BLOCK_LEAVES)
        tops = layers[-1].where(F.col("of_tree") > BLOCK_LEAVES)
        up = tops.select("tree", F.col("block").alias("pos"), F.ceil(F.col("of_tree") / BLOCK_LEAVES).alias("of_tree"), F.col("root").alias("digest"))
        layers.append(_build_layer(up, f"{name}-layer"))
    return Forest(placed, layers)


def _paths(blocks: DataFrame) -> DataFrame:
    """(tree, pos, path) of every leaf of ``blocks``, which carry the path of their own root as ``upper``."""

    def run(batches):
        def paths():
            for batch in batches:
                for r in batch.to_pylist():
                    for i in range(r["leaves"]):
                        steps = siblings(r["nodes"], r["levels"], r["leaves"], i)
                        yield r["tree"], BLOCK_LEAVES * r["block"] + i, write_path(steps) + r["upper"]

        yield from _sent(paths(), pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary())]), BLOCK_LEAVES)

    return blocks.select("tree", "block", "levels", "leaves", "nodes", "upper").mapInArrow(run, "tree string, pos long, path binary")


def with_upper(forest: Forest, above: DataFrame) -> DataFrame:
    """The blocks of the leaves with ``upper``, the path from a block's root up; ``above`` (tree, path) goes on from each tree's root."""
    paths = None
    for layer in reversed(forest.layers):
        top = layer.where(F.col("of_tree") <= BLOCK_LEAVES).join(above, "tree").withColumnRenamed("path", "upper")
        if paths is None:
            blocks = top
        else:
            lower = layer.where(F.col("of_tree") > BLOCK_LEAVES).join(paths.withColumnRenamed("pos", "block"), ["tree", "block"])
            blocks = top.unionByName(lower.withColumnRenamed("path", "upper"))
        paths = _paths(blocks)
    return blocks


_PROOF = "leaf string, subroot string, proof_sha256 string, folded_root string"
_FOUND = [("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]


def prove(forest: Forest, above: DataFrame, subroots: DataFrame, carry: list[str], now: str) -> DataFrame:
    """Each leaf with its digest, its tree's root, the digest of its proof, and the root folded from the digest ``now`` and that proof.

    ``now`` names a column of the leaves: the digest as found when the manifest is checked. A block and its leaves meet in one task,
    the block first, and are dropped together.
    """
    blocks = with_upper(forest, above).join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    row = F.struct(*carry)
    leaves = forest.leaves.select("tree", F.floor(F.col("pos") / BLOCK_LEAVES).alias("block"), F.col("pos"), row.alias("row"), "digest", F.col(now).alias("now"))
    rows = leaves.unionByName(blocks.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "leaves", "levels", "nodes", "upper", "subroot"), allowMissingColumns=True)
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for _, part in _runs(batches):
            head = part.slice(0, 1).drop_columns("row").to_pylist()[0]
            upper = [(at, [o.hex().encode() for o in others]) for at, others in read_path(head["upper"])]
            upper_hex, subroot = b"".join(o for _, others in upper for o in others), head["subroot"].hex()
            out, part = [], part.slice(1)
            for i, (digest, current) in enumerate(zip(part.column("digest").to_pylist(), part.column("now").to_pylist(), strict=True)):
                own = [(at, [o.hex().encode() for o in others]) for at, others in siblings(head["nodes"], head["levels"], head["leaves"], i)]
                proof = hashlib.sha256(b"".join(o for _, others in own for o in others) + upper_hex)
                folded = current.hex()
                for at, others in own + upper:
                    folded = hashlib.sha256(b"".join([*others[:at], folded.encode(), *others[at:]])).hexdigest()
                out.append((digest.hex(), subroot, proof.hexdigest(), folded))
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*out), _FOUND)]
            yield from pa.Table.from_arrays([part.column("row"), *arrays], names=["row", *(n for n, _ in _FOUND)]).to_batches()

    return rows.mapInArrow(run, f"row {row_type}, {_PROOF}")


def manifest(docs: DataFrame, tree: Column, fields: list[Column], now: list[Column], id_column: str) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root): a manifest of ``docs`` and its check against the fields as they are ``now``.

    Leaves of a tree ascend by the id. Trees ascend by ``tree`` as UTF-8 bytes, null first.
    """
    named = F.coalesce(F.concat(F.lit("="), tree), F.lit(""))
    leaves = docs.select(F.col(id_column).alias("id"), named.alias("tree"), leaf_digest(*fields).alias("digest"), leaf_digest(*now).alias("now"))
    forest = build(leaves, ["id"])
    subroots = written_once(forest.roots(), "merkle-subroots")
    over = build(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest"), ["id"], "merkle-over")
    root = over.roots().first()
    no_path = over.roots().select("tree", F.unhex(F.lit("")).alias("path"))
    above = _paths(with_upper(over, no_path)).select("pos", "path")
    named_paths = over.leaves.select("pos", F.col("id").alias("tree")).join(above, "pos").select("tree", "path")
    found = prove(forest, named_paths, subroots, ["id"], "now")
    return found.select("row.id", "leaf", "subroot", F.lit(root["digest"].hex() if root else None).cast("string").alias("root"), "proof_sha256", "folded_root")
