"""Exact top-k inner products as a Voronoi kNN join.

Vectors are scaled to integers. One more coordinate, sqrt(max norm^2 - norm^2), gives all data vectors the same length, so
that a larger inner product with a query is a smaller distance. Data and queries go to the cell of their nearest pivot;
each cell is summed up by its size, its farthest member and the k nearest members' distances. From these summaries each
group of queries gets a bound on its k-th distance, and by the triangle inequality only those members of a cell whose
distance to their pivot lies in a certain interval can matter to a group. These are copied to the group, dealt out in blocks
of bounded size and solved locally by integer products; the blocks' best are merged.

Pivots, summaries and intervals are bounded by the number of pivots, whatever the data. Cells of any size are fine, as
blocks cut a group's data by a hash of the id.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter vectors are padded
with zeros; rows with the query's own id are no candidates; a query id that is repeated is asked once, with its least
vector; rows that repeat an id are candidates each; null ids take no part. Components whose products cannot be summed
exactly in 63 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.session import written_once

PIVOTS = 48
#: Queries of a group, about.
GROUP_QUERIES = 256
#: Data rows of a block, about.
BLOCK_ROWS = 20_000
#: Relative slack of the bounds against rounding.
SLACK = 1e-9


def scaled(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * component) of the vectors that take part."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("x")).where("id is not null and x is not null")
    finite = F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return rows.where(finite).select("id", F.transform("x", lambda c: F.floor(c * F.lit(scale))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integers of a list column, one row each, padded to ``width``."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


class _Space:
    """Pivots in the lifted space."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.longest = longest
        self.pivots = self.lift(pivots)
        self.norms = (self.pivots**2).sum(axis=1)
        self.width = pivots.shape[1]

    def lift(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        x = rows.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x**2).sum(axis=1), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def nearest(self, rows: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        cells, distances = np.empty(len(rows), np.int32), np.empty(len(rows))
        for at in range(0, len(rows), 4096):
            x = self.lift(rows[at : at + 4096], query)
            cell = (self.norms[None, :] - 2 * x @ self.pivots.T).argmin(axis=1)
            cells[at : at + 4096] = cell
            distances[at : at + 4096] = np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))
        return cells, distances


def _assign(batches, space: _Space, query: bool):
    for batch in batches:
        rows = _matrix(batch.column("v"), space.width)
        cells, distances = space.nearest(rows, query)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cells), pa.array(distances)], names=["id", "v", "cell", "distance"])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _solve(queries: pa.Table, data: pa.Table, k: int, width: int, exact_float: bool) -> pa.Table:
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and data.num_rows:
        kind = np.float64 if exact_float else np.int64
        q_ids, d_ids = queries.column("id").to_numpy(), data.column("id").to_numpy()
        q = _matrix(queries.column("v").combine_chunks(), width).astype(kind)
        d = _matrix(data.column("v").combine_chunks(), width).astype(kind)
        for at in range(0, len(q), 64):
            products = q[at : at + 64] @ d.T
            for row, query in zip(products, q_ids[at : at + 64], strict=True):
                others = np.flatnonzero(d_ids != query)
                best = others[_best(row[others], d_ids[others], k)]
                found.append((np.full(len(best), query), d_ids[best], row[best].astype(np.int64)))
    parts = [np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ()))]
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), parts, strict=True)})


def _group_bounds(space: _Space, cells: list, nearest: dict[int, list[float]], asked: list, k: int) -> dict[int, dict[int, tuple[float, float]]]:
    """For each query cell, the interval of pivot distances that matters in each data cell.

    ``cells``: (cell, n, closest, farthest) of the data; ``nearest``: the k + 1 least distances of a cell; ``asked``: (cell, farthest
    query).
    """
    between = np.sqrt(np.maximum(space.norms[:, None] + space.norms[None, :] - 2 * space.pivots @ space.pivots.T, 0))
    slack = SLACK * (np.sqrt(space.longest) + 1) * 10
    out: dict[int, dict[int, tuple[float, float]]] = {}
    for cell, reach in asked:
        # One candidate may be the query itself: k + 1 of them hold k others.
        upper = sorted(reach + between[cell, j] + e for j, near in nearest.items() for e in near)
        bound = upper[k] if len(upper) > k else float("inf")
        out[cell] = {}
        for j, _, closest, farthest in cells:
            low, high = between[cell, j] - reach - bound - slack, between[cell, j] + reach + bound + slack
            if low <= farthest and high >= closest:
                out[cell][j] = (float(low), float(high))
    return out


def top_k(
    vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = 10, scale: float = 1024.0,
    pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with all other rows.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_column, vector_column, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    largest = F.array_max(F.transform("v", F.abs))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("norm"), F.max(largest).alias("most")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if facts["width"] is None:
        return empty
    width, most = max(1, facts["width"]), float(facts["most"] or 0)
    if most * most * width >= 2.0**62:
        raise ValueError("components are too large for exact products")
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    at = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        at[i, : len(r["v"])] = r["v"]
    space = _Space(at, float(facts["norm"]))
    kind = "id long, v array<bigint>, cell int, distance double"
    rows = rows.select(F.col("id").cast("long").alias("id"), "v")
    data = written_once(rows.mapInArrow(lambda b: _assign(b, space, False), kind), "knn-data")
    questions = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries = written_once(questions.mapInArrow(lambda b: _assign(b, space, True), kind), "knn-queries")

    # Summaries: a few numbers for each pivot.
    cells = [tuple(r) for r in data.groupBy("cell").agg(F.count("*"), F.min("distance"), F.max("distance")).collect()]
    nearest: dict[int, list[float]] = {}
    by_distance = Window.partitionBy("cell").orderBy("distance")
    for r in data.select("cell", "distance").withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= k + 1).collect():
        nearest.setdefault(r["cell"], []).append(r["distance"])
    asked = [tuple(r) for r in queries.groupBy("cell").agg(F.max("distance"), F.count("*")).collect()]
    if not asked:
        return empty
    bounds = _group_bounds(space, cells, nearest, [(c, d) for c, d, _ in asked], k)

    # Cells with few queries share a group, so that their data is copied once; cells with many are split.
    sizes = {c: n for c, n, _, _ in cells}
    groups: list[dict] = []
    for cell, _, n in sorted(asked, key=lambda a: tuple(space.pivots[a[0]])):
        if n >= group_queries or not groups or groups[-1]["n"] + n > group_queries:
            groups.append({"n": 0, "cells": [], "parts": max(1, -(-n // group_queries))})
        groups[-1]["n"] += n
        groups[-1]["cells"].append(cell)
    group_of, needs, blocks = [], [], []
    first = 0
    for g in groups:
        touched: dict[int, list[tuple[float, float]]] = {}
        for cell in g["cells"]:
            group_of.append((cell, first, g["parts"]))
            for j, interval in bounds[cell].items():
                touched.setdefault(j, []).append(interval)
        for part in range(g["parts"]):
            n_blocks = max(1, -(-sum(sizes[j] for j in touched) // block_rows))
            blocks.append((first + part, n_blocks))
            for j, intervals in touched.items():
                needs.append((j, first + part, n_blocks, min(a for a, _ in intervals), max(b for _, b in intervals)))
        first += g["parts"]

    # These tables are bounded by pivots x groups; the data is dealt to blocks by its id.
    wanted = F.broadcast(spark.createDataFrame(needs, "cell int, grp int, blocks int, low double, high double"))
    copied = data.join(wanted, "cell").where("distance between low and high")
    copied = copied.select("grp", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    grouped = queries.join(F.broadcast(spark.createDataFrame(group_of, "cell int, first int, parts int")), "cell")
    grouped = grouped.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("grp"), "id", "v")
    grouped = grouped.join(F.broadcast(spark.createDataFrame(blocks, "grp int, blocks int")), "grp")
    grouped = grouped.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    exact_float = most * most * width < 2.0**53
    solved = (
        grouped.groupBy("grp", "block")
        .cogroup(copied.groupBy("grp", "block"))
        .applyInArrow(lambda q, d: _solve(q, d, k, width, exact_float), "query_id long, vec_id long, score long")
    )
    ranked = solved.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
