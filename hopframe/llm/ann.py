"""Approximate nearest neighbours by a permutation index: nearest pivots in order, inverted files by pivot, candidates
ranked by the footrule distance of their orders, the best of them measured exactly.

Vectors are dealt to cells, each that of the nearest of some pivots, and cells to blocks; a query visits the cells of its
own nearest pivots. A block is indexed where it lies, by pivots of its own, which are some of its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialize
from .pivots import mixed, nearest_points, usable

#: Bytes of a block's vectors, and queries that visit a block together.
BLOCK_BYTES, QUERY_BLOCK = 16 << 20, 8192
#: Cells at most; with more vectors cells have more blocks.
MOST_CELLS = 4096
#: The sample that sets how many cells a query visits: its vectors (long ones are fewer) and their values, its queries, and
#: the share of their neighbours that the cells may miss.
SAMPLE, SAMPLE_VALUES, SAMPLE_QUERIES, MISSED = 8192, 1 << 21, 512, 0.01


class PermutationIndex:
    """Inverted files over one block of vectors, by n_pivots of them (all, if they are fewer): those with the smallest hash
    of the id, equal vectors once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, n_pivots: int, depth: int):
        self.ids, self.vectors = ids, vectors
        some = np.lexsort((ids, mixed(ids)))[: 4 * n_pivots]
        _, first = np.unique(vectors[some], axis=0, return_index=True)
        self.pivots = vectors[some[np.sort(first)[:n_pivots]]]
        self.depth = depth = min(depth, len(self.pivots))
        flat = nearest_points(vectors, self.pivots, depth).reshape(-1)
        by = np.argsort(flat, kind="stable")
        self.rows = (by // depth).astype(np.int32)
        self.places = (by % depth).astype(np.int16)
        self.ends = np.searchsorted(flat[by], np.arange(len(self.pivots) + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Sum over the query's pivots of the difference in place; a pivot that a vector lacks counts as place depth."""
        rows, gain = [], []
        for place, pivot in enumerate(order):
            a, b = self.ends[pivot], self.ends[pivot + 1]
            rows.append(self.rows[a:b])
            # relative to a vector without any of the query's pivots; its own unmatched pivots weigh depth - place too
            there = self.places[a:b]
            gain.append((self.depth - place) + (self.depth - there) - np.abs(there - place))
        return -np.bincount(np.concatenate(rows), np.concatenate(gain), len(self.ids))

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest by distance, then id, of the best ranked candidates; the query's own id is none."""
        n = len(self.ids)
        take = max(least, int(np.ceil(share * n)))
        if take < n:
            rank = self.footrule(order)
            cut = np.partition(rank, take - 1)[take - 1]
            near = np.flatnonzero(rank <= cut)  # ties at the cut are all measured
        else:
            near = np.arange(n)
        near = near[self.ids[near] != query_id]
        d = ((self.vectors[near] - query) ** 2).sum(1)
        if len(near) > k:  # what may be among the k nearest, whatever the order in which squares are added
            kept = d <= np.partition(d, k - 1)[k - 1] * (1 + 1e-9)
            near = near[kept]
        d = np.sqrt(np.add.accumulate((self.vectors[near] - query) ** 2, axis=1)[:, -1])
        best = np.lexsort((self.ids[near], d))[:k]
        return self.ids[near][best], d[best]


@dataclass
class Cells:
    """By length of the vectors: cell pivots, and how many cells a query visits."""

    pivots: dict[int, np.ndarray]
    visits: dict[int, int]


def _cells(src: DataFrame, counts: dict[int, int], k: int) -> Cells:
    """Pivots from a bounded sample of the vectors, for each length as many as it has blocks' worth of vectors. Among the
    sample's own vectors, which lie sparser than all do, a query's neighbours lie in the cells that it visits."""
    out = Cells({}, {})
    many = {dim: min(MOST_CELLS, n * dim * 8 // BLOCK_BYTES) for dim, n in counts.items()}
    for dim, n in sorted(many.items()):
        if n < 2:
            continue
        most = min(SAMPLE, max(2 * SAMPLE_QUERIES, SAMPLE_VALUES // dim))
        rows = src.where(F.size("v") == dim).select(F.xxhash64("vec_id", F.lit(3)).alias("h"), "vec_id", "v").orderBy("h", "vec_id", "v").limit(most).select("v").toArrow()
        x = np.unique(rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim), axis=0)
        x = np.random.default_rng(3).permutation(x)
        pivots = x[:n]
        own = nearest_points(x, pivots, 1)[:, 0]
        asked = x[-SAMPLE_QUERIES:]
        order = nearest_points(asked, pivots, len(pivots))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(pivots), dtype=order.dtype)[None], axis=1)
        near = nearest_points(asked, x, min(len(x), k + 1))
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1))
        out.pivots[dim] = pivots
        out.visits[dim] = int(needed[int(np.ceil((1 - MISSED) * len(needed))) - 1]) + 1
    return out


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, n_pivots: int = 256, depth: int = 64, share: float = 0.15, least: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k nearest other rows found by Euclidean
    distance in double precision, ties to the smaller id; all candidates if there are fewer.

    Every row is indexed. Rows are dealt to cells by the nearest of so many pivots as there are blocks' worth of vectors, a
    query visits as many cells as a sample shows to hold its neighbours, and large cells and many queries are dealt to
    further blocks by hash, so that no group is larger than a block and its queries. In each block the share (at least
    least candidates, by default 20 k) with the smallest footrule distance is measured on the original vectors.

    Null ids, and vectors that are null, empty, zero or not finite take no part, as query or candidate. Vectors of another
    length are no candidates; each length is searched for itself. Rows that repeat an id are separate candidates of others
    and none of each other. Extra columns are ignored; an empty table gives no row.
    """
    spark, least = vectors.sparkSession, least or 20 * k
    src = vectors.where(F.col(id_col).isNotNull() & usable(vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    src = materialize(src.withColumn("dim", F.size("v")), "vectors")
    sizes = {r["dim"]: r["n"] for r in src.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length
    cells = _cells(src, sizes, k)
    shared = spark.sparkContext.broadcast(cells)  # at most MOST_CELLS of the sample's vectors for each length

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, q = batch.column("dim").to_numpy(), batch.column("q").to_numpy(zero_copy_only=False)
            found: list = [[0]] * len(batch)
            for dim in np.unique(dims):
                pivots = shared.value.pivots.get(int(dim))
                if pivots is not None:
                    at = np.flatnonzero(dims == dim)
                    x = batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                    order = nearest_points(x, pivots, shared.value.visits[int(dim)])
                    for i, o in zip(at, order, strict=True):
                        found[i] = o if q[i] else o[:1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    dealt_rows = src.mapInArrow(dealt, "vec_id long, v array<double>, q boolean, dim int, cells array<int>") if cells.pivots else src.withColumn("cells", F.array(F.lit(0)))
    dealt_rows = materialize(dealt_rows, "dealt")
    base = dealt_rows.select("vec_id", "v", "dim", F.col("cells")[0].alias("cell"))
    asked = dealt_rows.where("q").select("vec_id", "v", "dim", F.explode("cells").alias("cell")).distinct()
    # MOST_CELLS rows for each length: how many blocks of vectors and of queries a cell has
    rows = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    held = base.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / rows).cast("long").alias("blocks"))
    asking = asked.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / QUERY_BLOCK).cast("long").alias("turns"))
    plan = F.broadcast(materialize(held.join(asking, ["dim", "cell"]), "cells"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n))
    keys = ["dim", "cell", "block", "turn"]
    left = base.join(plan, ["dim", "cell"]).withColumn("block", own("blocks", 11)).withColumn("turn", each("turns")).select(*keys, "vec_id", "v")
    right = asked.join(plan, ["dim", "cell"]).withColumn("turn", own("turns", 12)).withColumn("block", each("blocks")).select(*keys, "vec_id", "v")

    def searched(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(block) and len(queries):
            dim = block.column("dim")[0].as_py()
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            index = PermutationIndex(block.column("vec_id").to_numpy(), matrix(block), n_pivots, depth)
            q = matrix(queries)
            for i, v, o in zip(queries.column("vec_id").to_pylist(), q, nearest_points(q, index.pivots, index.depth), strict=True):
                near, d = index.search(i, v, o, k, share, least)
                out[0].append(np.full(len(near), i, np.int64)), out[1].append(near), out[2].append(d)
        whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query_id": whole(out[0], pa.int64()), "vec_id": whole(out[1], pa.int64()), "score": whole(out[2], pa.float64())})

    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(searched, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
