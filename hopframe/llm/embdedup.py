"""Near-duplicate vectors by a pivot-permutation index: nearest reference points, inverted lists by reference point,
counts of shared ones, then the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialize
from .components import connected_components
from .minmax import _in_blocks, _local_roots
from .pivots import nearest_pivots, sampled, spread_out, usable

#: Vectors of a block; longer lists are compared by pairs of blocks.
BLOCK = 1024
#: Share of a sample's links that the lists may miss, and vectors of that sample.
MISSED, JUDGED = 1e-3, 2048


def _fitting(x: np.ndarray, whole: bool, pivots: np.ndarray, cosine: float, depth: int, shared: int) -> tuple[np.ndarray, int, int]:
    """Pivots, depth and shared whose lists find the links among the unit vectors x.

    Where vectors lie in a cone, those that link may have other nearest pivots. Then lists get deeper, and where deeper
    ones would cost more than all pairs, a single pivot's list holds all vectors. No link may go if x is the whole table;
    else as many as MISSED explains.
    """
    x = x[:JUDGED]
    linked = np.triu(x @ x.T >= cosine, 1)
    total = linked.sum() * MISSED
    allowed = 0 if whole and len(x) < JUDGED else total + 3 * np.sqrt(total) + 1
    while True:
        depth = min(depth, len(pivots))
        shared = min(shared, depth)
        has = np.zeros((len(x), len(pivots)), np.float32)
        np.put_along_axis(has, nearest_pivots(x, pivots, depth), 1, axis=1)
        if (linked & (has @ has.T < shared)).sum() <= allowed:
            return pivots, depth, shared
        if 4 * depth * depth > len(pivots):
            return pivots[:1], 1, 1
        depth *= 2


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, depth: int = 10, shared: int = 2, n_pivots: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link when the cosine of the original vectors, in double precision, is at least
    the limit. Candidates have at least shared of their depth nearest pivots in common (two vectors with a cosine of
    0.93 in 64 dimensions do in over 99.9 % of cases; where a sample shows that they do not, lists get deeper or hold all
    vectors, and of fewer pivots than shared all are enough); a pair is judged in the list of the smallest pivot that they
    share. Equal vectors become one class first, weighted by its size. Lists are cut into blocks and compared by pairs of
    blocks; links are counted and joined where they are found, never written out pair by pair.
    The number of pivots grows with the square root of the rows, so that lists grow as slowly.

    Null or unusable vectors (empty, zero, a null or non-finite component), null labels and null ids link with nothing:
    n_links 0, component_id the own id. Vectors of different lengths never link. Rows that repeat an id are one node.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    good = src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    # -0.0 and 0.0 are one value; groupBy and join treat them so
    classes = materialize(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "vectors")
    rows = classes.count()
    n_pivots = n_pivots or int(min(4096, max(32, 2 ** round(np.log2(max(1, rows)) / 2))))
    sample = sampled(classes, "rep", "v", n_pivots)
    if not len(sample):
        return src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = sample.shape[1]
    pivots, depth, shared = _fitting(sample, rows <= 4 * n_pivots, spread_out(sample, n_pivots), cosine, depth, shared)
    n_pivots = len(pivots)
    at = spark.sparkContext.broadcast(pivots)  # at most 4096 vectors

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            fits = np.array([len(x) == dim for x in lists], bool)
            x = np.zeros((len(batch), dim))
            if fits.any():
                x[fits] = lists.filter(pa.array(fits)).flatten().to_numpy().astype(float).reshape(-1, dim)
            order = nearest_pivots(x, at.value, depth)
            # vectors of another length meet in lists of their own, after the pivots'
            order[~fits] = n_pivots
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), batch.column("w"), lists, pa.array(list(order), pa.list_(pa.int32()))], names=["label", "rep", "w", "v", "near"])

    kind = classes.schema["label"].dataType.simpleString(), classes.schema["v"].dataType.simpleString()
    index = classes.select("label", "rep", "w", "v").mapInArrow(describe, f"label {kind[0]}, rep long, w long, v {kind[1]}, near array<int>")
    index = materialize(index, "index")
    posted = index.select("label", "rep", "w", "v", "near", F.explode(F.array_distinct("near")).alias("pivot"))
    lengths = index.select("label", F.explode(F.array_distinct("near")).alias("pivot")).groupBy("label", "pivot").agg(F.count("*").alias("n")).where("n > 1")
    listed = _in_blocks(posted.join(lengths, ["label", "pivot"]), "pivot", "rep", F.ceil(F.col("n") / BLOCK))

    def judge(group: pa.Table) -> pa.Table:
        rep = group.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        rep, w = rep[order], group.column("w").to_numpy()[order].astype(float)
        x = [np.asarray(v, float) for v in group.column("v").take(pa.array(order)).to_pylist()]
        pivot = group.column("pivot")[0].as_py()
        blocks = group.column("pair")[0].as_py()
        own = group.column("own").to_numpy()[order]
        n = len(rep)
        near = np.array(group.column("near").take(pa.array(order)).to_pylist(), np.int64)
        has = np.zeros((n, n_pivots + 1), np.float32)
        has[np.arange(n)[:, None], near] = 1
        if pivot == n_pivots:
            linked = np.zeros((n, n), bool)
            for i in range(n):
                for j in range(i):
                    linked[i, j] = linked[j, i] = len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine * np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))
        else:
            u = np.array(x)
            norm = np.sqrt((u * u).sum(1))
            common = has @ has.T
            first = has[:, :pivot] @ has[:, :pivot].T == 0
            linked = (common >= shared) & first & ((u @ u.T) / (norm[:, None] * norm[None]) >= cosine)
            np.fill_diagonal(linked, False)
        if blocks[0] != blocks[1]:
            inside = own[:, None] == own[None]
            # pairs within a block belong to one of its groups
            least = own == blocks[0]
            home = np.where(least, blocks[1] == (0 if blocks[0] else 1), blocks[0] == 0)
            linked &= ~inside | (home[:, None] & home[None])
        root = rep[_local_roots([np.flatnonzero(linked[i, :i]) for i in range(n)])]
        links = linked @ w
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]})

    judged = materialize(listed.select("label", "pivot", "pair", "own", "rep", "w", "v", "near").groupBy("label", "pivot", "pair").applyInArrow(judge, "rep long, links long, root long"), "judged")
    counted = judged.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(judged, "rep", "root")
    whole = classes.join(counted, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    whole = whole.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    ok = F.when(F.col("vec_id").isNotNull() & usable("v"), F.col("v"))
    out = src.select("vec_id", "label", ok.alias("v")).join(whole, ["label", "v"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
