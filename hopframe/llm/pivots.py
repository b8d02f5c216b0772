"""Permutation indexes over vectors: every vector is described by its nearest pivots, nearest first, and posted in their
inverted lists. Used by the nearest-neighbour search and by the near-duplicate join of vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Not null, not empty, without null, NaN or infinite components, not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def sampled(vectors: DataFrame, id_col: str, vec_col: str, n: int, seed: int = 3) -> np.ndarray:
    """A hash-chosen sample of 4n rows as unit vectors: the rows with the smallest (hash of id, id); vectors of a length
    that is not the sample's commonest are left out. An empty table gives an array without rows."""
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = vectors.select(order.alias("h"), F.col(id_col).alias("i"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("h", "i").limit(4 * n).collect()
    if not rows:
        return np.zeros((0, 0))
    lengths = [len(r["v"]) for r in rows]
    dim = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([r["v"] for r in rows if len(r["v"]) == dim])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread_out(x: np.ndarray, n: int, apart: float = 0.9) -> np.ndarray:
    """At most n of the rows of x, greedily so that no two have a cosine over apart."""
    kept: list[int] = []
    for i in range(len(x)):
        if len(kept) == n:
            break
        if not kept or (x[kept] @ x[i]).max() <= apart:
            kept.append(i)
    return x[kept]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the indices of its depth nearest pivots by angle, nearest first; ties to the smaller index."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    scaled = x / np.where(np.isfinite(norm) & (norm > 0), norm, 1)
    out = []
    for lo in range(0, len(x), 8192):
        out.append(np.argsort(-(scaled[lo : lo + 8192] @ pivots.T), axis=1, kind="stable")[:, :depth])
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, depth), np.int32)


def mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of each id."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def nearest_points(x: np.ndarray, points: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the indices of its depth nearest points by Euclidean distance, nearest first; ties to the smaller
    index. Distances are taken around the points' mean, so that a common shift costs no precision."""
    centre = points.mean(0)
    p = points - centre
    half = (p * p).sum(1) / 2
    out = []
    step = max(64, (1 << 21) // len(points))
    for lo in range(0, len(x), step):
        d = half - (x[lo : lo + step] - centre) @ p.T
        if depth == 1:
            out.append(d.argmin(1)[:, None])
            continue
        out.append(np.argsort(d, axis=1, kind="stable")[:, :depth])
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, depth), np.int32)
