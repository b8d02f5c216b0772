"""Near-duplicate documents by min-max hashing: each hash function gives two signature values, its minimum and maximum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import bound_batches, materialize, release
from .components import connected_components

#: 80 hash functions make 160 values, 32 bands of 5: two texts with similarity 0.8 share no band with chance 3e-6.
BANDS, ROWS = 32, 5
#: Two signatures that agree in a smaller share of their 160 bytes are no candidates: at similarity 0.8 the share is
#: 0.8 with a deviation of 0.032, so that a link falls below with chance 1e-8.
AGREE = 0.62
#: Members of a block, and shingles of a block: larger buckets and clusters are compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 150_000


class _WordHash(dict):
    """64-bit hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A text of fewer words than width has one
    shingle, all its words; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _MULT + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every hash function over the set, side by side."""
    low, high = np.full(len(mult), 2**64 - 1, np.uint64), np.zeros(len(mult), np.uint64)
    for i in range(0, len(shingles), 1024):
        h = mult[:, None] * shingles[None, i : i + 1024] + add[:, None]
        h ^= h >> np.uint64(32)
        h *= _MULT
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.stack([low, high], 1).reshape(-1)


def signatures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, fp, sig, bands): the set's size, a 128-bit fingerprint of the full set, a byte of each
    signature value, and a 64-bit key for each band. fp, sig and bands are null for a text without words."""
    bound_batches(docs.sparkSession)
    n = -(-bands * rows // 2)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _coefficients(n)
        tag = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            size, fp, sig, keys = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width)
                size.append(len(s))
                if not len(s):
                    fp.append(None), sig.append(None), keys.append(None)
                    continue
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                v = signature(s, mult, add)[: bands * rows]
                sig.append((v >> np.uint64(32)).astype(np.uint8).tobytes())
                key = tag.copy()
                for column in v.reshape(bands, rows).T:
                    key = _mix(key * _MULT + column)
                keys.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
        _HASHES.clear()
        release()

    return src.mapInArrow(run, "doc_id long, n_shingles long, fp binary, sig binary, bands array<long>")


def _local_roots(linked) -> np.ndarray:
    """Smallest index reachable from each index, by a function from index to the indices linked with it."""
    n = len(linked)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, others in enumerate(linked):
        for j in others:
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], dtype=np.int64)


def _agreeing(sig: np.ndarray, least: float) -> list[np.ndarray]:
    """For each row, one row of each later group that agrees enough; rows already joined are not compared again."""
    n, width = sig.shape
    root = np.arange(n)
    links: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        for lo in range(0, len(rest), 65536):
            part = rest[lo : lo + 65536]
            hit = part[np.count_nonzero(sig[part] == sig[i], axis=1) >= least * width]
            if len(hit):
                links[i] = np.concatenate([links[i], hit])
                root[np.isin(root, root[hit])] = root[i]
    return links


def _sharing(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """For each set, the earlier sets with 100 * intersection >= percent * union, counted through postings."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    ends = np.r_[starts[1:], len(values)]
    heads = values[starts]
    links = []
    for i, s in enumerate(sets):
        at = np.searchsorted(heads, s)
        at = at[ends[at] - starts[at] > 1]
        if not len(at):
            links.append(np.zeros(0, np.int64))
            continue
        common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(starts[at], ends[at], strict=True)]), minlength=len(sets))[:i]
        links.append(np.flatnonzero(100 * common >= percent * (size[:i] + size[i] - common)))
    return links


def _in_blocks(df: DataFrame, key: str, node: str, n_blocks) -> DataFrame:
    """Give every row a group: its whole key, or for keys of several blocks each pair of blocks that it belongs to."""
    own = F.pmod(F.xxhash64(node), F.col("n_blocks"))
    groups = F.when(F.col("n_blocks") == 1, F.array(F.array(F.lit(0), F.lit(0)).cast("array<long>"))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda j: j != F.col("own")), lambda j: F.array(F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    )
    return df.withColumn("n_blocks", n_blocks.cast("long")).withColumn("own", own).withColumn("pair", F.explode(groups)).drop("n_blocks")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links are pairs with 100 * |A & B| >= percent * |A | B| on full shingle sets; component_id is the smallest doc_id
    reachable, kept marks it. Copies (equal sets) become one class first. Classes that share a band are candidates;
    within a bucket signatures discard what is surely apart, the rest forms candidate clusters, and each cluster's
    full sets decide. Buckets and clusters over a block's size are compared by pairs of blocks, so that no task holds
    more than two blocks and no pair is lost or written out.

    Null and empty texts have no shingles, link with nothing and are kept; so are rows with a null doc_id (their
    component_id is null). Rows that repeat a doc_id are one node. Extra columns are ignored.
    """
    signed = materialize(signatures(docs, text_col, id_col, width, bands, rows), "signed")
    spark = docs.sparkSession
    classes = (
        signed.where("fp is not null and doc_id is not null")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    classes = materialize(classes, "classes")
    posted = classes.select("rep", F.explode("bands").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    bucket = posted.join(shared, "key").join(classes.select("rep", "sig"), "rep")
    bucket = _in_blocks(bucket, "key", "rep", F.ceil(F.col("n") / BLOCK))

    def candidates(group: pa.Table) -> pa.Table:
        rep = group.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(rep), -1)[order]
        rep = rep[order]
        root = rep[_local_roots(_agreeing(sig, AGREE))]
        at = root != rep
        return pa.table({"a": rep[at], "b": root[at]})

    linked = bucket.select("key", "pair", "rep", "sig").groupBy("key", "pair").applyInArrow(candidates, "a long, b long")
    cluster = materialize(connected_components(linked), "clusters")

    sized = cluster.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    totals = sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    members = sized.join(totals, "component").select("node", "component", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).alias("blocks"))
    members = materialize(members, "members")
    if members.count() <= 1_000_000:  # 24 bytes a row
        members = F.broadcast(members)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(members, "node")
    texts = _in_blocks(texts, "component", "node", F.col("blocks"))

    def confirm(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        sets = [shingle_set(x.as_py(), width) for x in group.column("text")]
        order = sorted((i for i in range(len(node)) if len(sets[i])), key=lambda i: (node[i], len(sets[i])))
        node, sets = node[order], [sets[i] for i in order]
        if len(node) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root = node[_local_roots(_sharing(sets, percent))]
        at = root != node
        return pa.table({"a": node[at], "b": root[at]})

    links = texts.select("component", "pair", "node", "text").groupBy("component", "pair").applyInArrow(confirm, "a long, b long")
    parts = connected_components(links).withColumnRenamed("component", "root")

    whole = classes.select("fp", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n_shingles", "fp").join(whole, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
