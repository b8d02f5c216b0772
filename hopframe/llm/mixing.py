"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents lie in hash-permuted blocks of their source. A source's target is met by whole passes over its blocks and part
of one more pass; the tree splits the exact numbers of block draws of all sources among the output shards, half by half;
every shard then takes the next blocks of each source's permuted order and shuffles its documents locally.

Sources, blocks and draws are tables. The driver holds the tree over at most GROUPS groups of sources; within a group the
tree goes on where the group lies, which is the same distribution.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialize

#: Documents of a block, and blocks of one source: a source with more documents has larger blocks, so that the order of its
#: blocks fits one task.
BLOCK_DOCS, SOURCE_BLOCKS = 256, 65_536
#: Words of a shard, some 13 MB, and shards at least and at most: beyond 137 billion words shards grow.
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 1 << 21, 32, 65_536
#: Groups of sources, and numbers that the driver's part of the tree may have.
GROUPS, TREE_SIZE = 1024, 1 << 20
#: Rows of a plan that are broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
_ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_draws")


def split_quotas(quotas: np.ndarray, totals: np.ndarray | int, rng: np.random.Generator) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places of quotas, numbers) of draws by halving: the left half's numbers are multivariate hypergeometric.

    totals are the shards' numbers of draws, which sum to the quotas' sum; a number of shards gives them equal ones (up to
    one). Only what a half draws from is carried on, and only numbers over 0 are returned.
    """
    quotas = np.asarray(quotas, np.int64)
    if isinstance(totals, int):
        totals = np.diff(quotas.sum() * np.arange(totals + 1) // totals)
    ends = np.concatenate([[0], np.cumsum(totals)])
    at = np.flatnonzero(quotas)
    out, stack = [], [(0, len(totals), at, quotas[at])]
    while stack:
        lo, hi, at, q = stack.pop()
        if not len(at):
            continue
        if hi - lo == 1:
            out.append((lo, at, q))
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(q, int(ends[mid] - ends[lo]), method="marginals")
        right = q - left
        stack += [(mid, hi, at[right > 0], right[right > 0]), (lo, mid, at[left > 0], left[left > 0])]
    return out


def fill(keyed: list[tuple[int, int]], rest: float) -> list[int]:
    """Keys whose sizes sum to about rest: in key order each that still fits, then one more if that ends nearer."""
    taken, left = [], rest
    over: tuple[int, int] | None = None
    for key, size in sorted(keyed):
        if size <= left:
            taken.append(key)
            left -= size
        elif over is None or size < over[0]:
            over = size, key
    if over and over[0] - left < left:
        taken.append(over[1])
    return taken


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _lookup(df: DataFrame) -> DataFrame:
    """df to be broadcast, if its rows are counted and few."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


@dataclass
class MixPlan:
    """What a mix takes. sources: s, source, n_blocks, source_size, target; blocks: source, block, shards (of each whole
    draw) and cut (the shard of a draw that is cut, or null); chosen: source, key of the rows that a cut draw takes."""

    n_shards: int
    sources: DataFrame
    blocks: DataFrame
    chosen: DataFrame


def _with_targets(sources: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """Add source (its place in code-point order, null last), weight and target.

    Targets are shares of total_share of all words by weight, none above most times its size; what is cut is shared again
    among the others by weight. So all are at one level times their weight, or at their most. In the order of size by
    weight, the level that the sources from one on would share rises while that one cannot bear it, and falls after.
    """
    place = F.row_number().over(Window.orderBy(F.col("s").isNull(), "s")) - 1  # one row a source
    weighed = sources.withColumn("source", place).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source") % len(weights) + 1))
    live = F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_) * total_share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    level = left / F.nullif(F.sum(live).over(all_) - F.coalesce(F.sum(live).over(before), F.lit(0.0)), F.lit(0.0))
    bears = (F.col("source_size") > 0) & (level * F.col("weight") <= F.col("source_size") * most)
    levelled = weighed.withColumn("level", F.when(bears, level)).withColumn("level", F.max("level").over(all_))
    over = F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("source_size") * most)
    target = F.when(F.col("source_size") == 0, 0.0).when(over, F.col("source_size") * F.lit(float(most))).otherwise(F.col("level") * F.col("weight"))
    return levelled.withColumn("target", target).drop("level")


def _assigned(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(source, rank, shard) of every draw: which shard takes the draw of that rank in its source's order."""
    spark = quotas.sparkSession
    groups = min(GROUPS, max(1, TREE_SIZE // n_shards))
    grouped = quotas.withColumn("g", F.col("source") % groups)
    sums = {r["g"]: r["n"] for r in grouped.groupBy("g").agg(F.sum("quota").alias("n")).collect()}
    names = sorted(sums)
    totals = np.zeros((len(names), n_shards), np.int64)
    for shard, at, n in split_quotas(np.array([sums[g] for g in names], np.int64), n_shards, np.random.default_rng(seed)):
        totals[at, shard] = n
    table = spark.createDataFrame([(g, t.tolist()) for g, t in zip(names, totals, strict=True)], "g int, totals array<long>")

    def split(group: pa.Table) -> pa.Table:
        source, quota = group.column("source").to_numpy(), group.column("quota").to_numpy()
        order = np.argsort(source)
        source, quota = source[order], quota[order]
        rng = np.random.default_rng([seed, int(group.column("g")[0].as_py())])
        found = split_quotas(quota, np.array(group.column("totals")[0].as_py(), np.int64), rng)
        at = np.concatenate([a for _, a, _ in found])
        shard = np.concatenate([np.full(len(a), k) for k, a, _ in found])
        n = np.concatenate([c for _, _, c in found])
        order = np.lexsort((shard, at))
        draws, shards = np.repeat(at[order], n[order]), np.repeat(shard[order], n[order])
        rank = np.arange(len(draws)) - np.searchsorted(draws, draws)
        return pa.table({"source": pa.array(source[draws], pa.int32()), "rank": pa.array(rank, pa.int64()), "shard": pa.array(shards, pa.int32())})

    # GROUPS rows and TREE_SIZE numbers at most
    return grouped.where("quota > 0").join(F.broadcast(table), "g").groupBy("g").applyInArrow(split, "source int, rank long, shard int")


def plan_mix(slim: DataFrame, weights: tuple[float, ...], total_share: float, most: float, n_shards: int | None, seed: int) -> MixPlan:
    """The plan for rows (s, key, size): source, hash of the id, and words."""
    sources = slim.groupBy("s").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    sources = _with_targets(sources, weights, total_share, most)
    # more blocks than one task can order become larger ones
    per_block = F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.col("docs") / SOURCE_BLOCKS))
    whole = F.when(F.col("source_size") == 0, F.lit(int(most))).otherwise(F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).cast("int")
    sources = sources.withColumn("n_blocks", F.ceil(F.col("docs") / per_block).cast("long")).withColumn("whole", whole)
    sources = materialize(sources.withColumn("rest", F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))), "mix-sources")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n_shards = n_shards or min(MOST_SHARDS, max(LEAST_SHARDS, int(-(-total // SHARD_WORDS))))
    known = _lookup(sources)
    tagged = slim.join(known.select("s", "source", "n_blocks"), slim["s"].eqNullSafe(known["s"])).select("source", F.pmod("key", "n_blocks").alias("block"), "key", "size")
    blocks = tagged.groupBy("source", "block").agg(F.sum("size").alias("n")).join(known.select("source", "whole", "rest"), "source")

    # a draw for each whole pass, in an order of its own, and for the part of one more that the rest fills
    draws = blocks.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("whole")))).withColumn("h", F.xxhash64("source", "block", "turn", F.lit(seed)))
    order = Window.partitionBy("source").orderBy("turn", "h", "block")  # SOURCE_BLOCKS rows a turn at most
    partial = F.col("turn") == F.col("whole")
    before = F.coalesce(F.sum(F.when(partial, F.col("n")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    draws = draws.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("left", F.when(partial, F.col("rest") - before))
    draws = materialize(draws.where(~partial | (F.col("left") > 0)).select("source", "block", "rank", F.when(F.col("n") > F.col("left"), F.col("left")).alias("left")), "mix-draws")
    assigned = _assigned(draws.groupBy("source").agg(F.count("*").alias("quota")), n_shards, seed)
    placed = draws.join(assigned, ["source", "rank"]).groupBy("source", "block")
    cut = F.col("left").isNotNull()
    placed = placed.agg(F.sort_array(F.collect_list(F.when(~cut, F.col("shard")))).alias("shards"), F.max(F.when(cut, F.col("shard"))).alias("cut"))  # a row for each turn

    # of each source one block is cut: its rows, BLOCK_DOCS or so, are chosen by key
    cuts = draws.where(cut).select("source", "block", "left")
    edge = tagged.join(_lookup(cuts), ["source", "block"]).groupBy("source", "key").agg(F.sum("size").alias("size"), F.max("left").alias("left"))

    def choose(group: pa.Table) -> pa.Table:
        keyed = list(zip(group.column("key").to_pylist(), group.column("size").to_pylist(), strict=True))
        taken = fill(keyed, group.column("left")[0].as_py())
        return pa.table({"source": pa.array([group.column("source")[0].as_py()] * len(taken), pa.int32()), "key": pa.array(taken, pa.int64())})

    chosen = edge.groupBy("source").applyInArrow(choose, "source int, key long")
    return MixPlan(n_shards, sources.select("s", "source", "n_blocks", "source_size", "target"), materialize(placed, "mix-blocks"), materialize(chosen, "mix-chosen"))


def _mixed(docs: DataFrame, weights: tuple[float, ...], total_share: float, most: float, n_shards: int | None, text_col: str, source_col: str, id_col: str, seed: int) -> tuple[DataFrame, int]:
    """docs with its columns called c0, c1 and so on, and _ADDED; and the number of shards."""
    place = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    base = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = F.xxhash64(place[id_col], F.lit(seed))
    slim = materialize(base.select(place[source_col].alias("s"), key.alias("key"), _size(place[text_col]).alias("size")), "mix-sizes")
    plan = plan_mix(slim, weights, total_share, most, n_shards, seed)
    sources, blocks, chosen = _lookup(plan.sources), _lookup(plan.blocks), _lookup(plan.chosen)
    tagged = base.join(sources, place[source_col].eqNullSafe(F.col("s"))).withColumn("key", key).withColumn("block", F.pmod("key", "n_blocks"))
    out = tagged.join(blocks, ["source", "block"], "left").join(chosen.withColumn("in_cut", F.lit(True)), ["source", "key"], "left")
    shards = F.concat(F.coalesce("shards", F.array().cast("array<int>")), F.when(F.col("cut").isNotNull() & F.col("in_cut"), F.array("cut")).otherwise(F.array().cast("array<int>")))
    draw = lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.col("key"), s, i).alias("place"))
    return out.select(*place.values(), _size(place[text_col]).alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.transform(shards, draw).alias("mix_draws")), plan.n_shards


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, n_shards: int | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 20_240_607) -> DataFrame:
    """Every row of docs with four columns more: mix_size, mix_source_size, mix_target and mix_draws, an array of
    struct(shard int, place long), one for each time that the mix takes the row.

    Sources in code-point order, null last, weigh weights, repeated in turn; they share total_share of all words, none
    over most times its own. A source's rows are all taken as often as its target holds its size, and once more as far
    as the rest goes: whole blocks, then those rows of the block where the rest ends that fill it best in hash order. The
    result depends on ids, sizes and seed alone. Rows of a source that repeat an id are taken together. There are so many
    shards as the words need (SHARD_WORDS), unless n_shards says it.

    Null texts have no words; a source without words is taken once for each whole number that most holds and has target
    0. Null ids hash as one id. An empty table gives no row. Columns of docs called as those four raise ValueError; any
    other name is free.
    """
    if clash := set(_ADDED) & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    mixed, _ = _mixed(docs, weights, total_share, most, n_shards, text_col, source_col, id_col, seed)
    return mixed.toDF(*docs.columns, *_ADDED)


def shuffled(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, n_shards: int | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 20_240_607) -> DataFrame:
    """The mix itself, see mix(): a row of docs for each draw, in one partition for each shard, shuffled within it. The
    columns are those of docs, whatever their names."""
    mixed, shards = _mixed(docs, weights, total_share, most, n_shards, text_col, source_col, id_col, seed)
    out = mixed.withColumn("draw", F.explode("mix_draws")).drop(*_ADDED)
    out = out.withColumns({"shard": F.col("draw.shard"), "place": F.col("draw.place")}).repartitionById(shards, "shard").sortWithinPartitions("shard", "place")
    return out.drop("draw", "shard", "place").toDF(*docs.columns)
