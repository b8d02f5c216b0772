"""Framing of signals: hops, overlapping blocks, channels, resampling. All keys are (sig, frame) or (sig, i), so that a
long signal spreads over all tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hop(n: int, i: str = "i") -> tuple[Column, Column]:
    """(frame, place within it) of a sample index, for hops of n samples."""
    return F.call_function("div", F.col(i), F.lit(n).cast("long")).alias("frame"), (F.col(i) % n).cast("int").alias("p")


def frame_counts(signal: DataFrame, n: int, frame_bits: int) -> DataFrame:
    """(sig, n_samples, n_frames, pad, data_bytes): a silent lead hop, the padded hops and one flush hop."""
    hops = F.ceil(F.col("n_samples") / n)
    out = signal.groupBy("sig").agg(F.count("*").alias("n_samples"))
    out = out.withColumn("n_frames", (hops + 2).cast("long")).withColumn("pad", (hops * n - F.col("n_samples")).cast("long"))
    return out.withColumn("data_bytes", F.ceil(F.col("n_frames") * frame_bits / 8).cast("long"))


def hop_arrays(signal: DataFrame, n: int) -> DataFrame:
    """(sig, frame, x array of n): hops, zeros where samples are missing or null; of repeated samples the largest counts."""
    frame, place = hop(n)
    rows = signal.select("sig", frame, place, "x").groupBy("sig", "frame").agg(F.collect_list(F.struct("p", "x")).alias("a"))
    # a null for every place, before what is there; of each place the last stands
    empty = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.struct(p.alias("p"), F.lit(None).cast("double").alias("x")))
    whole = F.transform(F.array(F.sort_array(F.concat("a", empty))), lambda a: F.filter(a, lambda e, i: F.coalesce(F.try_element_at(a, i + 2)["p"] != e["p"], F.lit(True))))[0]
    return rows.select("sig", "frame", F.transform(whole, lambda e: F.coalesce(e["x"], F.lit(0.0))).alias("x"))


def overlapped(hops: DataFrame, n: int) -> DataFrame:
    """(sig, frame, x array of 2n): the hop before and this one, zeros beyond either end; one frame more than hops."""
    first = hops.select("sig", (F.col("frame") + 1).alias("frame"), F.lit(None).cast("array<double>").alias("b"), F.col("x").alias("a"))
    second = hops.select("sig", "frame", F.col("x").alias("b"), F.lit(None).cast("array<double>").alias("a"))
    silent = F.array_repeat(F.lit(0.0), n)
    both = first.union(second).groupBy("sig", "frame").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select("sig", "frame", F.concat(F.coalesce("a", silent), F.coalesce("b", silent)).alias("x"))


def windowed_samples(signal: DataFrame, n: int) -> DataFrame:
    """(sig, frame, p, x): each sample in the two overlapping blocks that hold it, times the sine window of 2n."""
    frame, place = hop(n)
    rows = signal.select("sig", frame, place, "x", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    p = F.col("p") + F.when(F.col("d") == 1, 0).otherwise(n)
    rows = rows.select("sig", (F.col("frame") + F.col("d")).alias("frame"), p.alias("p"), "x")
    return rows.withColumn("x", F.col("x") * sine_window(F.col("p"), 2 * n))


def sine_window(p: Column, length: int) -> Column:
    """Full sine taper over length places."""
    return F.sin((p + 0.5) * (math.pi / length))


def mid_side(stereo: DataFrame) -> DataFrame:
    """(sig, i, m, s) of the places where both channels have a sample."""
    sides = stereo.groupBy("sig", "i").agg(F.max(F.when(F.col("ch") == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("x"))).alias("r"))
    sides = sides.where("l is not null and r is not null")
    return sides.select("sig", "i", ((F.col("l") + F.col("r")) / 2).alias("m"), ((F.col("l") - F.col("r")) / 2).alias("s"))


def left_right(ms: DataFrame) -> DataFrame:
    """(sig, i, l, r) of mid and side."""
    return ms.select("sig", "i", (F.col("m") + F.col("s")).alias("l"), (F.col("m") - F.col("s")).alias("r"))


def remap_channels(signal: DataFrame, n_in: int, n_out: int) -> DataFrame:
    """Output channel c is input channel min(c, n_in - 1); further inputs are dropped, not mixed."""
    takers = F.array(*[F.array(*[F.lit(c) for c in range(n_out) if min(c, n_in - 1) == k]).cast("array<int>") for k in range(n_in)])
    return signal.where(F.col("ch").between(0, n_in - 1)).select("sig", F.explode(takers[F.col("ch")]).alias("ch"), "i", "x")


def resample_linear(signal: DataFrame, up: int, down: int) -> DataFrame:
    """(sig, i, x) at up/down of the rate, by linear interpolation, ends held; round(n * up / down) samples."""
    div = lambda a, b: F.call_function("div", a, b)
    n = signal.groupBy("sig").agg(F.count("*").alias("n")).select(F.col("sig").alias("s"), "n", div(F.col("n") * (2 * up) + down, F.lit(2 * down).cast("long")).alias("m"))
    after = signal.select(F.col("sig").alias("s2"), (F.col("i") - 1).alias("i2"), F.col("x").alias("b"))
    rows = signal.join(n, F.col("sig") == F.col("s")).join(after, (F.col("sig") == F.col("s2")) & (F.col("i") == F.col("i2")), "left")
    up_, down_ = F.lit(up).cast("long"), F.lit(down).cast("long")
    first = div(F.col("i") * up_ + (down_ - 1), down_)
    last = F.when(F.col("i") == F.col("n") - 1, F.col("m") - 1).otherwise(F.least(div((F.col("i") + 1) * up_ + (down_ - 1), down_) - 1, F.col("m") - 1))
    rows = rows.where(first <= last).withColumn("j", F.explode(F.sequence(first, last)))
    frac = F.col("j") * down / up - F.col("i")
    return rows.select("sig", F.col("j").alias("i"), (F.col("x") + (F.coalesce("b", "x") - F.col("x")) * frac).alias("x"))


def previous(rows: DataFrame, keys: list[str], order: str, columns: list[str], span: int = 64) -> DataFrame:
    """rows with before: a struct of columns of the row before it, by the integer order, among rows of equal keys; null for
    the first.

    No key passes through one task: rows are ordered within spans of the order, and a span begins with a copy of the last
    row of the span before, found among the spans' last rows. Both read the rows as dealt out by span, once, so that what
    makes them is not done again. Rows of equal order are in any order.
    """
    tagged = rows.withColumn("__span", F.floor(F.col(order) / span).cast("long")).repartition(*keys, "__span")
    lasts = tagged.groupBy(*keys, "__span").agg(F.max_by(F.struct(*rows.columns), order).alias("__row"))
    after = F.lead("__span").over(Window.partitionBy(*keys).orderBy("__span"))  # one row for each span
    copies = lasts.withColumn("__span", after).where("__span is not null").select("__row.*", "__span", F.lit(False).alias("__real"))
    place = Window.partitionBy(*keys, "__span").orderBy("__real", order)
    both = tagged.withColumn("__real", F.lit(True)).unionByName(copies)
    return both.withColumn("before", F.lag(F.struct(*columns)).over(place)).where("__real").drop("__span", "__real")


def ranked(rows: DataFrame, keys: list[str], order: str, name: str = "rank", span: int = 4096) -> DataFrame:
    """rows with name: their number from 0 among rows of equal keys, by the integer order. Rows are ranked within spans of
    the order, and spans are offset by the running count of those before, a small table."""
    tagged = rows.withColumn("__span", F.floor(F.col(order) / span).cast("long"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    counts = tagged.groupBy(*keys, "__span").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    counts = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__span").alias("__at"), "__before")
    joined = tagged.join(counts, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__span").eqNullSafe(F.col("__at"))])
    rank = F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(order)) - 1
    return joined.withColumn(name, (F.col("__before") + rank).cast("long")).drop("__span", "__at", "__before", *[f"__{k}" for k in keys])


def valid_after_priming(frames: DataFrame, valid: Column, order: str = "frame", skip: int = 2) -> DataFrame:
    """Frames that give output: valid ones but for each signal's first skip; invalid ones leave no state."""
    return ranked(frames.where(valid), ["sig"], order, "__rank").where(F.col("__rank") >= skip).drop("__rank")
