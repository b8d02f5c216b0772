"""Quality of a signal y against x: one aggregation, no driver loop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _db(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 10 * F.log10(a / b))


def quality(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, n, snr_db, gain_db, correlation (uncentred), peak, clipped_percent; dB are null where a sum is 0."""
    X, Y = F.col(x), F.col(y)
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(X * X).alias("xx"), F.sum(Y * Y).alias("yy"), F.sum(X * Y).alias("xy"), F.sum((X - Y) * (X - Y)).alias("dd"), F.max(F.abs(Y)).alias("peak"), F.avg(F.when(F.abs(Y) >= 1, 100.0).otherwise(0.0)).alias("clipped_percent"))
    corr = F.when(F.col("xx") * F.col("yy") > 0, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return sums.select(*keys, "n", _db(F.col("xx"), F.col("dd")).alias("snr_db"), _db(F.col("yy"), F.col("xx")).alias("gain_db"), corr.alias("correlation"), "peak", "clipped_percent")


def trimmed(pairs: DataFrame, keys: list[str], skip: int, i: str = "i") -> DataFrame:
    """pairs without the first and last skip places of each key, by the largest i."""
    ends = pairs.groupBy(*keys).agg(F.max(i).alias("__end")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__end")
    rows = pairs.where(F.col(i) >= skip).join(ends, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.where(F.col(i) <= F.col("__end") - skip).drop("__end", *[f"__{k}" for k in keys])


def lag_correlation(x: DataFrame, y: DataFrame, lags: list[int], block: int = 4096, stride: int = 1, least: int = 1) -> DataFrame:
    """(sig, lag, correlation) of x[i] and y[i + lag], for each of a bounded list of lags, over the places that both have,
    of every stride-th i; lags with fewer than least such places give no row.

    Each block of x meets the samples of y that its lags reach, so that a sample is sent once or twice whatever the lags;
    sums of the blocks are added. Of repeated samples the largest counts; null ones are missing.
    """
    reach = max(abs(k) for k in lags)
    block = max(block, 2 * reach + 1)
    div = lambda a: F.floor(a / block).cast("long")
    own = x.where(F.col("i") % stride == 0).select("sig", div(F.col("i")).alias("b"), F.lit(False).alias("other"), "i", "x")
    near = F.array_distinct(F.array(div(F.col("i") - reach), div(F.col("i") + reach)))
    other = y.select("sig", F.explode(near).alias("b"), F.lit(True).alias("other"), "i", "x")

    def sums(group: pa.Table) -> pa.Table:
        start = group.column("b")[0].as_py() * block
        which, i, v = (group.column(c).to_numpy() for c in ("other", "i", "x"))
        a, b = np.full(block, -np.inf), np.full(block + 2 * reach, -np.inf)
        np.maximum.at(a, i[~which] - start, v[~which])
        np.maximum.at(b, i[which] - start + reach, v[which])
        there, met = a > -np.inf, b > -np.inf
        a, b = np.where(there, a, 0), np.where(met, b, 0)
        out = []
        for k in lags:
            s = slice(reach + k, reach + k + block)
            out.append((int((there & met[s]).sum()), a @ b[s], (a * a) @ met[s], there @ (b[s] * b[s])))
        kept = [j for j, r in enumerate(out) if r[0]]
        columns = [pa.array([out[j][c] for j in kept], pa.float64()) for c in (0, 1, 2, 3)]
        return pa.table({"sig": pa.array([group.column("sig")[0].as_py()] * len(kept), group.schema.field("sig").type), "lag": pa.array([lags[j] for j in kept], pa.int32()), "n": columns[0], "xy": columns[1], "xx": columns[2], "yy": columns[3]})

    kind = x.schema["sig"].dataType.simpleString()
    parts = own.union(other).where("x is not null").groupBy("sig", "b").applyInArrow(sums, f"sig {kind}, lag int, n double, xy double, xx double, yy double")
    sums_ = parts.groupBy("sig", "lag").agg(F.sum("n").alias("n"), F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"))
    return sums_.where(F.col("n") >= least).select("sig", "lag", F.when(F.col("xx") * F.col("yy") > 0, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("correlation"))


def fft_lag(x: DataFrame, y: DataFrame, start: int = 8192, count: int = 65_536, most: int = 8192) -> DataFrame:
    """(sig, lag, polarity, score): the lag within +-most at which the cross-correlation of count samples from start on is
    largest in absolute value, ties (to 9 digits) to the smaller lag, and its sign; by one FFT for each signal.

    Samples outside the range are not read, missing ones are 0; signals without samples in it in both give no row.
    """
    size = 1 << (count + most - 1).bit_length()
    part = lambda df, other: df.where((F.col("i") >= start) & (F.col("i") < start + count) & F.col("x").isNotNull()).select("sig", F.lit(other).alias("other"), (F.col("i") - start).alias("i"), "x")

    def found(group: pa.Table) -> pa.Table:
        which, i, v = (group.column(c).to_numpy() for c in ("other", "i", "x"))
        kept = 0 < which.sum() < len(which)
        a, b = np.zeros(size), np.zeros(size)
        a[i[~which]], b[i[which]] = v[~which], v[which]
        c = np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), size)
        lags = np.arange(-most, most + 1)
        score = c[lags % size]
        at = int(np.round(np.abs(score), 9).argmax())
        row = [(group.column("sig")[0].as_py(), int(lags[at]), int(np.sign(score[at])), float(score[at]))] if kept else []
        columns = list(zip(*row, strict=True)) or [()] * 4
        return pa.table({"sig": pa.array(columns[0], group.schema.field("sig").type), "lag": pa.array(columns[1], pa.int32()), "polarity": pa.array(columns[2], pa.int32()), "score": pa.array(columns[3], pa.float64())})

    kind = x.schema["sig"].dataType.simpleString()
    return part(x, False).union(part(y, True)).groupBy("sig").applyInArrow(found, f"sig {kind}, lag int, polarity int, score double")  # 2 count rows a signal


def report(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, report): the other columns of a row as one JSON object; nulls are left out."""
    return results.select(*keys, F.to_json(F.struct(*[c for c in results.columns if c not in keys])).alias("report"))


def best_lag(x: DataFrame, y: DataFrame, lags: list[int], stride: int = 1, least: int = 1) -> DataFrame:
    """(sig, lag, correlation): the lag of the largest absolute correlation, ties to the smaller lag; the sign is the
    polarity."""
    c = lag_correlation(x, y, lags, stride=stride, least=least)
    best = c.groupBy("sig").agg(F.max(F.struct(F.round(F.abs("correlation"), 12).alias("a"), (-F.col("lag")).alias("l"), F.col("correlation").alias("c"))).alias("b"))
    return best.select("sig", (-F.col("b.l")).cast("int").alias("lag"), F.col("b.c").alias("correlation"))
