"""Signals as rows (sig, i, x) or (sig, ch, i, x): derived from event tables, or generated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, keys: list[str], ts: str, ties: list[str], name: str = "i", seconds: int = 3600) -> DataFrame:
    """Number each key's rows from 0 by (ts, ties).

    No key passes through one task: rows are ranked within a span of seconds, and spans are offset by the running count
    of the spans before, which is a small table. Null times come first.
    """
    span = F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).cast("long"), F.lit(-(2**62)))
    df = df.withColumn("__span", span)
    counts = df.groupBy(*keys, "__span").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__span").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    on = [df[k].eqNullSafe(F.col(f"__{k}")) for k in keys] + [df["__span"] == F.col("__at")]
    joined = df.join(offsets, on)
    rank = F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(F.col(ts).asc_nulls_first(), *ties)) - 1
    return joined.withColumn(name, (F.col("__before") + rank).cast("long")).drop("__span", "__at", "__before", *[f"__{k}" for k in keys])


def from_events(events: DataFrame, offset: float = 50.0, scale: float = 500.0) -> DataFrame:
    """(sig, i, x): one signal for each event type, x = (value - offset) / scale."""
    rows = events.select(F.col("event_type").alias("sig"), "ts", "event_id", ((F.col("value") - offset) / scale).alias("x"))
    return dense_index(rows, ["sig"], "ts", ["event_id"]).select("sig", "i", "x")


def stereo_from_events(events: DataFrame, offset: float = 50.0, scale: float = 500.0) -> DataFrame:
    """(sig, ch, i, x): channel by the parity of event_id, indexed anew within the channel."""
    rows = events.select(F.col("event_type").alias("sig"), (F.col("event_id") % 2).cast("int").alias("ch"), "ts", "event_id", ((F.col("value") - offset) / scale).alias("x"))
    return dense_index(rows, ["sig", "ch"], "ts", ["event_id"]).select("sig", "ch", "i", "x")


def generated(spark: SparkSession, n: int, parts: list[tuple[float, float]], rate: float = 44_100.0, sweep: float = 0.0, sig: str = "tone") -> DataFrame:
    """(sig, i, x): a sum of amplitude * sin(2 pi (frequency t + sweep t^2)) over n samples."""
    t = F.col("i") / rate
    x: Column = F.lit(0.0)
    for amplitude, frequency in parts:
        x = x + amplitude * F.sin(2 * math.pi * (frequency * t + sweep * t * t))
    return spark.range(n).select(F.lit(sig).alias("sig"), F.col("id").alias("i")).withColumn("x", x)


def noise(n: int, state: int = 1) -> list[float]:
    """Samples in [-1, 1) of the linear congruential generator 1664525 x + 1013904223 modulo 2**32."""
    out = []
    for _ in range(n):
        state = (state * 1_664_525 + 1_013_904_223) % 2**32
        out.append((state >> 8) / 8_388_608 - 1)
    return out
