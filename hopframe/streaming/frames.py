"""Hops of a stream of samples: samples come in micro-batches of any size, hops leave as they fill."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OUT = "sig string, frame long, x array<double>"
_STATE = "carry array<double>, frames long"


def hops(stream: DataFrame, n: int) -> DataFrame:
    """(sig, frame, x array of n) of a stream (sig, i, x): each signal's samples in the order of i, across micro-batches
    that are in order too. The state of a signal is the part of a hop that is left over; the result does not depend on how
    the stream is cut."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carry, done = state.get if state.exists else ([], 0)
        rows = pd.concat(list(parts)).sort_values("i", kind="stable")
        samples = [*carry, *rows["x"].tolist()]
        whole = len(samples) // n
        yield pd.DataFrame({"sig": [key[0]] * whole, "frame": range(done, done + whole), "x": [samples[k * n : (k + 1) * n] for k in range(whole)]})
        state.update((samples[whole * n :], done + whole))

    return stream.groupBy("sig").applyInPandasWithState(run, _OUT, _STATE, "append", "NoTimeout")


def flush(whole: DataFrame, signal: DataFrame, n: int) -> DataFrame:
    """The hops of a finished stream with what flushing adds: the last, padded hop of each signal and a silent one."""
    from pyspark.sql import functions as F

    from ..operators.framing import hop_arrays

    count = signal.groupBy("sig").agg(F.count("*").alias("c"))
    rest = signal.join(count, "sig").where(F.col("i") >= F.call_function("div", F.col("c"), F.lit(n)) * n)
    silent = count.select("sig", F.ceil(F.col("c") / n).cast("long").alias("frame"), F.array_repeat(F.lit(0.0), n).alias("x"))
    return whole.unionByName(hop_arrays(rest.select("sig", "i", "x"), n)).unionByName(silent)
