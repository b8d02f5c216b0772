"""Lapped cosine transforms. Frames are arrays; numpy multiplies a batch of frames by the basis, or runs an FFT of the
folded frames where they are long. X[k] = scale * sum of x[n] cos((n + 1/2 + N/2)(k + 1/2) pi / N) over 2N places."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .framing import previous, ranked

#: Frames of this length and more take the FFT.
FFT_FROM = 128


@cache
def basis(n: int) -> np.ndarray:
    """2n rows of places, n columns of frequencies."""
    p, k = np.arange(2 * n)[:, None], np.arange(n)[None]
    return np.cos((p + 0.5 + n / 2) * (k + 0.5) * (np.pi / n))


def _fold(x: np.ndarray) -> np.ndarray:
    """2n places to the n that a type-4 cosine transform takes."""
    a, b, c, d = np.split(x, 4, axis=1)
    return np.concatenate([-c[:, ::-1] - d, a - b[:, ::-1]], 1)


def _dct4(v: np.ndarray) -> np.ndarray:
    """sum of v[m] cos((m + 1/2)(k + 1/2) pi / n), by one complex FFT of twice the length."""
    n = v.shape[1]
    m = np.arange(n)
    z = np.fft.fft(v * np.exp(-0.5j * np.pi * m / n), 2 * n, axis=1)[:, :n]
    return (z * np.exp(-0.5j * np.pi * (m + 0.5) / n)).real


def mdct(x: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Rows of 2n to rows of n."""
    n = x.shape[1] // 2
    return scale * (x @ basis(n) if n < FFT_FROM else _dct4(_fold(x)))


def imdct(coefs: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Rows of n to rows of 2n, time-aliased; overlapping windowed blocks cancel the alias."""
    n = coefs.shape[1]
    if n < FFT_FROM:
        return scale * (coefs @ basis(n).T)
    y = _dct4(coefs)
    lo, hi = y[:, : n // 2], y[:, n // 2 :]
    return scale * np.concatenate([hi, -hi[:, ::-1], -lo[:, ::-1], -lo], 1)


def imdct_half(coefs: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """The middle half of imdct()."""
    n = coefs.shape[1]
    return imdct(coefs, scale)[:, n // 2 : n // 2 + n]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def apply_arrays(df: DataFrame, column: str, width: int, kernel) -> DataFrame:
    """df with an array<double> column of fixed width replaced by kernel(matrix of rows)."""
    schema = df.schema
    at = schema.fieldNames().index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ascontiguousarray(kernel(_rows(batch.column(at), width)))
            n = out.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(out) + 1) * n, n, dtype=np.int32)), pa.array(out.reshape(-1)))
            columns = list(batch.columns)
            columns[at] = lists
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def window(n: int) -> np.ndarray:
    """Sine taper over 2n places."""
    return np.sin((np.arange(2 * n) + 0.5) * (np.pi / (2 * n)))


def forward(blocks: DataFrame, n: int, scale: float | None = None) -> DataFrame:
    """Blocks of 2n places (see framing.overlapped) to n coefficients each, sine-windowed; scale is 2/n by default."""
    return apply_arrays(blocks, "x", 2 * n, lambda x: mdct(x * window(n), 2 / n if scale is None else scale))


def inverse(coefs: DataFrame, n: int) -> DataFrame:
    """(sig, frame, x array of n): hops, each the sum of the halves of two windowed blocks that cover it."""
    blocks = apply_arrays(coefs.select("sig", "frame", "x"), "x", n, lambda c: imdct(c) * window(n))
    late = blocks.select("sig", "frame", F.slice("x", n + 1, n).alias("h"))
    early = blocks.select("sig", (F.col("frame") - 1).alias("frame"), F.slice("x", 1, n).alias("h"))
    halves = late.union(early).groupBy("sig", "frame").agg(F.collect_list("h").alias("hs"))  # two arrays at most
    both = F.when(F.size("hs") == 2, F.zip_with(F.col("hs")[0], F.col("hs")[1], lambda a, b: a + b)).otherwise(F.col("hs")[0])
    return halves.where("frame >= 0").select("sig", "frame", both.alias("x"))


def samples(hops: DataFrame, n: int) -> DataFrame:
    """(sig, i, x) of hops."""
    return hops.select("sig", "frame", F.posexplode("x").alias("p", "x")).select("sig", (F.col("frame") * n + F.col("p")).alias("i"), "x")


#: Class of the slope at the start of a frame by window type (0 long, 1 medium, 2 half a short block).
SLOPE_CLASS = (0, 0, 2, 2, 2, 1, 0, 1, 1)
#: Window types of frames of medium and short blocks; all others are one block.
MEDIUM_TYPES, SHORT_TYPES = (4, 7, 8), (2,)


def _block_slopes(kind: int, n: int, sub_medium: int, sub_short: int) -> list[tuple[int, int]]:
    """(size, width of the slope at its start) of a frame's blocks."""
    widths = (n, n // sub_medium, n // (2 * sub_short))
    if kind in SHORT_TYPES:
        return [(n // sub_short, widths[SLOPE_CLASS[kind]])] * sub_short
    if kind not in MEDIUM_TYPES:
        return [(n, widths[SLOPE_CLASS[kind]])]
    own = [8] * sub_medium
    if kind == 4:
        own[0] = 4
    if kind == 7:
        own[-1] = 7
    return [(n // sub_medium, widths[SLOPE_CLASS[x]]) for x in own]


def _lines(spectra: np.ndarray, window_types: list[int], n: int, sub_medium: int, sub_short: int, stereo: bool) -> np.ndarray:
    """Frames x signals x n coefficients to signals x samples: see synthesise(). All signals have the same window types."""
    blocks, start = [], 0
    for rows, kind in zip(spectra, window_types, strict=True):
        at = 0
        for size, slope in _block_slopes(kind, n, sub_medium, sub_short):
            blocks.append((start + at, size, slope, rows[:, at : at + size]))
            at += size
        start += n
    line = np.zeros((spectra.shape[1], start + 2 * n))  # time -n comes first
    rise = lambda w: np.sin((np.arange(w) + 0.5) * (np.pi / (2 * w)))
    for j, (t, size, slope, coefs) in enumerate(blocks):
        after = blocks[j + 1][2] if j + 1 < len(blocks) else size
        if max(slope, after) > size:
            raise ValueError(f"the block at {t} is shorter than the slope beside it")
        shape = np.concatenate([np.zeros((size - slope) // 2), rise(slope), np.ones((size - slope) // 2), np.ones((size - after) // 2), rise(after)[::-1], np.zeros((size - after) // 2)])
        scale = -np.sqrt((1.0 if stereo else 2.0) / size) / 32768.0
        line[:, n + t - size // 2 : n + t + size + size // 2] += imdct(coefs, scale) * shape
    return line[:, n // 2 : n // 2 + start]


def synthesise(spectra: np.ndarray, window_types: list[int], n: int, sub_medium: int, sub_short: int, stereo: bool = False) -> np.ndarray:
    """Block-switched synthesis of one channel: rows of n coefficients to n samples each, half a frame late.

    Blocks tile the time line. A block fades in around its start and out around the next one's, over the width that the
    later of the two has; the aliases of the two cancel there. A frame therefore needs the frame before and no other.
    ValueError if a slope is wider than one of the blocks that it joins.
    """
    return _lines(np.asarray(spectra)[:, None, :], window_types, n, sub_medium, sub_short, stereo)[0]


def synthesised(spectra: DataFrame, n: int, sub_medium: int, sub_short: int, channels: int = 1) -> DataFrame:
    """(sig, frame, x array of channels * n): the samples of frames (sig, frame, window_type, x array of channels * n
    coefficients, mid before side), left before right.

    Each frame is put beside the one before it, and frames of the same two window types are made together. x is null for a
    null or unknown window type, an x of another length, and a slope wider than a block that it joins; a frame after one
    that is left out of spectra joins the last one there is.
    """
    beside = previous(spectra.select("sig", "frame", "window_type", "x"), ["sig"], "frame", ["window_type", "x"])
    beside = beside.select("sig", "frame", "window_type", "x", F.col("before.window_type").alias("type_before"), F.col("before.x").alias("x_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array([[-1 if t is None else t for t in batch.column(c).to_pylist()] for c in ("type_before", "window_type")])
            lists = batch.column("x_before"), batch.column("x")
            fits = [np.array(pc.fill_null(pc.equal(pc.list_value_length(x), channels * n), False)) for x in lists]
            first = np.array(batch.column("x_before").is_null())
            out: list[np.ndarray | None] = [None] * len(batch)
            for a, b in {(-1 if alone else int(a), int(b)) for a, b, alone in zip(*kinds, first, strict=True)}:
                if not 0 <= b < len(SLOPE_CLASS) or a >= len(SLOPE_CLASS):
                    continue
                at = np.flatnonzero(fits[1] & (kinds[1] == b) & (first if a < 0 else fits[0] & (kinds[0] == a)))
                if not len(at):
                    continue
                cut = lambda x: x.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)  # noqa: B023, E731
                rows = [cut(lists[1])] if a < 0 else [cut(lists[0]), cut(lists[1])]
                try:
                    made = _lines(np.stack(rows), [b] if a < 0 else [a, b], n, sub_medium, sub_short, channels == 2)[:, -n:]
                except ValueError:
                    continue
                made = made.reshape(len(at), channels, n)
                if channels == 2:
                    made = np.stack([made[:, 0] + made[:, 1], made[:, 0] - made[:, 1]], 1)
                for k, row in zip(at, made.reshape(len(at), -1), strict=True):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("frame"), pa.array(out, pa.list_(pa.float64()))], names=["sig", "frame", "x"])

    kind = spectra.schema["sig"].dataType.simpleString()
    return beside.mapInArrow(run, f"sig {kind}, frame long, x array<double>")


def channel_samples(hops: DataFrame, n: int, channels: int, first: int | None = None) -> DataFrame:
    """(sig, ch, i, x) of hops of channels * n samples, numbered by the frames that there are, or from the frame first on."""
    numbered = ranked(hops, ["sig"], "frame", "hop") if first is None else hops.where(F.col("frame") >= first).withColumn("hop", F.col("frame") - first)
    rows = numbered.select("sig", "hop", F.posexplode("x").alias("p", "x"))
    div = F.call_function("div", F.col("p"), F.lit(n)).cast("int")
    return rows.select("sig", div.alias("ch"), (F.col("hop") * n + F.col("p") % n).alias("i"), "x").where(F.col("ch") < channels)
