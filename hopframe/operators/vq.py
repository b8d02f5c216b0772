"""Vector quantization against codebooks that are input tables (code, v array), bounded and shipped to the workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import companding

#: Values that a codebook may hold: it is shipped to every worker.
MOST_VALUES = 4_000_000


def load_codebook(table: DataFrame, code: str = "code", vector: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """(codes ascending, matrix). ValueError beyond MOST_VALUES values, without rows, or with rows of several lengths; that is
    asked before any row comes to the driver."""
    rows = table.select(F.col(code).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or least is None or least != most or n * most > MOST_VALUES:
        raise ValueError("a codebook has rows of one length, and not too many")
    found = sorted(rows.collect(), key=lambda r: r["c"])
    return np.array([r["c"] for r in found]), np.array([r["v"] for r in found])


#: Differences that are held at once.
_HELD = 1 << 22


def errors(x: np.ndarray, book: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Squared errors of each row against each code, weighted by place; by blocks of codes."""
    step = max(1, _HELD // max(1, x.size))
    out = np.empty((len(x), len(book)))
    for lo in range(0, len(book), step):
        d = (x[:, None, :] - book[None, lo : lo + step]) ** 2
        out[:, lo : lo + step] = d.sum(2) if weight is None else (d * weight[:, None, :]).sum(2)
    return out


def closest(x: np.ndarray, book: np.ndarray, weight: np.ndarray | None = None, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(indices, errors) of the k codes with the smallest errors() of each row, ties to the smaller index.

    Matrix products find the codes that may be among them, up to rounding; those alone are measured by their differences.
    """
    k = min(k, len(book))
    w = np.ones_like(x) if weight is None else weight
    wx, squares = w * x, book * book
    own, codes = (wx * x).sum(1)[:, None], w @ squares.T
    near = own - 2 * (wx @ book.T) + codes
    cut = np.partition(near, k - 1, axis=1)[:, k - 1 : k] + 1e-10 * (own + codes.max(1, keepdims=True))
    m = int((near <= cut).sum(1).max()) if len(x) else k
    at = np.sort(np.argpartition(near, m - 1, axis=1)[:, :m], axis=1)
    err = np.empty(at.shape)
    step = max(1, _HELD // max(1, m * x.shape[1]))
    for lo in range(0, len(x), step):
        hi = lo + step
        err[lo:hi] = ((x[lo:hi, None, :] - book[at[lo:hi]]) ** 2 * w[lo:hi, None, :]).sum(2)
    order = np.argsort(err, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(at, order, 1), np.take_along_axis(err, order, 1)


def _mapped(df: DataFrame, vector: str, keep: list[str], schema: str, kernel, codes: int = 1) -> DataFrame:
    """keep columns and what kernel makes of each part of a batch: (rows of the part, columns). A part's vectors have one
    length, and with codes to compare with they are few enough to hold all errors."""
    src = df.select(*keep, F.col(vector).cast("array<double>").alias("__v"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    most = max(1, min(256, _HELD // max(1, codes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), most):
                part = batch.slice(lo, most)
                x = part.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                rows, columns = kernel(x)
                kept = [part.column(c).take(pa.array(rows)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c) for c in columns.values()]], names=[*keep, *columns])

    return src.mapInArrow(run, f"{types}, {schema}")


def nearest(df: DataFrame, book: tuple[np.ndarray, np.ndarray], keep: list[str], vector: str = "v", k: int = 1) -> DataFrame:
    """keep, slot (from 0), code, err: the k codes of the smallest squared error, ties to the smaller code."""
    codes, matrix = book

    def kernel(x: np.ndarray) -> tuple[np.ndarray, dict]:
        best, err = closest(x, matrix, k=k)
        n = best.shape[1]
        return np.repeat(np.arange(len(x)), n), {"slot": np.tile(np.arange(n, dtype=np.int32), len(x)), "code": codes[best.reshape(-1)], "err": err.reshape(-1)}

    return _mapped(df, vector, keep, "slot int, code long, err double", kernel, len(codes))


def two_stage(x: np.ndarray, first: np.ndarray, second: np.ndarray, weight: np.ndarray, beam: int = 4, passes: int = 2, signed: tuple[bool, bool] = (True, True)) -> dict[str, np.ndarray]:
    """Signed codes (i, s, j, t) with the small weighted error of x - s first[i] - t second[j].

    The beam best (i, s) each try every (j, t); then each stage is searched again with the other held. Earlier choices
    win ties, in the order of slot, code, sign + before -.
    """
    signs = [(1.0, -1.0) if x else (1.0,) for x in signed]
    both = lambda book, own: np.stack([s * book for s in own], 1).reshape(-1, book.shape[1])
    one, two = both(first, signs[0]), both(second, signs[1])
    w = weight / np.maximum(weight.max(1, keepdims=True), 1e-30)
    slots, _ = closest(x, one, w, beam)
    n = len(x)
    best = np.full(n, np.inf)
    a, b = np.zeros(n, int), np.zeros(n, int)
    for slot in range(slots.shape[1]):
        at, low = (r[:, 0] for r in closest(x - one[slots[:, slot]], two, w))
        better = low < best
        best, a, b = np.where(better, low, best), np.where(better, slots[:, slot], a), np.where(better, at, b)
    for _ in range(passes):
        for stage in (0, 1):
            at, low = (r[:, 0] for r in closest(x - (one[a] if stage else two[b]), two if stage else one, w))
            better = low < best
            best = np.where(better, low, best)
            if stage:
                b = np.where(better, at, b)
            else:
                a = np.where(better, at, a)
    m, k = len(signs[0]), len(signs[1])
    return {"code0": a // m, "sign0": np.array(signs[0], np.int32)[a % m], "code1": b // k, "sign1": np.array(signs[1], np.int32)[b % k], "err": best}


def quantize_two_stage(df: DataFrame, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], keep: list[str], vector: str = "v", weight=None, passes: int = 2) -> DataFrame:
    """keep, code0, sign0, code1, sign1, err; weight is a function from the matrix to its weights, 1 by default."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray, dict]:
        out = two_stage(x, first[1], second[1], np.ones_like(x) if weight is None else weight(x), passes=passes)
        return np.arange(len(x)), out | {"code0": first[0][out["code0"]], "code1": second[0][out["code1"]]}

    return _mapped(df, vector, keep, "code0 long, sign0 int, code1 long, sign1 int, err double", kernel, 2 * max(len(first[0]), len(second[0])))


def split_ends(order: int, split: int) -> list[int]:
    """Ends of the segments of an order-long vector: ((s + 1) order + f[s]) div split, f = (-2, c, c, 0)."""
    c = -2 if split == 4 else 1
    return [int(((s + 1) * order + (-2, c, c, 0)[s]) / split) if s < split - 1 else order for s in range(split)]


def split_codes(df: DataFrame, book: tuple[np.ndarray, np.ndarray], ends: list[int], keep: list[str], vector: str = "v") -> DataFrame:
    """keep, segment, code, err: the nearest code of each segment of the vector."""
    codes, matrix = book

    def kernel(x: np.ndarray) -> tuple[np.ndarray, dict]:
        at, err = [], []
        for lo, hi in zip([0, *ends], ends, strict=False):
            best, low = closest(x[:, lo:hi], matrix[:, lo:hi])
            at.append(best[:, 0])
            err.append(low[:, 0])
        m = len(ends)
        return np.repeat(np.arange(len(x)), m), {"segment": np.tile(np.arange(m, dtype=np.int32), len(x)), "code": codes[np.stack(at, 1).reshape(-1)], "err": np.stack(err, 1).reshape(-1)}

    return _mapped(df, vector, keep, "segment int, code long, err double", kernel, len(codes))


def residual_codes(df: DataFrame, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], ends: list[int], keep: list[str], vector: str = "v") -> DataFrame:
    """keep, code, second array<long>: the nearest code of the first book, and for each segment of what it leaves the nearest
    code of the second book's segment."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray, dict]:
        at = closest(x, first[1])[0][:, 0]
        rest = x - first[1][at]
        parts = [second[0][closest(rest[:, lo:hi], second[1][:, lo:hi])[0][:, 0]] for lo, hi in zip([0, *ends], ends, strict=False)]
        return np.arange(len(x)), {"code": first[0][at], "second": list(np.stack(parts, 1))}

    return _mapped(df, vector, keep, "code long, second array<long>", kernel, max(len(first[0]), len(second[0])))


def gain_and_bands(x: np.ndarray, widths: np.ndarray, coefs: int, book: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(gain indices, codes of each row's coefs vectors): a row's gain by its root mean square against level, and the band
    envelope over that gain, whose bands j, j + coefs and so on are the vector j, searched in book."""
    starts = np.cumsum(widths) - widths
    gain = companding.quantized_gain(np.sqrt((x**2).mean(1)) / level)
    energy = np.add.reduceat(x**2, starts, axis=1) / widths
    target = np.sqrt(energy) / (companding.gain_of(gain)[:, None] * level) - 1
    vectors = target.reshape(len(x), -1, coefs).transpose(0, 2, 1).reshape(len(x) * coefs, -1)
    return gain, closest(vectors, book)[0][:, 0].reshape(len(x), coefs)


def quantize_gain_bands(df: DataFrame, widths: list[int], coefs: int, book: tuple[np.ndarray, np.ndarray], level: float, keep: list[str], vector: str = "v") -> DataFrame:
    """keep, gain, codes array<long>: gain_and_bands() of each vector, of sum(widths) values."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray, dict]:
        gain, codes = gain_and_bands(x, np.array(widths), coefs, book[1], level)
        return np.arange(len(x)), {"gain": gain.astype(np.int32), "codes": list(book[0][codes])}

    return _mapped(df, vector, keep, "gain int, codes array<long>", kernel, coefs * len(book[0]))


def residual(x: Column, band: Column) -> Column:
    """What is left to quantize of an array of values under its band values: the quotient, the value where a band is next to
    nothing."""
    return F.zip_with(x, band, lambda a, b: F.when(F.abs(b) > 1e-8, a / b).otherwise(a))


def place_weights(envelope: Column, band: Column) -> Column:
    """Weight of each place in the search: the square of envelope times band value."""
    return F.zip_with(envelope, band, lambda a, b: a * b * a * b)


def gain_fit(x: Column, y: Column, weight: Column | None = None) -> Column:
    """Least-squares factor of y towards x, both arrays, weighted by place (by 1 by default), at least 0; 1 where y is next
    to nothing."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, a: s + a)
    times = lambda a, b: F.zip_with(a, b, lambda p, q: p * q)
    weighed = y if weight is None else times(weight, y)
    yy = total(times(weighed, y))
    return F.when(yy <= 1e-20, 1.0).otherwise(F.greatest(F.lit(0.0), total(times(weighed, x)) / yy))


def expand_bands(values: Column, widths: list[int]) -> Column:
    """Each band's value as often as the band is wide."""
    return F.flatten(F.transform(F.arrays_zip(values.alias("v"), F.array(*[F.lit(w) for w in widths]).alias("w")), lambda b: F.array_repeat(b["v"], b["w"])))


def band_value(now: Column, before: Column | None = None, share: float = 0.0) -> Column:
    """Envelope value of a band: 1 + code value, blended with the frame before; below -1 it is 1."""
    st = now + 1.0 if before is None else (1.0 - share) * now + share * before + 1.0
    return F.when(st < -1.0, 1.0).otherwise(st)
