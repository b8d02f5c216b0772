"""Linear prediction over frames: autocorrelation, recursion, line spectral frequencies and envelopes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transform import apply_arrays, window


def autocorrelation(x: np.ndarray, order: int) -> np.ndarray:
    """Rows of samples to rows of lags 0..order; lag 0 grows by 1e-4 of itself and is 1e-8 at least."""
    n = x.shape[1]
    r = np.stack([(x[:, : n - k] * x[:, k:]).sum(1) for k in range(order + 1)], 1)
    r[:, 0] = np.maximum(r[:, 0] * 1.0001, 1e-8)
    return r


def levinson(r: np.ndarray) -> np.ndarray:
    """Rows of lags to rows of prediction coefficients, 1 first; reflections stay within +-0.999."""
    rows, order = r.shape[0], r.shape[1] - 1
    a = np.zeros((rows, order + 1))
    a[:, 0] = 1
    err = r[:, 0].copy()
    for i in range(1, order + 1):
        acc = r[:, i] + (a[:, 1:i] * r[:, i - 1 : 0 : -1]).sum(1)
        k = np.clip(np.where(err > 1e-12, -acc / err, 0.0), -0.999, 0.999)
        a[:, 1:i] = a[:, 1:i] + k[:, None] * a[:, i - 1 : 0 : -1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-12)
    return a


def _chebyshev_roots(series: np.ndarray) -> np.ndarray:
    """Roots of rows of Chebyshev series (low terms first), as eigenvalues of their companion matrices."""
    rows, n = series.shape[0], series.shape[1] - 1
    if n == 1:
        return -series[:, :1] / series[:, 1:]
    matrix = np.zeros((rows, n, n))
    at = np.arange(n - 1)
    matrix[:, at, at + 1] = matrix[:, at + 1, at] = 0.5
    matrix[:, 0, 1] = matrix[:, 1, 0] = 0.5**0.5
    # the first row and column are scaled so that the matrix is symmetric but for its last column
    scale = np.full(n, 0.5)
    scale[0] = 0.5**0.5
    matrix[:, :, -1] -= series[:, :-1] / series[:, -1:] * scale[None]
    return np.linalg.eigvals(matrix)


def line_spectra_of(a: np.ndarray) -> np.ndarray:
    """Line spectral frequencies in (0, pi) of rows of coefficients of even order, ascending.

    They are the angles of the roots of the sum and the difference of the polynomial and its mirror image, without their
    fixed roots at +-1; as series in cos w those are Chebyshev series, whose roots are eigenvalues. Where not all are
    real and within (-1, 1) the frequencies are spread evenly.
    """
    rows, order = a.shape[0], a.shape[1] - 1
    none = np.zeros((rows, 1))
    straight, mirrored = np.hstack([a, none]), np.hstack([none, a[:, ::-1]])
    found, real = [], np.ones(rows, bool)
    for poly, fixed in ((straight + mirrored, -1.0), (straight - mirrored, 1.0)):
        rest = np.zeros((rows, order + 1))  # divided by x - fixed
        rest[:, 0] = poly[:, 0]
        for k in range(1, order + 1):
            rest[:, k] = poly[:, k] + fixed * rest[:, k - 1]
        middle = order // 2
        x = _chebyshev_roots(np.hstack([rest[:, middle : middle + 1], 2 * rest[:, middle + 1 :]]))
        real &= ((np.abs(np.imag(x)) < 1e-9) & (np.abs(np.real(x)) < 1)).all(1)
        found.append(np.arccos(np.clip(np.real(x), -1, 1)))
    even = np.pi * np.arange(1, order + 1) / (order + 1)
    angles = np.where(real[:, None], np.sort(np.hstack(found), 1), even)
    return np.sort(spread(angles.T, 0.001).T, 1)


def line_spectrum(a: np.ndarray) -> np.ndarray:
    """line_spectra_of() one row."""
    return line_spectra_of(np.asarray(a, float)[None])[0]


def spread(lsp: np.ndarray, least: float) -> np.ndarray:
    """One pass from below over the first axis: neighbours nearer than least move to least apart around their mean."""
    out = lsp.astype(float).copy()
    for i in range(1, len(out)):
        near = out[i] - out[i - 1] < least
        mean = (out[i] + out[i - 1]) / 2
        out[i - 1], out[i] = np.where(near, mean - least / 2, out[i - 1]), np.where(near, mean + least / 2, out[i])
    return out


def spread_column(lsp: Column, least: float) -> Column:
    """spread() of an array column."""
    start = F.struct(F.slice(lsp, 1, 0).alias("done"), F.lit(None).cast("double").alias("last"))

    def step(state: Column, x: Column) -> Column:
        last, mean = state["last"], (state["last"] + x) / 2
        near = x - last < least
        done = F.when(last.isNull(), state["done"]).when(near, F.concat(state["done"], F.array(mean - least / 2))).otherwise(F.concat(state["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(near, mean + least / 2).otherwise(x).alias("last"))

    return F.aggregate(lsp, start, step, lambda s: F.concat(s["done"], F.array(s["last"])))


def blended(now: Column, before: Column, share: float) -> Column:
    """Frequencies blended with those before (0 where there are none), spread twice and sorted."""
    old = F.coalesce(before, F.transform(now, lambda x: x * 0.0))
    mixed = F.zip_with(now, old, lambda a, b: a * (1 - share) + b * share)
    return F.array_sort(spread_column(spread_column(mixed, 1e-4), 9.5e-5))


def envelope_at(doubled_cosines: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Spectral envelope 1/2 / (p^2 (2 - 2c) + q^2 (2 + 2c)); p and q are half the products over odd and even places."""
    c = 2 * np.asarray(cosine)[..., None]
    q = 0.5 * np.prod(doubled_cosines[0::2] - c, axis=-1)
    p = 0.5 * np.prod(doubled_cosines[1::2] - c, axis=-1)
    return 0.5 / (p * p * (2 - c[..., 0]) + q * q * (2 + c[..., 0]))


def envelope_column(lsp: Column, cosine: Column) -> Column:
    """envelope_at() of an array column of line spectral frequencies."""
    product = lambda first: F.aggregate(F.sequence(F.lit(first), F.size(lsp) - 1, F.lit(2)), F.lit(0.5), lambda acc, j: acc * (2 * F.cos(lsp[j]) - 2 * cosine))
    q, p = product(0), product(1)
    return 0.5 / (p * p * (2 - 2 * cosine) + q * q * (2 + 2 * cosine))


def envelope(lsp: np.ndarray, n: int, low_step: int = 8, high_step: int = 16) -> np.ndarray:
    """Envelope of n bins by knots and straight lines: a knot every low_step bins of the lower half and high_step of the
    upper, and one more in the middle of two where the curve falls and is concave; the last value is held.
    """
    half = n // 2
    doubled = 2 * np.cos(lsp)
    value = lambda bins: envelope_at(doubled, np.cos((2 * bins + 1) * (np.pi / (2 * n))))
    knots = []
    for start, step in ((0, low_step), (half, high_step)):
        nodes = np.arange(start, start + half, step)
        v = value(nodes)
        before, here, after = v[:-2], v[1:-1], v[2:]
        bent = ~((after + before > 1.95 * here) | (after >= before))
        knots += [nodes, nodes[1:-1][bent] - step // 2]
    at = np.sort(np.concatenate(knots))
    return np.interp(np.arange(n), at, value(at))


def lags(hops: DataFrame, n: int, order: int) -> DataFrame:
    """(sig, frame, x array of lags) of hop arrays."""
    return apply_arrays(hops, "x", n, lambda x: autocorrelation(x, order))


def predictors(lag_rows: DataFrame, order: int) -> DataFrame:
    """(sig, frame, x array of coefficients) of lags."""
    return apply_arrays(lag_rows, "x", order + 1, levinson)


def line_spectra(coefficients: DataFrame, order: int) -> DataFrame:
    """(sig, frame, x array of order frequencies) of coefficients."""
    return apply_arrays(coefficients, "x", order + 1, line_spectra_of)


def analysed(blocks: DataFrame, n: int, order: int) -> DataFrame:
    """(sig, frame, x array of order frequencies) of blocks of 2n samples (see framing.overlapped): sine taper, lags,
    prediction, line spectral frequencies."""
    return apply_arrays(blocks.select("sig", "frame", "x"), "x", 2 * n, lambda x: line_spectra_of(levinson(autocorrelation(x * window(n), order))))
