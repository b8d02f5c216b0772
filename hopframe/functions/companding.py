"""Logarithmic companding, uniform quantizers and PCM conversion as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest frame gain and sub-block gain, their bits, and the companding parameters.
GAIN_MAX, GAIN_BITS, SUBGAIN_MAX, SUBGAIN_BITS, MU = 13_000.0, 8, 4_500.0, 5, 100.0


def mulaw(x: Column, clip: float, mu: float) -> Column:
    """clip * sign(x) * ln(1 + mu |x| / clip) / ln(1 + mu), x clipped to +-clip."""
    y = F.least(F.abs(x) / clip, F.lit(1.0))
    return F.signum(x) * clip * F.ln(1.0 + mu * y) / math.log(1 + mu)


def mulaw_inverse(y: Column, clip: float, mu: float) -> Column:
    z = F.least(F.abs(y) / clip, F.lit(1.0))
    return F.when(y < 0, -1.0).otherwise(1.0) * clip * (F.exp(math.log(1 + mu) * z) - 1.0) / mu


def quantize_mu(x: Column, clip: float, mu: float, bits: int) -> Column:
    """Index of the companded value's step, held within the bits; it stands for index + 1/2 steps."""
    top = 2**bits - 1
    return F.least(F.greatest(F.floor(mulaw(x, clip, mu) / (clip / top)), F.lit(0)), F.lit(top)).cast("int")


def dequantize_mu(index: Column, clip: float, mu: float, bits: int) -> Column:
    step = clip / (2**bits - 1)
    return mulaw_inverse((index + 0.5) * step, clip, mu)


def gain_of(index: np.ndarray) -> np.ndarray:
    """frame_gain() in numpy."""
    z = np.minimum((index + 0.5) / (2**GAIN_BITS - 1), 1.0)
    return GAIN_MAX * np.expm1(math.log1p(MU) * z) / MU / 2.0**13


def quantized_gain(value: np.ndarray) -> np.ndarray:
    """Index of the gain nearest from below to values of 1e-8 and more."""
    z = np.log1p(MU * np.minimum(np.maximum(value, 1e-8) * 2.0**13 / GAIN_MAX, 1.0)) / math.log1p(MU)
    top = 2**GAIN_BITS - 1
    return np.clip(np.floor(z * top), 0, top).astype(int)


def frame_gain(gain: Column) -> Column:
    """Gain of a frame that is one block."""
    return dequantize_mu(gain, GAIN_MAX, MU, GAIN_BITS) / 2.0**13


def block_gain(gain: Column, sub_gain: Column) -> Column:
    """Gain of one of a frame's several blocks."""
    return dequantize_mu(gain, GAIN_MAX, MU, GAIN_BITS) * dequantize_mu(sub_gain, SUBGAIN_MAX, MU, SUBGAIN_BITS) / 2.0**23


def to_pcm16(x: Column) -> Column:
    """Nearest 16-bit sample, ties to even, of x clipped to +-1."""
    return F.rint(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 32767.0).cast("int")


def from_pcm16(v: Column) -> Column:
    return v / 32768.0


def rounded_div(a: Column, b: Column | int) -> Column:
    """(a + b div 2) div b; null for a divisor of 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a + F.call_function("div", b, F.lit(2)), F.nullif(b, F.lit(0)))


def log2_int(v: Column) -> Column:
    """Largest n with 2**n <= v; null below 1."""
    return F.when(v > 0, F.length(F.bin(v)) - 1).cast("int")
