"""Encoding and decoding of generated audio at full size, for the bench: how fast is a second of sound?"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec
from ..sources.signals import generated


def made_up_books(layout: codec.Layout, seed: int = 0) -> dict[str, np.ndarray]:
    """Random codebooks of the sizes that a layout needs; the format's own are not shipped."""
    rng = np.random.default_rng(seed)
    out = {}
    for kind, (_, lengths, _) in layout.deal.items():
        out |= {f"main{k}_{kind}": np.round(rng.normal(size=(64, max(lengths))) * (6000, 2500)[k]) for k in (0, 1)}
    for kind, (sub, size, coefs, bits, _) in layout.form.items():
        out[f"bark_{kind}"] = np.round(rng.normal(size=(2**bits, size // coefs)) * 1500)
        widths = np.full(size, layout.n // sub // size)
        widths[-1] += layout.n // sub - widths.sum()
        out[f"widths_{kind}"] = widths[None].astype(float)
    even = np.pi * np.arange(1, layout.order + 1) / (layout.order + 1)
    out["lsp0"] = rng.random((2 ** layout.lsp_bits[0], layout.order)) * 0.4
    out["lsp1"] = np.sort(even + rng.normal(size=(2 ** layout.lsp_bits[1], layout.order)) * 0.1, axis=1)
    out["lsp2"] = rng.normal(size=(2 ** layout.lsp_bits[2], layout.order)) * 0.03
    return out


def recording(spark: SparkSession, seconds: float) -> DataFrame:
    """(sig, ch, i, x): two channels of swept tones at 44.1 kHz."""
    n = int(44_100 * seconds)
    left = generated(spark, n, [(0.18, 437.0), (0.06, 1123.0)], sweep=7.0)
    right = generated(spark, n, [(0.18, 653.0), (0.06, 1379.0)], sweep=7.0)
    return left.withColumn("ch", F.lit(0)).unionByName(right.withColumn("ch", F.lit(1)))


def encoded(spark: SparkSession, seconds: float) -> tuple[DataFrame, codec.Codec]:
    """Records (sig, frame, record) of a recording at 96 kbit/s, and the codec."""
    layout = codec.Layout(44, 48, 2)
    own = codec.Codec(layout, made_up_books(layout))
    blocks = codec.signal_blocks(recording(spark, seconds), layout)
    return codec.pack_frames(codec.encode_frames(blocks, own), layout), own


def decoded(records: DataFrame, own: codec.Codec) -> DataFrame:
    """(sig, ch, i, x) of records."""
    return codec.decode_samples(codec.parse_frames(records.withColumn("skip", F.lit(0)), own.layout), own)
