"""Whole conversions: WAV files to files of records, and back; a file that cannot be converted is a row with its error.

`python -m hopframe.plans.convert encode|decode ... --books TABLE` runs them; the codebooks are the caller's.
"""

from __future__ import annotations

import argparse
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec, framing, transform
from ..sources import container, wav
from . import modes

Books = Callable[[codec.Layout], dict[str, np.ndarray]]
#: The options that carry tags.
TAG_OPTIONS = ("title", "artist", "album", "year", "track", "genre", "comment")
_DONE = "file string, path string, n_bytes long, error string"


def encode_files(spark: SparkSession, paths: str, folder: str, books: Books, kbps: int = 0, tags: dict[str, str] | None = None, lead: bool = True) -> DataFrame:
    """(file, path, n_bytes, error) of the WAV files at paths, written to folder under their names with .rec for .wav.

    Each file takes the mode nearest to kbps in all (0: the usual one) for its rate and channels; another rate is
    resampled. Files of over two channels are errors. Modes are few, so that the files of each are one plan.
    """
    samples = wav.read(spark, paths).withColumnRenamed("path", "sig")
    infos = samples.groupBy("sig").agg(F.max("rate").alias("rate"), (F.max("ch") + 1).alias("channels"), F.max("error").alias("error"))
    error = F.coalesce("error", F.when(F.col("channels") > 2, F.lit("channels")), F.when(F.col("channels").isNull(), F.lit("no samples")))
    asked = modes.nearest_modes(infos.withColumn("error", error).withColumn("kbps", F.lit(kbps))).withColumn("class", modes.rate_class(F.col("rate")))
    good, parts = asked.where("error is null"), []
    failed = infos.withColumn("error", error).where("error is not null").select(F.col("sig").alias("file"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("n_bytes"), "error")
    for r in good.select("class", "out_kbps", "channels", "rate", "out_rate").distinct().collect():  # rates and modes, not files
        layout = codec.Layout(r["class"], r["out_kbps"] // r["channels"], r["channels"])
        own = good.where((F.col("out_kbps") == r["out_kbps"]) & (F.col("channels") == r["channels"]) & (F.col("rate") == r["rate"])).select("sig")
        signal = samples.join(own, "sig", "left_semi").select("sig", "ch", "i", "x")
        if r["rate"] != r["out_rate"]:
            both = signal.withColumn("sig", F.struct("sig", "ch"))
            down = math.gcd(r["rate"], r["out_rate"])
            signal = framing.resample_linear(both, r["out_rate"] // down, r["rate"] // down).select("sig.sig", "sig.ch", "i", "x")
        coder = codec.Codec(layout, books(layout))
        records = codec.pack_frames(codec.encode_frames(codec.signal_blocks(signal, layout, lead), coder), layout)
        data = codec.joined_records(records, layout).withColumnRenamed("sig", "file")
        told = F.create_map(*[F.lit(x) for kv in (tags or {}).items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
        chunks = container.info_chunks(data.select("file", F.lit(r["channels"]).alias("channels"), F.lit(r["out_kbps"]).alias("kbps"), F.lit(r["out_rate"]).alias("rate"), F.octet_length("data").alias("data_size"), told.alias("tags")))
        files = container.build(chunks, data).withColumn("name", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?i)\.wav$", ".rec"))
        written = container.write(files.select("name", "content"), folder, "name")
        parts.append(written.select(F.col("name").alias("file"), "path", "n_bytes", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts, failed)


def decode_files(spark: SparkSession, paths: str, folder: str, books: Books) -> DataFrame:
    """(file, path, n, error) of the files of records at paths, written to folder as 16-bit WAV files; n samples a
    channel. The files of each mode are one plan."""
    parsed = container.parse(container.read(spark, paths), keep=("file", "content"))
    headers = modes.exact_modes(container.header_fields(parsed, keep=("file", "content", "data_offset")))
    headers = headers.withColumn("class", modes.rate_class(F.col("rate"), exact=True))
    parts = [headers.where("error is not null").select("file", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("n"), "error")]
    for r in headers.where("error is null").select("class", "kbps_ch", "channels", "rate").distinct().collect():
        layout = codec.Layout(r["class"], r["kbps_ch"], int(r["channels"]))
        own = headers.where(F.col("error").isNull() & (F.col("class") == r["class"]) & (F.col("kbps_ch") == r["kbps_ch"]) & (F.col("channels") == r["channels"]))
        frames = codec.parse_frames(container.packets(own).withColumnRenamed("file", "sig"), layout)
        coder = codec.Codec(layout, books(layout))
        subs = layout.form["medium"][0], layout.form["short"][0]
        hops = transform.synthesised(codec.decode_frames(frames, coder), layout.n, *subs, layout.channels)
        out = wav.write16(framing.valid_after_priming(hops, F.col("x").isNotNull()), folder, r["rate"], layout.channels)
        parts.append(out.select(F.col("sig").alias("file"), F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("path"), "n", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts)


def parser() -> argparse.ArgumentParser:
    """Options of the two conversions; an unknown one is an error."""
    out = argparse.ArgumentParser(prog="hopframe.plans.convert", allow_abbrev=False)
    kinds = out.add_subparsers(dest="kind", required=True)
    for kind in ("encode", "decode"):
        p = kinds.add_parser(kind, allow_abbrev=False)
        p.add_argument("paths")
        p.add_argument("folder")
        p.add_argument("--books", required=True, help="a Parquet table of codebooks: rate_class, kbps_ch, channels, name, code, dim, value")
        if kind == "encode":
            p.add_argument("-b", "--bitrate", type=int, default=0, help="kbit/s in all; the nearest mode's is taken")
            p.add_argument("--no-delay", action="store_true", help="no silent hop before the signal")
            for tag in TAG_OPTIONS:
                p.add_argument(f"--{tag}", default="")
    return out


def main(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """Run a conversion as its arguments say."""
    a = parser().parse_args(arguments)

    def books(layout: codec.Layout) -> dict[str, np.ndarray]:
        own = spark.read.parquet(a.books).where(f"rate_class = {layout.rate_class} and kbps_ch = {layout.mode[1]} and channels = {layout.channels}")
        return codec.load_books(own.select("name", "code", "dim", "value"))

    if a.kind == "decode":
        return decode_files(spark, a.paths, a.folder, books)
    return encode_files(spark, a.paths, a.folder, books, a.bitrate, {t: v for t in TAG_OPTIONS if (v := getattr(a, t))}, not a.no_delay)


if __name__ == "__main__":
    import sys

    main(SparkSession.builder.getOrCreate(), sys.argv[1:]).show(1000, truncate=False)
