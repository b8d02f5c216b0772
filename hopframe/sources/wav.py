"""WAV files: a scan to rows of samples, and a 16-bit writer."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: codes of integer PCM, float and extensible, and the extensible sub-format's last 14 bytes.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")
_ROWS = 65_536


def _chunks(data: bytes, strict: bool) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if strict and at + 8 + size > len(data):
            raise ValueError(f"the {name.decode('latin-1')} chunk is cut short")
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def decode(data: bytes, strict: bool = True) -> tuple[int, np.ndarray]:
    """(sample rate, frames x channels in [-1, 1)) of 16, 24 or 32-bit PCM or 32-bit float, plain or extensible.

    The last format and data chunks count. Strict reading refuses truncated chunks, unknown sub-formats, a block size that
    does not fit, and samples that are not finite.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    found = dict(_chunks(data, strict))
    form, body = found.get(b"fmt "), found.get(b"data")
    if form is None or len(form) < 16 or body is None:
        raise ValueError("no format or no data")
    code, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", form)
    if code == EXTENSIBLE:
        if len(form) < 40 or strict and form[26:40] != GUID_TAIL:
            raise ValueError("unknown extensible format")
        code = struct.unpack_from("<H", form, 24)[0]
    width = bits // 8
    if (code, bits) not in ((PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32)) or channels < 1:
        raise ValueError(f"format {code} with {bits} bits")
    if strict and block != channels * width:
        raise ValueError("the block size does not fit the channels")
    body = body[: len(body) // (channels * width) * channels * width]
    if code == FLOAT:
        x = np.frombuffer(body, "<f4").astype(float)
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 8_388_608.0
    else:
        x = np.frombuffer(body, f"<i{width}") / float(1 << bits - 1)
    if strict and not np.isfinite(x).all():
        raise ValueError("samples that are not finite")
    return rate, x.reshape(-1, channels)


def header16(rate: int, channels: int, frames: int) -> bytes:
    """Header of a 16-bit file of so many frames."""
    size = frames * channels * 2
    if size > 0xFFFFFFFF - 36:
        raise ValueError("too long for a WAV file")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", size + 36, b"WAVE", b"fmt ", 16, PCM, channels, rate, rate * channels * 2, channels * 2, 16, b"data", size)


def encode16(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit file of frames x channels; clipped to +-1, times 32767, nearest, ties to even."""
    pcm = np.rint(np.clip(x, -1, 1) * 32767).astype("<i2")
    return header16(rate, x.shape[1], len(x)) + pcm.tobytes()


def scan(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, rate, ch, i, x, error) of rows (path, content): a row for each sample; a file that cannot be read gives one
    row with its error alone."""
    schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("ch", pa.int32()), ("i", pa.int64()), ("x", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rate, x = decode(content.as_py() or b"", strict)
                except (ValueError, struct.error) as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], schema=schema)
                    continue
                for lo in range(0, len(x), _ROWS):
                    part = x[lo : lo + _ROWS]
                    n, m = part.shape
                    yield pa.RecordBatch.from_arrays([pa.array([path] * (n * m)), pa.array(np.full(n * m, rate, np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(np.repeat(np.arange(lo, lo + n), m)), pa.array(part.reshape(-1)), pa.nulls(n * m, pa.string())], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, rate int, ch int, i long, x double, error string")


def read(spark: SparkSession, paths: str, strict: bool = True) -> DataFrame:
    """scan() of files that Spark finds at paths."""
    return scan(spark.read.format("binaryFile").load(paths), strict)


def write16(hops: DataFrame, folder: str, rate: int, channels: int = 1) -> DataFrame:
    """Write signals (sig, frame, x array of channels after each other) as 16-bit files to folder, a URI that all executors
    reach; returns (sig, file, n), n samples a channel. Each task streams its signals hop by hop; a repeated task writes
    files of other names. ValueError for a file of over 4 GB."""
    from pyarrow import fs

    total = hops.groupBy(F.col("sig").alias("s")).agg(F.sum(F.call_function("div", F.size("x"), F.lit(channels))).alias("n"))
    rows = hops.join(total, F.col("sig") == F.col("s")).select("sig", "n", "frame", "x").repartition("sig").sortWithinPartitions("sig", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(base, recursive=True)
        now, out, done = None, None, []
        for batch in batches:
            for sig, n, x in zip(batch.column("sig").to_pylist(), batch.column("n").to_pylist(), batch.column("x"), strict=True):
                if out is None or sig != now:
                    if out is not None:
                        out.close()
                    now, name = sig, f"{uuid.uuid4().hex}.wav"
                    out = files.open_output_stream(f"{base}/{name}")
                    out.write(header16(rate, channels, n))
                    done.append({"sig": sig, "file": name, "n": n})
                samples = x.values.to_numpy(zero_copy_only=False).reshape(channels, -1).T
                out.write(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("sig", pa.string()), ("file", pa.string()), ("n", pa.int64())]))

    return rows.mapInArrow(run, "sig string, file string, n long")
