"""Frames as bit records: layouts, packing, and the way from lapped blocks to codes and from codes to spectra.

Codebooks are input tables (name, code, dim, value). Names: main0_F and main1_F for frame type F in short, medium, long and
pitch, bark_F and widths_F for the first three, and lsp0 (history weights), lsp1, lsp2. A frame needs the codes of the
frame before it and of the last one of its type, so frames are put beside those and mapped; no signal is walked through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import BitReader, BitWriter
from ..functions.companding import GAIN_BITS, GAIN_MAX, MU, SUBGAIN_BITS, SUBGAIN_MAX
from ..plans.modes import FRAME_TYPES, MODES, RATES
from . import lpc, transform, vq
from .framing import hop_arrays, previous, ranked

#: Frame type of each window type; shares of the frame before in band envelopes, by frame type; the start
#: value of band history; the level at which codebooks lie; the pitch gain's range and companding.
TYPE_OF_WINDOW = ("long", "long", "short", "long", "medium", "long", "long", "medium", "medium")
BAND_SHARE = {"short": 0.4, "medium": 0.35, "long": 0.28}
BAND_START, LEVEL, PITCH_MAX, PITCH_MU = 0.1, 6000.0, 25_000.0, 200.0


def _expand(y: float, clip: float, mu: float) -> float:
    return clip * math.copysign(math.expm1(math.log1p(mu) * min(abs(y) / clip, 1.0)), y) / mu


def _compress(x: float, clip: float, mu: float, bits: int) -> int:
    top = 2**bits - 1
    y = math.copysign(clip * math.log1p(mu * min(abs(x) / clip, 1.0)) / math.log1p(mu), x)
    return min(max(math.floor(y / (clip / top)), 0), top)


def _rounded(a: int, b: int) -> int:
    return (a + b // 2) // b


class Layout:
    """Bit plan, permutations and field lists of a mode (a row of MODES) for 1 or 2 channels."""

    def __init__(self, rate_class: int, kbps_ch: int, channels: int):
        (self.mode,) = [m for m in MODES if m[:2] == (rate_class, kbps_ch)]
        self.channels, self.rate_class = channels, rate_class
        _, _, self.n, self.order, self.lsp_bits, self.split, self.period_bits, self.shape_bits, self.shape_len, self.pitch_gain_bits, self.peak_width, forms = self.mode
        rate = next(r for k, r, _ in RATES if k == rate_class)
        self.kbps = kbps_ch * channels
        self.frame_bits = self.kbps * 1000 * self.n // rate
        self.form = dict(zip(FRAME_TYPES, forms, strict=False))
        lsp = self.lsp_bits[0] + self.lsp_bits[1] + self.split * self.lsp_bits[2]
        pitch = self.pitch_gain_bits + self.shape_bits + self.period_bits
        self.deal = {}
        for t in FRAME_TYPES:
            if t == "pitch":
                bits, size, blocks = channels * self.shape_bits, channels * self.shape_len, channels
            else:
                sub, _, coefs, width, _ = self.form[t]
                band = coefs * width + 1
                over = channels * (lsp + 8) + 4 + (channels * (band + pitch) if t == "long" else sub * channels * (band + 5))
                bits, size, blocks = self.frame_bits - over, channels * self.n, channels * sub
            count = (bits + 13) // 14
            dealt = lambda total, count=count: [total // count + (i < total - total // count * count) for i in range(count)]
            self.deal[t] = (dealt(bits), dealt(size), blocks)

    @cached_property
    def permutation(self) -> dict[str, np.ndarray]:
        """By frame type: place in the frame of each value of the concatenated vectors."""
        out = {}
        for t, (_, lengths, blocks) in self.deal.items():
            size, count = sum(lengths), len(lengths)
            row, column = np.divmod(np.arange(size), count)
            still = blocks == 1 or (count % blocks != 0 if t == "long" else count % 2 == 1)
            turn = np.where(still | (row == size // count), 0, row if t == "long" else row * row)
            number = row * count + (column + turn) % count
            number = number[np.lexsort((row, column))]
            out[t] = size // blocks * (number % blocks) + number // blocks
        return out

    def fields(self, kind: str) -> list[tuple[str, int]]:
        """(name, bits) of a frame's fields after the window type, in order; a name stands once for each of its values."""
        sub, _, coefs, width, _ = self.form[kind]
        vectors = lambda t, name: [(name, b) for bits in self.deal[t][0] for b in (bits - bits // 2, bits // 2)]
        out = vectors(kind, "main") + [("bark", width)] * (self.channels * sub * coefs) + [("history", 1)] * (self.channels * sub)
        for _ in range(self.channels):
            out.append(("gain", GAIN_BITS))
            if kind != "long":
                out += [("sub_gain", SUBGAIN_BITS)] * sub
        for _ in range(self.channels):
            out += [("lsp0", self.lsp_bits[0]), ("lsp1", self.lsp_bits[1]), *[("lsp2", self.lsp_bits[2])] * self.split]
        if kind == "long":
            out += vectors("pitch", "pitch")
            for _ in range(self.channels):
                out += [("period", self.period_bits), ("pitch_gain", self.pitch_gain_bits)]
        return out

    def pack(self, codes: list[int]) -> bytes:
        """The record of a frame, codes being the window type and its fields; zero bits up to frame_bits."""
        w = BitWriter()
        w.put(codes[0], 4)
        for value, (_, bits) in zip(codes[1:], self.fields(TYPE_OF_WINDOW[codes[0]]), strict=True):
            w.put(value, bits)
        if w.bits > self.frame_bits:
            raise ValueError("the fields do not fit the frame")
        w.put(0, self.frame_bits - w.bits)
        return w.bytes()

    def parse(self, data: bytes, skip: int = 0) -> list[int] | None:
        """pack() undone, from the bit skip on; null for a window type that does not exist."""
        r = BitReader(data)
        r.get(skip)
        kind = r.get(4)
        if kind >= len(TYPE_OF_WINDOW):
            return None
        return [kind, *(r.get(bits) for _, bits in self.fields(TYPE_OF_WINDOW[kind]))]

    def named(self, codes: list[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for value, (name, _) in zip(codes[1:], self.fields(TYPE_OF_WINDOW[codes[0]]), strict=True):
            out.setdefault(name, []).append(value)
        return out


class Codec:
    """A layout with its codebooks."""

    def __init__(self, layout: Layout, books: dict[str, np.ndarray], pitch_rounding=None):
        self.layout, self.books = layout, books
        #: Pulse centre of (period, number); a caller may bring a correction.
        self.centre = pitch_rounding or (lambda period, k: (period * k + 200) // 400)

    def dequantize(self, kind: str, codes: list[int]) -> np.ndarray:
        """Sums of two signed code vectors each, at their places in the frame. Bit 6 of a 7-bit code is its sign."""
        bits, lengths, _ = self.layout.deal[kind]
        out, at = np.zeros(sum(lengths)), 0
        for i, (b, n) in enumerate(zip(bits, lengths, strict=True)):
            for k, width in enumerate((b - b // 2, b // 2)):
                c = codes[2 * i + k]
                sign = -1 if width == 7 and c & 64 else 1
                out[self.layout.permutation[kind][at : at + n]] += sign * self.books[f"main{k}_{kind}"][c & 63 if width == 7 else c, :n]
            at += n
        return out

    def quantize(self, kind: str, x: np.ndarray, weight: np.ndarray) -> list[int]:
        """Codes of the vectors of x, searched together where they have the same length and bits."""
        bits, lengths, _ = self.layout.deal[kind]
        starts = np.cumsum([0, *lengths])
        codes = [0] * (2 * len(bits))
        for b, n in sorted(set(zip(bits, lengths, strict=True))):
            own = [i for i in range(len(bits)) if (bits[i], lengths[i]) == (b, n)]
            place = np.stack([self.layout.permutation[kind][starts[i] : starts[i] + n] for i in own])
            widths = b - b // 2, b // 2
            books = [self.books[f"main{k}_{kind}"][: 64 if w == 7 else 2**w, :n] for k, w in enumerate(widths)]
            got = vq.two_stage(x[place], *books, weight[place], signed=(widths[0] == 7, widths[1] == 7))
            for row, i in enumerate(own):
                for k in (0, 1):
                    codes[2 * i + k] = int(got[f"code{k}"][row]) | (64 if got[f"sign{k}"][row] < 0 else 0)
        return codes

    def gain(self, code: int, sub: int | None = None) -> float:
        step = GAIN_MAX / (2**GAIN_BITS - 1)
        g = _expand(step * (code + 0.5), GAIN_MAX, MU)
        if sub is None:
            return g / 2.0**13
        return g * _expand(SUBGAIN_MAX / (2**SUBGAIN_BITS - 1) * (sub + 0.5), SUBGAIN_MAX, MU) / 2.0**23

    def bands(self, kind: str, codes: list[int]) -> np.ndarray:
        """Code values of a block's bands."""
        return (self.books[f"bark_{kind}"][codes] / 4096.0).T.reshape(-1)

    def band_envelope(self, kind: str, now: np.ndarray, before: np.ndarray, use: int, gain: float) -> np.ndarray:
        share = BAND_SHARE[kind] if use else 0.0
        st = (1 - share) * now + share * before + 1
        return np.repeat(np.where(st < -1, 1.0, st) * gain, self.books[f"widths_{kind}"].reshape(-1).astype(int))

    def raw_frequencies(self, first: int, second: list[int]) -> np.ndarray:
        """Sum of the first codebook's vector and the segments of the second's, spread once; this is the next history."""
        out, lo = self.books["lsp1"][first].copy(), 0
        for code, hi in zip(second, vq.split_ends(self.layout.order, self.layout.split), strict=True):
            out[lo:hi] += self.books["lsp2"][code, lo:hi]
            lo = hi
        return lpc.spread(out, 1e-4)

    def frequencies(self, raw: np.ndarray, before: np.ndarray, code: int) -> np.ndarray:
        w = self.books["lsp0"][code]
        return np.sort(lpc.spread(lpc.spread(raw * (1 - w) + before * w, 1e-4), 9.5e-5))

    def quantize_frequencies(self, lsp: np.ndarray) -> tuple[int, list[int]]:
        first = int(vq.errors(lsp[None], self.books["lsp1"]).argmin())
        rest, lo, second = lsp - self.books["lsp1"][first], 0, []
        for hi in vq.split_ends(self.layout.order, self.layout.split):
            second.append(int(vq.errors(rest[None, lo:hi], self.books["lsp2"][:, lo:hi]).argmin()))
            lo = hi
        return first, second

    def envelope(self, kind: str, lsp: np.ndarray) -> np.ndarray:
        size = self.layout.n // self.layout.form[kind][0]
        if kind == "short":
            return lpc.envelope_at(2 * np.cos(lsp), np.cos((2 * np.arange(size) + 1) * (np.pi / (2 * size))))
        return lpc.envelope(lsp, size, *((8, 16) if kind == "long" else (2, 4)))

    def pitch(self, period: int, gain: int, shape: np.ndarray) -> np.ndarray:
        """Pulses of a shape vector at multiples of a period; places beyond the frame are left out."""
        lay = self.layout
        least, most = _rounded(80 * lay.n, lay.rate_class), _rounded(480 * lay.n, lay.rate_class)
        length = least + _rounded(period * (most - least), 2**lay.period_bits - 1)
        scale = _expand(PITCH_MAX / (2**lay.pitch_gain_bits - 1) * (gain + 0.5), PITCH_MAX, PITCH_MU) / 8192
        if lay.rate_class == 22 and lay.mode[1] == 32:
            width = _rounded((length + 800) * lay.peak_width, 400 * lay.n)
        else:
            width = length * lay.peak_width // (400 * lay.n)
        width = max(1, width)
        first = np.arange(width // 2)
        rest = [self.centre(length, k) - width // 2 + np.arange(width // 2 + (width + 1) // 2) for k in range(1, max(1, _rounded(len(shape), width)) + 1)]
        places = np.concatenate([first, *rest])[: len(shape)]
        out = np.zeros(lay.n)
        inside = (places >= 0) & (places < lay.n)
        np.add.at(out, places[inside], scale * shape[: len(places)][inside])
        return out

    def state(self, codes: list[int] | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """What a frame leaves for the next: raw frequencies and, by frame type, band values of each channel."""
        lay = self.layout
        raw = np.zeros((lay.channels, lay.order))
        bands = {t: np.full((lay.channels, lay.form[t][1]), BAND_START) for t in lay.form}
        if codes is not None:
            f, kind = lay.named(codes), TYPE_OF_WINDOW[codes[0]]
            sub, _, coefs, _, _ = lay.form[kind]
            for c in range(lay.channels):
                raw[c] = self.raw_frequencies(f["lsp1"][c], f["lsp2"][c * lay.split : (c + 1) * lay.split])
                last = (c + 1) * sub * coefs
                bands[kind][c] = self.bands(kind, f["bark"][last - coefs : last])
        return raw, bands

    def decode(self, codes: list[int], before: list[int] | None, same: list[int] | None = None) -> np.ndarray:
        """Spectrum (channels x n) of a frame. Band history is that of same, the last frame of the same type; without it,
        that of the frame before, if it is of the same type."""
        lay, f, kind = self.layout, self.layout.named(codes), TYPE_OF_WINDOW[codes[0]]
        old_raw, old_bands = self.state(before)
        if same is not None:
            old_bands = self.state(same)[1]
        sub, _, coefs, _, _ = lay.form[kind]
        size = lay.n // sub
        out = self.dequantize(kind, f["main"]).reshape(lay.channels, lay.n)
        shapes = self.dequantize("pitch", f["pitch"]).reshape(lay.channels, -1) if kind == "long" else None
        for c in range(lay.channels):
            history = old_bands[kind][c]
            for j in range(sub):
                b = c * sub + j
                now = self.bands(kind, f["bark"][b * coefs : (b + 1) * coefs])
                gain = self.gain(f["gain"][c], f["sub_gain"][b] if kind != "long" else None)
                out[c, j * size : (j + 1) * size] *= self.band_envelope(kind, now, history, f["history"][b], gain)
                history = now
            if kind == "long":
                out[c] += self.pitch(f["period"][c], f["pitch_gain"][c], shapes[c])
            raw = self.raw_frequencies(f["lsp1"][c], f["lsp2"][c * lay.split : (c + 1) * lay.split])
            out[c] *= np.tile(self.envelope(kind, self.frequencies(raw, old_raw[c], f["lsp0"][c])), sub)
        return out

    def encode(self, blocks: np.ndarray, before: np.ndarray | None) -> list[int]:
        """Codes of a long frame from blocks (channels x 2n) of samples, mid before side; before: the blocks one hop ago.

        The pitch part is sent empty, but index 0 stands for half a step and is taken off the spectrum as decoders add it.
        """
        lay = self.layout
        n, window = lay.n, transform.window(lay.n)
        norm = 2.0 if lay.channels == 1 else 1.0
        spectra = transform.mdct(blocks * window, 2 / n * (-32768 / math.sqrt(norm / n)))
        lsp = self._analysed(blocks)
        old = self._analysed(before) if before is not None else None
        pitch_codes = [0] * (2 * len(lay.deal["pitch"][0]))
        shapes = self.dequantize("pitch", pitch_codes).reshape(lay.channels, -1)
        rest, weight = np.zeros((lay.channels, n)), np.zeros((lay.channels, n))
        bark, gains, lsp_codes = [], [], []
        _, _, coefs, _, _ = lay.form["long"]
        widths = self.books["widths_long"].reshape(-1).astype(int)
        for c in range(lay.channels):
            first, second = self.quantize_frequencies(lsp[c])
            raw = self.raw_frequencies(first, second)
            history = self.raw_frequencies(*self.quantize_frequencies(old[c])) if old is not None else np.zeros(lay.order)
            tries = [self.frequencies(raw, history, h) for h in range(2 ** lay.lsp_bits[0])]
            h = int(np.argmin([((t - lsp[c]) ** 2).sum() for t in tries]))
            lsp_codes += [h, first, *second]
            env = np.maximum(self.envelope("long", tries[h]), 1e-6)
            flat = spectra[c] / env - self.pitch(0, 0, shapes[c])
            (gain,), (own,) = vq.gain_and_bands(flat[None], widths, coefs, self.books["bark_long"] / 4096.0, LEVEL)
            gains.append(int(gain))
            g = self.gain(gains[c])
            own = own.tolist()
            bark += own
            band = self.band_envelope("long", self.bands("long", own), np.zeros(len(widths)), 0, g)
            rest[c] = np.where(np.abs(band) > 1e-8, flat / np.where(band == 0, 1, band), flat)
            weight[c] = (env * band) ** 2
        main = self.quantize("long", rest.reshape(-1), weight.reshape(-1))
        made = self.dequantize("long", main).reshape(lay.channels, n)
        for c in range(lay.channels):
            power = (weight[c] * made[c] ** 2).sum()
            factor = max(0.0, (weight[c] * rest[c] * made[c]).sum() / power) if power > 1e-20 else 1.0
            was = self.gain(gains[c])
            gains[c] = _compress(was * factor * 8192, GAIN_MAX, MU, GAIN_BITS)
            ratio = self.gain(gains[c]) / was
            rest[c] /= ratio
            weight[c] *= ratio**2
        main = self.quantize("long", rest.reshape(-1), weight.reshape(-1))
        return [0, *main, *bark, *[0] * lay.channels, *gains, *lsp_codes, *pitch_codes, *[0] * (2 * lay.channels)]

    def _analysed(self, blocks: np.ndarray) -> np.ndarray:
        lags = lpc.autocorrelation(blocks * transform.window(self.layout.n), self.layout.order)
        return np.stack([lpc.line_spectrum(a) for a in lpc.levinson(lags)])


def book_rows(spark: SparkSession, books: dict[str, np.ndarray]) -> DataFrame:
    """Codebooks as rows (name, code, dim, value), to be written as a table; load_books() undone."""
    parts = [pa.table({"name": [name] * book.size, "code": np.repeat(np.arange(book.shape[0], dtype=np.int32), book.shape[1]), "dim": np.tile(np.arange(book.shape[1], dtype=np.int32), book.shape[0]), "value": book.reshape(-1).astype(float)}) for name, book in sorted(books.items())]
    if not parts:
        return spark.createDataFrame([], "name string, code int, dim int, value double")
    return spark.createDataFrame(pa.concat_tables(parts))


def load_books(table: DataFrame) -> dict[str, np.ndarray]:
    """Codebooks of rows (name, code, dim, value), at most vq.MOST_VALUES; missing places are 0."""
    if table.count() > vq.MOST_VALUES:
        raise ValueError("the codebooks are too large")
    rows = table.collect()
    shapes: dict[str, tuple[int, int]] = {}
    for r in rows:
        a, b = shapes.get(r["name"], (0, 0))
        shapes[r["name"]] = max(a, r["code"] + 1), max(b, r["dim"] + 1)
    out = {name: np.zeros(shape) for name, shape in shapes.items()}
    for r in rows:
        out[r["name"]][r["code"], r["dim"]] = r["value"]
    return out


def _mapped(df: DataFrame, schema: str, kernel, keep: tuple[str, ...] = ("sig", "frame")) -> DataFrame:
    """The columns in keep, which come first, and what kernel makes of each row's other columns; rows for which it makes
    null are left out."""
    names = [*keep, schema.split(" ")[0]]
    kept_types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64()) if "double" in schema else pa.binary() if "binary" in schema else pa.list_(pa.int32())
        for batch in batches:
            made = [kernel(*(x.as_py() for x in row)) for row in zip(*batch.columns[len(keep) :], strict=True)]
            at = pa.array([k for k, x in enumerate(made) if x is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], pa.array([x for x in made if x is not None], kind)], names=names)

    return df.mapInArrow(run, f"{kept_types}, {schema}")


def signal_blocks(signal: DataFrame, layout: Layout, lead: bool = True) -> DataFrame:
    """(sig, frame, x array of channels * 2n) of samples (sig, ch, i, x): the hop before and this one of each channel, mid
    before side, with a silent hop after the signal and, with lead, one before it. Samples of further channels are left out."""
    n, channels = layout.n, layout.channels
    hops = hop_arrays(signal.where(F.col("ch").between(0, channels - 1)).withColumn("sig", F.struct("sig", "ch")), n).select("sig.sig", "sig.ch", "frame", "x")
    silent = F.array_repeat(F.lit(0.0), n)
    side = lambda c: F.coalesce(F.max(F.when(F.col("ch") == c, F.col("x"))), silent)
    hops = hops.groupBy("sig", "frame").agg(*[side(c).alias(f"x{c}") for c in range(channels)])
    if channels == 2:
        mix = lambda sign: F.zip_with("x0", "x1", lambda a, b: (a + sign * b) / 2)
        hops = hops.select("sig", "frame", mix(1).alias("x0"), mix(-1).alias("x1"))
    own = F.struct(*[f"x{c}" for c in range(channels)])
    none = F.lit(None).cast(hops.select(own.alias("s")).schema["s"].dataType)
    # a hop is the second half of one frame and the first of the next; with lead, frame 0 is silence
    first = int(lead)
    rows = hops.select("sig", (F.col("frame") + first).alias("frame"), own.alias("b"), none.alias("a"))
    rows = rows.union(hops.select("sig", (F.col("frame") + first + 1).alias("frame"), none, own))
    if lead:
        rows = rows.union(hops.select("sig").distinct().select("sig", F.lit(0).cast("long"), none, none))
    both = rows.groupBy("sig", "frame").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    halves = [F.coalesce(F.col(half)[f"x{c}"], silent) for c in range(channels) for half in ("a", "b")]
    return both.select("sig", "frame", F.concat(*halves).alias("x"))


def encode_frames(blocks: DataFrame, codec: Codec) -> DataFrame:
    """(sig, frame, codes array<int>) of blocks (sig, frame, x array of channels * 2n), whose history is that of the frame
    before."""
    shape = (codec.layout.channels, 2 * codec.layout.n)
    kernel = lambda x, before: codec.encode(np.reshape(x, shape), None if before is None else np.reshape(before, shape))
    beside = previous(blocks.select("sig", "frame", "x"), ["sig"], "frame", ["x"]).select("sig", "frame", "x", F.col("before.x").alias("before"))
    return _mapped(beside, "codes array<int>", kernel)


def decode_frames(frames: DataFrame, codec: Codec) -> DataFrame:
    """(sig, frame, window_type, x array of channels * n) of codes. History is that of the last frame there is, and for bands
    that of the last one of the same type; frames that are left out change none."""
    kind = F.element_at(F.array(*map(F.lit, TYPE_OF_WINDOW)), F.col("codes")[0] + 1)
    rows = frames.select("sig", "frame", "codes", kind.alias("kind"))
    beside = previous(rows, ["sig"], "frame", ["codes"]).withColumnRenamed("before", "last")
    beside = previous(beside, ["sig", "kind"], "frame", ["codes"])
    beside = beside.select("sig", "frame", F.col("codes")[0].alias("window_type"), "codes", F.col("last.codes").alias("last"), F.col("before.codes").alias("same"))
    return _mapped(beside, "x array<double>", lambda codes, before, same: codec.decode(codes, before, same).reshape(-1).tolist(), ("sig", "frame", "window_type"))


def decode_samples(frames: DataFrame, codec: Codec, priming: int = 2) -> DataFrame:
    """(sig, ch, i, x): the samples of codes (sig, frame, codes), left before right, without each signal's first priming
    frames; they lead in. Samples are numbered by the frames that there are; one that cannot be joined has none."""
    lay = codec.layout
    subs = lay.form["medium"][0], lay.form["short"][0]
    numbered = ranked(frames.select("sig", "frame", "codes"), ["sig"], "frame", "hop").select("sig", F.col("hop").alias("frame"), "codes")
    hops = transform.synthesised(decode_frames(numbered, codec), lay.n, *subs, lay.channels)
    return transform.channel_samples(hops, lay.n, lay.channels, priming)


def pack_frames(frames: DataFrame, layout: Layout) -> DataFrame:
    """(sig, frame, record binary) of codes."""
    return _mapped(frames.select("sig", "frame", "codes"), "record binary", layout.pack)


def joined_records(records: DataFrame, layout: Layout) -> DataFrame:
    """(sig, data binary): a signal's records, in the order of frames and frame_bits each, as the data of its file, which is
    one row; a group holds that file."""

    def join(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("frame").to_numpy(), kind="stable")
        rows = group.column("record").take(pa.array(order)).to_pylist()
        bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : layout.frame_bits]
        return pa.table({"sig": group.column("sig").slice(0, 1), "data": pa.array([np.packbits(bits.reshape(-1)).tobytes()], pa.binary())})

    kind = records.schema["sig"].dataType.simpleString()
    return records.select("sig", "frame", "record").groupBy("sig").applyInArrow(join, f"sig {kind}, data binary")


def parse_frames(records: DataFrame, layout: Layout) -> DataFrame:
    """(sig, frame, codes) of records (sig, frame, record, skip); records of unknown window types are left out."""
    return _mapped(records.select("sig", "frame", "record", "skip"), "codes array<int>", lambda data, skip: layout.parse(data, skip))
