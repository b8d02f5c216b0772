"""Queries over frame records and block-switched synthesis, with codes, codebooks and spectra made from the tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import companding
from ..operators import codec, framing, lpc, metrics, transform, vq
from ..sources import host, wav
from ..sources.signals import from_events, generated, stereo_from_events
from .registry import query, rounded, table
from .signal_queries import _BLOCKS, _SIG, _STEREO, line_spectra_sql
from .vector_queries import _V, _book, _vectors

#: The layout of the records: 8 kHz, 8 kbit/s, one channel.
LAYOUT = codec.Layout(8, 8, 1)
#: Window types of the frames in turn: each of the three kinds of frames after each other, and a slope that both blocks hold.
TURNS = (0, 0, 2, 3, 8, 5, 2, 4, 7, 5)
N, SUB_MEDIUM, SUB_SHORT = 32, 2, 4


def _code(j: int, bits: int) -> str:
    """The code of a record's field j, by the event."""
    return f"((event_id * 31 + {j * 17}) % {1 << bits})"


def _codes(kind: int) -> list[str]:
    return [str(kind), *(_code(j, bits) for j, (_, bits) in enumerate(LAYOUT.fields(codec.TYPE_OF_WINDOW[kind])))]


_KINDS = (0, 2, 8)  # a long, a short and a medium frame
_LISTS = "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN [{', '.join(_codes(k))}]" for i, k in enumerate(_KINDS)) + " END"
_WIDTHS = "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN [{', '.join(str(b) for b in (4, *(b for _, b in LAYOUT.fields(codec.TYPE_OF_WINDOW[k]))))}]" for i, k in enumerate(_KINDS)) + " END"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sig, frame, codes) of the events."""
    lists = F.lit(None).cast("array<int>")
    for i, k in enumerate(_KINDS):
        lists = F.when(F.col("event_id") % 3 == i, F.array(*[F.expr(c).cast("int") for c in _codes(k)])).otherwise(lists)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("sig"), F.col("event_id").alias("frame"), lists.alias("codes"))


@query(f"""WITH c AS (SELECT event_type AS sig, event_id, {_LISTS} AS codes, {_WIDTHS} AS widths FROM events),
b AS (SELECT sig, event_id, rpad(array_to_string(list_transform(range(1, len(codes) + 1), lambda j: lpad(bin(codes[j]::BIGINT), widths[j], '0')), ''), {LAYOUT.frame_bits}, '0') AS bits FROM c)
SELECT sig, event_id AS frame, array_to_string(list_transform(range({LAYOUT.frame_bits // 4}), lambda i: printf('%X', bits[4 * i + 1]::INTEGER * 8 + bits[4 * i + 2]::INTEGER * 4 + bits[4 * i + 3]::INTEGER * 2 + bits[4 * i + 4]::INTEGER)), '') AS record FROM b""")
def frame_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.pack_frames(_frames(spark, sf_dir), LAYOUT).select("sig", "frame", F.hex("record").alias("record"))


@query(f"SELECT event_type AS sig, event_id AS frame, array_to_string({_LISTS}, ',') AS codes FROM events WHERE event_id % 7 > 0")
def frame_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records parsed again; those of every seventh event have a window type that does not exist."""
    packed = codec.pack_frames(_frames(spark, sf_dir), LAYOUT)
    bad = F.when(F.col("frame") % 7 == 0, F.concat(F.lit(b"\xf0"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    parsed = codec.parse_frames(packed.select("sig", "frame", bad.alias("record"), F.lit(0).alias("skip")), LAYOUT)
    return parsed.select("sig", "frame", F.array_join("codes", ",").alias("codes"))


#: The value of a code's place: (code * a + place * b) mod 101 - 50.
_BOOKS = {"main0_long": (37, 11), "main1_long": (23, 7)}


_BITS, _LENGTHS, _ = LAYOUT.deal["long"]
_SPANS = [(i, b - b // 2, b // 2, sum(_LENGTHS[:i]), n) for i, (b, n) in enumerate(zip(_BITS, _LENGTHS, strict=True))]
_TARGETS = "t(place, target) AS (SELECT unnest(range({0})), unnest([{1}]))".format(LAYOUT.n, ", ".join(map(str, LAYOUT.permutation["long"].tolist())))


def _signed(k: int) -> str:
    """SQL for the signed code vector's value of the stage k: bit 6 of a 7-bit code is its sign."""
    code, width = f"((vec_id * 31 + (2 * i + {k}) * 17) % (1 << w{k})::BIGINT)", f"w{k}"
    a, b = _BOOKS[f"main{k}_long"]
    return f"(CASE WHEN {width} = 7 AND {code} >= 64 THEN -1 ELSE 1 END * ((CASE WHEN {width} = 7 THEN {code} % 64 ELSE {code} END * {a} + d * {b}) % 101 - 50))"


@query(f"""WITH {_TARGETS}, s AS (SELECT * FROM (VALUES {', '.join(map(str, _SPANS))}) s(i, w0, w1, start, n)),
p AS (SELECT vec_id, start + d AS place, {_signed(0)} + {_signed(1)} AS x FROM embeddings, s, range({max(_LENGTHS)}) r(d) WHERE d < n)
SELECT vec_id, target::INTEGER AS bin, x::DOUBLE AS x FROM p JOIN t USING (place)""")
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of vector codes: sums of two signed code vectors each, dealt to their places."""
    codes, places = np.arange(64)[:, None], np.arange(max(_LENGTHS))[None]
    c = codec.Codec(LAYOUT, {name: ((codes * a + places * b) % 101 - 50).astype(float) for name, (a, b) in _BOOKS.items()})
    widths = [w for _, a, b, _, _ in _SPANS for w in (a, b)]
    codes = F.array(*[((F.col("vec_id") * 31 + j * 17) % (1 << w)).cast("int") for j, w in enumerate(widths)])
    rows = codec._mapped(table(spark, sf_dir, "embeddings").select("vec_id", codes.alias("codes")), "x array<double>", lambda x: c.dequantize("long", x).tolist(), ("vec_id",))
    return rows.select("vec_id", F.posexplode("x").alias("bin", "x"))


def _spectra(signal: DataFrame) -> DataFrame:
    """(sig, frame, window_type, x): hops as if they were coefficients, with window types in turn."""
    turns = F.array(*[F.lit(k) for k in TURNS])
    return framing.hop_arrays(signal, N).withColumn("window_type", turns[(F.col("frame") % len(TURNS)).cast("int")])


_BLOCK_ROWS = ", ".join(f"({i}, {j}, {at}, {size}, {slope})" for i, k in enumerate(TURNS) for j, (at, (size, slope)) in enumerate((sum(s for s, _ in blocks[:j]), b) for blocks in [transform._block_slopes(k, N, SUB_MEDIUM, SUB_SHORT)] for j, b in enumerate(blocks)))


def _lines_sql(sources: str, norm: int) -> str:
    """From f(sig, frame, p, x), the coefficients: y(sig, t, y), the time line times 32768."""
    return f"""{sources}, k(turn, j, pos, size, slope) AS (VALUES {_BLOCK_ROWS}),
fr AS (SELECT DISTINCT sig, frame FROM f),
b AS (SELECT sig, frame, j, pos, size, slope, coalesce(lead(slope) OVER (PARTITION BY sig ORDER BY frame, j), size) AS after FROM fr JOIN k ON frame % {len(TURNS)} = turn),
i AS (SELECT b.sig, b.frame, j, pos, size, slope, after, q, sum(-sqrt({norm}.0 / size) * x * cos((q + 0.5 + size / 2) * (p - pos + 0.5) * pi() / size)) AS v
  FROM b JOIN f ON f.sig = b.sig AND f.frame = b.frame AND p >= pos AND p < pos + size, range({2 * N}) r(q) WHERE q < 2 * size GROUP BY ALL),
y AS (SELECT sig, frame * {N} + pos - size // 2 + q AS t, sum(v * CASE WHEN q < (size - slope) // 2 THEN 0 WHEN q < (size + slope) // 2 THEN sin((q - (size - slope) // 2 + 0.5) * pi() / (2 * slope))
  WHEN q < size + (size - after) // 2 THEN 1 WHEN q < size + (size + after) // 2 THEN cos((q - size - (size - after) // 2 + 0.5) * pi() / (2 * after)) ELSE 0 END) AS y FROM i GROUP BY ALL)"""


_HOPS = ", h AS (SELECT sig, (max(i) // 32 + 1) * 32 AS m FROM sig GROUP BY sig), f AS (SELECT h.sig, n // 32 AS frame, n % 32 AS p, coalesce(x, 0) AS x FROM (SELECT sig, unnest(range(m)) AS n FROM h) h LEFT JOIN sig ON sig.sig = h.sig AND sig.i = h.n)"


@query(_lines_sql(_SIG + _HOPS, 2) + f"SELECT y.sig, (t + {N // 2}) // {N} AS frame, ((t + {N // 2}) % {N})::INTEGER AS p, round(y, 6) + 0.0 AS x FROM y JOIN h ON h.sig = y.sig WHERE t >= -{N // 2} AND t < m - {N // 2}")
def block_switched_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = transform.synthesised(_spectra(from_events(table(spark, sf_dir, "events"))), N, SUB_MEDIUM, SUB_SHORT)
    return hops.select("sig", "frame", F.posexplode("x").alias("p", "x")).select("sig", "frame", "p", (F.round(F.col("x") * 32768, 6) + F.lit(0.0)).alias("x"))


_TWO = _STEREO + """, e AS (SELECT sig, min(m) AS m FROM (SELECT sig, ch, (max(i) // 32 + 1) * 32 AS m FROM st GROUP BY sig, ch) GROUP BY sig),
both_ AS (SELECT e.sig || '/' || c.ch AS sig, e.sig AS own, c.ch, n AS i, coalesce(x, 0) AS x FROM (SELECT sig, m, unnest(range(m)) AS n FROM e) e, (VALUES (0), (1)) c(ch) LEFT JOIN st ON st.sig = e.sig AND st.ch = c.ch AND st.i = e.n),
f AS (SELECT sig, i // 32 AS frame, i % 32 AS p, x FROM both_)"""


@query(_lines_sql(_TWO, 1) + f""", o AS (SELECT own, t + {N // 2} - {2 * N} AS i, sum(CASE WHEN ch = 0 THEN y END) AS m, sum(CASE WHEN ch = 1 THEN y END) AS s
  FROM y JOIN (SELECT DISTINCT sig, own, ch FROM both_) USING (sig) JOIN e ON e.sig = own WHERE t >= {2 * N} - {N // 2} AND t < e.m - {N // 2} GROUP BY ALL)
SELECT own AS sig, ch::INTEGER AS ch, i, round(CASE WHEN ch = 0 THEN m + s ELSE m - s END, 6) + 0.0 AS x FROM o, (VALUES (0), (1)) c(ch)""")
def stereo_output_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid and side spectra to left and right samples, without the two leading frames."""
    sides = stereo_from_events(table(spark, sf_dir, "events"))
    one = lambda ch: _spectra(sides.where(F.col("ch") == ch).drop("ch"))
    other = one(1).select(F.col("sig").alias("s"), F.col("frame").alias("f"), F.col("x").alias("side"))
    both = one(0).join(other, (F.col("sig") == F.col("s")) & (F.col("frame") == F.col("f"))).select("sig", "frame", "window_type", F.concat("x", "side").alias("x"))
    hops = framing.valid_after_priming(transform.synthesised(both, N, SUB_MEDIUM, SUB_SHORT, 2), F.col("x").isNotNull())
    return transform.channel_samples(hops, N, 2).select("sig", "ch", "i", (F.round(F.col("x") * 32768, 6) + F.lit(0.0)).alias("x"))


_MEAN = "(SELECT embedding::DOUBLE[] AS g FROM embeddings WHERE vec_id = 0)"


@query(_V + f""", p AS (SELECT vec_id, unnest(range(1, 65)) AS j, e, g FROM v, {_MEAN}),
s AS (SELECT vec_id, sum((1 + abs(e[j])) * e[j] * g[j]) AS xy, sum((1 + abs(e[j])) * g[j] * g[j]) AS yy FROM p GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN yy <= 1e-20 THEN 1.0 ELSE greatest(0.0, xy / yy) END, 6) + 0.0 AS factor FROM s""")
def weighted_gain_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    one = v.where("vec_id = 0").select(F.lit(0).alias("k"), F.col("v").alias("y"))  # a row
    weight = F.transform("v", lambda x: 1 + F.abs(x))
    return v.withColumn("k", F.lit(0)).join(F.broadcast(one), "k").select("vec_id", vq.gain_fit(F.col("v"), F.col("y"), weight).alias("factor")).select("vec_id", rounded("factor"))


@query(_SIG + """, x AS (SELECT * FROM sig WHERE i >= 64 AND i < 64 + 512), y AS (SELECT sig, i + 5 AS i, -0.7 * x AS x FROM sig), z AS (SELECT * FROM y WHERE i >= 64 AND i < 64 + 512),
c AS (SELECT x.sig, lag::INTEGER AS lag, sum(x.x * z.x) AS c FROM x, (SELECT unnest(range(-32, 33)) AS lag) l JOIN z ON z.sig = x.sig AND z.i = x.i + l.lag GROUP BY ALL)
SELECT sig, lag, sign(c)::INTEGER AS polarity, round(c, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY round(abs(c), 9) DESC, lag) AS r FROM c) WHERE r = 1""")
def fft_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = from_events(table(spark, sf_dir, "events"))
    y = x.select("sig", (F.col("i") + 5).alias("i"), (F.col("x") * -0.7).alias("x"))
    return metrics.fft_lag(x, y, start=64, count=512, most=32).select("sig", "lag", "polarity", rounded("score"))


@query(_SIG + """, p AS (SELECT sig, i, x, round_even(least(greatest(x, -1.0), 1.0) * 32767, 0)::INTEGER / 32768.0::DOUBLE AS y FROM sig), n AS (SELECT sig, max(i) + 1 AS n FROM sig GROUP BY sig)
SELECT p.sig, count(*) AS n, round(10 * log10(sum(x * x) / sum((x - y) * (x - y))), 4) + 0.0 AS snr_db, round(max(abs(y)), 6) + 0.0 AS peak FROM p JOIN n ON n.sig = p.sig WHERE i >= 40 AND i < n.n - 40 GROUP BY p.sig""")
def trimmed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = from_events(table(spark, sf_dir, "events")).withColumn("y", companding.from_pcm16(companding.to_pcm16(F.col("x"))))
    out = metrics.quality(metrics.trimmed(pairs, ["sig"], 40), ["sig"])
    return out.select("sig", "n", rounded("snr_db", 4), rounded("peak"))


_LPC_BLOCKS = 8


@query(line_spectra_sql(_BLOCKS + ", f AS (SELECT * FROM tapered), ", _LPC_BLOCKS))
def analysed_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line spectral frequencies of overlapping windowed blocks."""
    blocks = framing.overlapped(framing.hop_arrays(from_events(table(spark, sf_dir, "events")), N), N)
    return lpc.analysed(blocks, N, _LPC_BLOCKS).select("sig", "frame", F.posexplode("x").alias("j", "lsp")).select("sig", "frame", "j", rounded("lsp"))


_LONG = 128


@query(_SIG + f""", w AS (SELECT sig, i // {_LONG} + d AS frame, i % {_LONG} + CASE WHEN d = 1 THEN 0 ELSE {_LONG} END AS p, x FROM sig, (VALUES (0), (1)) t(d))
SELECT sig, frame, k::INTEGER AS k, round(sum(x * sin((p + 0.5) * pi() / {2 * _LONG}) * cos((p + 0.5 + {_LONG // 2}) * (k + 0.5) * pi() / {_LONG})) * 2.0 / {_LONG} * -32768 / sqrt(2.0 / {_LONG}), 4) + 0.0 AS x FROM w, range({_LONG}) r(k) GROUP BY sig, frame, k""")
def scaled_fast_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of long blocks, by the FFT, at the scale of an encoder's spectra of one channel."""
    blocks = framing.overlapped(framing.hop_arrays(from_events(table(spark, sf_dir, "events")), _LONG), _LONG)
    spectra = transform.forward(blocks, _LONG, 2 / _LONG * -32768 / math.sqrt(2 / _LONG))
    return spectra.select("sig", "frame", F.posexplode("x").alias("k", "x")).select("sig", "frame", "k", rounded("x", 4))


@query("SELECT 'chirp' AS sig, i::BIGINT AS i, round(0.18 * sin(2 * pi() * (437 * i / 44100.0::DOUBLE + 70 * (i / 44100.0::DOUBLE) * (i / 44100.0::DOUBLE))) + 0.06 * sin(2 * pi() * (1123 * i / 44100.0::DOUBLE + 70 * (i / 44100.0::DOUBLE) * (i / 44100.0::DOUBLE))), 9) + 0.0 AS x FROM range(5000) r(i)")
def generated_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, 5000, [(0.18, 437.0), (0.06, 1123.0)], sweep=70.0, sig="chirp").select("sig", "i", rounded("x", 9))


_WAV = 64
_PCM_SQL = _SIG + f", p AS (SELECT sig, i // {_WAV} AS frame, i % {_WAV} AS p, round_even(least(greatest(x, -1.0), 1.0) * 32767, 0)::INTEGER AS pcm FROM sig), n AS (SELECT sig, unnest(range(max(i) // {_WAV} + 1)) AS frame FROM sig GROUP BY sig)"


def _wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a 16-bit file of one channel for each hop; hops that are not whole end in silence."""
    hops = framing.hop_arrays(from_events(table(spark, sf_dir, "events")), _WAV)
    u = lambda v: F.pmod(companding.to_pcm16(v), F.lit(65_536))
    low, high = (lambda v: F.lpad(F.hex(u(v) % 256), 2, "0")), (lambda v: F.lpad(F.hex(F.floor(u(v) / 256).cast("long")), 2, "0"))
    body = F.unhex(F.array_join(F.transform("x", lambda v: F.concat(low(v), high(v))), ""))
    return hops.select(F.concat_ws("/", "sig", F.col("frame").cast("string")).alias("path"), F.concat(F.lit(wav.header16(8000, 1, _WAV)), body).alias("content"))


@query(_PCM_SQL + f" SELECT n.sig || '/' || n.frame AS path, 8000::INTEGER AS rate, 0::INTEGER AS ch, k::BIGINT AS i, round(coalesce(pcm, 0) / 32768.0::DOUBLE, 9) + 0.0 AS x, NULL::VARCHAR AS error FROM n, range({_WAV}) r(k) LEFT JOIN p ON p.sig = n.sig AND p.frame = n.frame AND p.p = k")
def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wav.scan(_wav_files(spark, sf_dir)).select("path", "rate", "ch", "i", rounded("x", 9), "error")


@query(_PCM_SQL + f" SELECT n.sig || '/' || n.frame AS path, CASE WHEN n.frame % 3 = 0 THEN 'the data chunk is cut short' END AS error, CASE WHEN n.frame % 3 > 0 THEN {_WAV} ELSE 0 END::BIGINT AS strict, CASE WHEN n.frame % 3 > 0 THEN {_WAV} ELSE {_WAV - 2} END::BIGINT AS loose FROM n")
def wav_scan_cut_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of files of which every third is cut short, as strict and as loose reading has them."""
    cut = F.when(F.element_at(F.split("path", "/"), -1).cast("long") % 3 == 0, F.expr("substring(content, 1, length(content) - 4)")).otherwise(F.col("content"))
    files = _wav_files(spark, sf_dir).select("path", cut.alias("content"))
    counted = lambda strict: wav.scan(files, strict).groupBy("path").agg(F.max("error").alias("error"), F.count("x").alias("n"))
    loose = counted(False).select(F.col("path").alias("p"), F.col("n").alias("loose"))
    return counted(True).join(loose, F.col("path") == F.col("p")).select("path", "error", F.col("n").alias("strict"), "loose")


@query("""SELECT doc_id AS file, coalesce(text, '') AS title, coalesce(source, '') AS artist, '' AS comment, '' AS copyright, '' AS album, '' AS genre, '' AS track, left((1900 + doc_id % 150)::VARCHAR || '-05-01', 4) AS year, '' AS composer, '' AS publisher FROM documents""")
def host_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a host's lists of values: the first of each, of a date the year."""
    none = F.array().cast("array<string>")
    date = F.concat((F.col("doc_id") % 150 + 1900).cast("string"), F.lit("-05-01"))
    lists = F.create_map(F.lit("title"), F.array("text", "lang"), F.lit("artist"), F.array("source"), F.lit("genre"), none, F.lit("date"), F.array(date, F.lit("x")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), lists.alias("m"))
    return rows.select("file", *host.first_values(F.col("m")))


_WIDTHS_LIST, _COEFS, _LEVEL = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10), 2, 6000.0
_BAND_ROWS = ", ".join(f"({i}, {w}, {sum(_WIDTHS_LIST[:i])})" for i, w in enumerate(_WIDTHS_LIST))


@query(_V + f""", b AS (SELECT * FROM (VALUES {_BAND_ROWS}) t(band, width, start)),
g AS (SELECT vec_id, e, least(greatest(floor(ln(1 + 100 * least(greatest(sqrt(list_sum(list_transform(e[1:55], lambda u: u * u * 4e8)) / 55) / {_LEVEL}, 1e-8) * 8192 / 13000, 1.0)) / ln(101) * 255), 0), 255)::INTEGER AS gain FROM v),
t AS (SELECT vec_id, band, gain, sqrt(list_sum(list_transform(e[start + 1:start + width], lambda u: u * u * 4e8)) / width) / (13000 * (exp(ln(101) * least((gain + 0.5) / 255, 1.0)) - 1) / 100 / 8192 * {_LEVEL}) - 1 AS target FROM g, b),
d AS (SELECT t.vec_id, t.gain, band % {_COEFS} AS coef, c.vec_id AS code, sum(power(target - c.e[band // {_COEFS} + 1] * 4, 2)) AS err FROM t JOIN v c ON c.vec_id < 32 GROUP BY ALL)
SELECT vec_id, gain, coef::INTEGER AS coef, code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, coef ORDER BY err, code) AS r FROM d) WHERE r = 1""")
def gain_and_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain and band codes of spectra, here vectors of 55 places in ten bands, against 32 codes of five."""
    v = _vectors(spark, sf_dir)
    spectra = v.select("vec_id", F.transform(F.slice("v", 1, sum(_WIDTHS_LIST)), lambda u: u * 20_000).alias("v"))
    codes, book = _book(v, 0, 32, len(_WIDTHS_LIST) // _COEFS)
    rows = vq.quantize_gain_bands(spectra, list(_WIDTHS_LIST), _COEFS, (codes, book * 4), _LEVEL, ["vec_id"])
    return rows.select("vec_id", "gain", F.posexplode("codes").alias("coef", "code"))


_LSP_ENDS = vq.split_ends(12, 3)
_SEGMENTS = ", ".join(f"({k}, {lo}, {hi})" for k, (lo, hi) in enumerate(zip([0, *_LSP_ENDS], _LSP_ENDS, strict=False)))


@query(_V + f""", one AS (SELECT vec_id, x, code, ce FROM (SELECT a.vec_id, a.e AS x, c.vec_id AS code, c.e AS ce, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(range(1, 13), lambda j: power(a.e[j] - c.e[j], 2))), c.vec_id) AS r FROM v a JOIN v c ON c.vec_id < 16) WHERE r = 1),
s AS (SELECT * FROM (VALUES {_SEGMENTS}) t(segment, lo, hi)),
d AS (SELECT one.vec_id, one.code, segment, c.vec_id AS second, list_sum(list_transform(range(lo + 1, hi + 1), lambda j: power(x[j] - ce[j] - c.e[j], 2))) AS err FROM one, s JOIN v c ON c.vec_id >= 16 AND c.vec_id < 32)
SELECT vec_id, code, segment::INTEGER AS segment, second FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, segment ORDER BY err, second) AS r FROM d) WHERE r = 1""")
def lsp_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest code of a first book, and for each segment of the rest the nearest of a second."""
    v = _vectors(spark, sf_dir)
    short = v.select("vec_id", F.slice("v", 1, 12).alias("v"))
    rows = vq.residual_codes(short, _book(v, 0, 16, 12), _book(v, 16, 32, 12), _LSP_ENDS, ["vec_id"])
    return rows.select("vec_id", "code", F.posexplode("second").alias("segment", "second"))


@query(_V + """SELECT vec_id, (j - 1)::INTEGER AS bin, round(CASE WHEN abs(e[j + 32] * (j % 4)) > 1e-8 THEN e[j] / nullif(e[j + 32] * (j % 4), 0) ELSE e[j] END, 6) + 0.0 AS rest,
round((1 + abs(e[j])) * e[j + 32] * (j % 4) * (1 + abs(e[j])) * e[j + 32] * (j % 4), 6) + 0.0 AS weight FROM v, (SELECT unnest(range(1, 33)) AS j)""")
def residual_and_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the first half of a vector under bands made from the other, and the weights of its places."""
    v = _vectors(spark, sf_dir)
    x = F.slice("v", 1, 32)
    band = F.transform(F.slice("v", 33, 32), lambda u, i: u * ((i + 1) % 4))
    envelope = F.transform(x, lambda u: 1 + F.abs(u))
    both = F.arrays_zip(vq.residual(x, band).alias("rest"), vq.place_weights(envelope, band).alias("weight"))
    rows = v.select("vec_id", F.posexplode(both).alias("bin", "b")).select("vec_id", "bin", "b.rest", "b.weight")
    return rows.select("vec_id", "bin", rounded("rest"), rounded("weight"))
