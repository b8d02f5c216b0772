"""Queries over signals that are derived from events: a signal for each event type, or two channels by event number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import companding
from ..operators import framing, lpc, metrics, transform
from ..sources.signals import from_events, stereo_from_events
from .registry import query, rounded, table
from .vector_queries import _spread_sql as spread_sql

N, ORDER, FRAME_BITS = 32, 4, 371

_SIG = "WITH sig AS (SELECT event_type AS sig, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, (value - 50) / 500 AS x FROM events)"
_STEREO = "WITH st AS (SELECT event_type AS sig, (event_id % 2)::INTEGER AS ch, row_number() OVER (PARTITION BY event_type, event_id % 2 ORDER BY ts, event_id) - 1 AS i, (value - 50) / 500 AS x FROM events)"
_MS = _STEREO + ", ms AS (SELECT a.sig, a.i, (a.x + b.x) / 2 AS m, (a.x - b.x) / 2 AS s FROM st a JOIN st b ON a.sig = b.sig AND a.i = b.i AND a.ch = 0 AND b.ch = 1)"
_BLOCKS = _SIG + """,
w AS (SELECT sig, i // 32 + d AS frame, (i % 32 + CASE WHEN d = 1 THEN 0 ELSE 32 END)::INTEGER AS p, x FROM sig, (VALUES (0), (1)) t(d)),
tapered AS (SELECT sig, frame, p, x * sin((p + 0.5) * pi() / 64) AS x FROM w)"""
_MDCT = _BLOCKS + ", mdct AS (SELECT sig, frame, k::INTEGER AS k, 2.0 / 32 * sum(x * cos((p + 16.5) * (k + 0.5) * pi() / 32)) AS x FROM tapered, range(32) r(k) GROUP BY sig, frame, k)"


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


@query(_SIG + "SELECT sig, i // 32 AS frame, count(*) AS n, round(sqrt(sum(x * x) / count(*)), 6) + 0.0 AS rms FROM sig GROUP BY sig, i // 32")
def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, _ = framing.hop(N)
    out = _signal(spark, sf_dir).groupBy("sig", frame).agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("rms"))
    return out.select("sig", "frame", "n", rounded("rms"))


@query(_SIG + "SELECT sig, i // 32 AS frame, (i % 32 // 8)::INTEGER AS band, round(sum(x * x), 8) + 0.0 AS energy FROM sig GROUP BY ALL")
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, place = framing.hop(N)
    rows = _signal(spark, sf_dir).select("sig", frame, place, "x")
    band = F.call_function("div", F.col("p"), F.lit(8)).cast("int").alias("band")
    return rows.groupBy("sig", "frame", band).agg(F.sum(F.col("x") * F.col("x")).alias("energy")).select("sig", "frame", "band", rounded("energy", 8))


@query(_SIG + f"SELECT sig, n_samples, n_frames, pad, ((n_frames * {FRAME_BITS} + 7) // 8)::BIGINT AS data_bytes FROM (SELECT sig, count(*) AS n_samples, ((count(*) + 31) // 32 + 2)::BIGINT AS n_frames, ((count(*) + 31) // 32 * 32 - count(*))::BIGINT AS pad FROM sig GROUP BY sig)")
def tail_pad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.frame_counts(_signal(spark, sf_dir), N, FRAME_BITS)


@query(_MS + "SELECT sig, i, round(m, 9) + 0.0 AS m, round(s, 9) + 0.0 AS s FROM ms")
def mid_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.mid_side(stereo_from_events(table(spark, sf_dir, "events")))
    return out.select("sig", "i", rounded("m", 9), rounded("s", 9))


@query(_MS + "SELECT sig, i, round(m + s, 9) + 0.0 AS l, round(m - s, 9) + 0.0 AS r FROM ms")
def mid_side_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.left_right(framing.mid_side(stereo_from_events(table(spark, sf_dir, "events"))))
    return out.select("sig", "i", rounded("l", 9), rounded("r", 9))


@query(_STEREO + "SELECT sig, o.ch::INTEGER AS ch, i, x FROM st JOIN (VALUES (0), (1), (2)) o(ch) ON st.ch = least(o.ch, 1)")
def channel_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.remap_channels(stereo_from_events(table(spark, sf_dir, "events")), 2, 3)


def _resampled_sql(up: int, down: int) -> str:
    return _SIG + f""", n AS (SELECT sig, count(*) AS n, (count(*) * {2 * up} + {down}) // {2 * down} AS m FROM sig GROUP BY sig),
j AS (SELECT sig, n, unnest(range(m)) AS j FROM n), g AS (SELECT sig, j, least(j * {down} // {up}, n - 1) AS i0, least(j * {down} // {up} + 1, n - 1) AS i1 FROM j)
SELECT g.sig, g.j::BIGINT AS i, round(a.x + (b.x - a.x) * (g.j * {down} / {up}::DOUBLE - g.i0), 9) + 0.0 AS x
FROM g JOIN sig a ON a.sig = g.sig AND a.i = g.i0 JOIN sig b ON b.sig = g.sig AND b.i = g.i1"""


@query(_resampled_sql(3, 4))
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.resample_linear(_signal(spark, sf_dir), 3, 4).select("sig", "i", rounded("x", 9))


@query(_resampled_sql(160, 147))
def resample_linear_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.resample_linear(_signal(spark, sf_dir), 160, 147).select("sig", "i", rounded("x", 9))


@query(_BLOCKS + "SELECT sig, frame, p, round(x, 6) + 0.0 AS x FROM tapered")
def sine_windowed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.windowed_samples(_signal(spark, sf_dir), N).select("sig", "frame", F.col("p").cast("int").alias("p"), rounded("x"))


def _coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = framing.hop_arrays(_signal(spark, sf_dir), N)
    return transform.forward(framing.overlapped(hops, N), N)


@query(_MDCT + "SELECT sig, frame, k, round(x, 6) + 0.0 AS x FROM mdct")
def mdct_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir).select("sig", "frame", F.posexplode("x").alias("k", "x")).select("sig", "frame", "k", rounded("x"))


@query(_MDCT + """, y AS (SELECT sig, (frame - 1) * 32 + p AS i, sin((p + 0.5) * pi() / 64) * sum(x * cos((p + 16.5) * (k + 0.5) * pi() / 32)) AS y FROM mdct, range(64) r(p) GROUP BY sig, frame, p)
SELECT sig, i::BIGINT AS i, round(sum(y), 6) + 0.0 AS x FROM y WHERE i >= 0 AND i < (SELECT ((max(i) + 32) // 32) * 32 FROM sig s WHERE s.sig = y.sig) GROUP BY sig, i""")
def imdct_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = transform.inverse(_coefficients(spark, sf_dir), N)
    last = framing.frame_counts(_signal(spark, sf_dir), N, FRAME_BITS).select(F.col("sig").alias("s"), (F.col("n_frames") - 2).alias("hops"))
    whole = hops.join(last, F.col("sig") == F.col("s")).where("frame < hops").select("sig", "frame", "x")
    return transform.samples(whole, N).select("sig", "i", rounded("x"))


@query(_MDCT + "SELECT sig, (k // 8)::INTEGER AS band, round(sum(x * x), 6) + 0.0 AS energy, count(*) AS n FROM mdct GROUP BY sig, k // 8")
def spectrum_band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coefficients(spark, sf_dir).select("sig", F.posexplode("x").alias("k", "x"))
    band = F.call_function("div", F.col("k"), F.lit(8)).cast("int").alias("band")
    return rows.groupBy("sig", band).agg(F.sum(F.col("x") * F.col("x")).alias("energy"), F.count("*").alias("n")).select("sig", "band", rounded("energy"), "n")


def _lags_sql(order: int) -> str:
    """From f(sig, frame, p, x), the samples of frames: r(sig, frame, lag, r)."""
    return f"""ks AS (SELECT unnest(range({order + 1}))::INTEGER AS lag), fr AS (SELECT DISTINCT sig, frame FROM f),
ac AS (SELECT fr.sig, fr.frame, ks.lag, coalesce(sum(a.x * b.x), 0) AS r FROM fr, ks LEFT JOIN f a ON a.sig = fr.sig AND a.frame = fr.frame
  LEFT JOIN f b ON b.sig = a.sig AND b.frame = a.frame AND b.p = a.p + ks.lag GROUP BY fr.sig, fr.frame, ks.lag),
r AS (SELECT sig, frame, lag, CASE WHEN lag = 0 THEN greatest(r * 1.0001, 1e-8) ELSE r END AS r FROM ac)"""


_FRAMED = _SIG + ", f AS (SELECT sig, i // 32 AS frame, (i % 32)::INTEGER AS p, x FROM sig), "


def _recursion_sql(order: int) -> str:
    """From r(sig, frame, lag, r): l{order} with the coefficients a{order}_1 and so on."""
    steps = [f"l0 AS (SELECT sig, frame, {', '.join(f'max(r) FILTER (lag = {k}) AS r{k}' for k in range(order + 1))}, max(r) FILTER (lag = 0) AS err FROM r GROUP BY sig, frame)"]
    for i in range(1, order + 1):
        acc = " + ".join([f"r{i}", *(f"a{i - 1}_{j} * r{i - j}" for j in range(1, i))])
        steps.append(f"k{i} AS (SELECT *, greatest(-0.999, least(0.999, CASE WHEN err > 1e-12 THEN -({acc}) / err ELSE 0 END)) AS k FROM l{i - 1})")
        new = [f"a{i - 1}_{j} + k * a{i - 1}_{i - j} AS a{i}_{j}" for j in range(1, i)] + [f"k AS a{i}_{i}"]
        steps.append(f"l{i} AS (SELECT sig, frame, {', '.join(f'r{x}' for x in range(order + 1))}, greatest(1e-12, err * (1 - k * k)) AS err, {', '.join(new)} FROM k{i})")
    return ", ".join(steps)


def _levinson_sql(order: int) -> str:
    columns = ", ".join(f"round(a{order}_{j}, 6) + 0.0 AS a{j}" for j in range(1, order + 1))
    return f"{_FRAMED}{_lags_sql(order)}, {_recursion_sql(order)} SELECT sig, frame, {columns} FROM l{order}"


def line_spectra_sql(frames: str, order: int) -> str:
    """Line spectral frequencies of the frames that frames gives as f, found by sign changes on a grid and bisection."""
    a = ["1", *(f"a{order}_{j}" for j in range(1, order + 1)), "0"]
    n, half = order + 1, order // 2
    whole = lambda k: " + ".join(f"{'' if (k - j) % 2 == 0 else '-'}1 * ({a[j]} + {a[n - j]})" for j in range(k + 1))
    diff = lambda k: " + ".join(f"({a[j]} - {a[n - j]})" for j in range(k + 1))
    series = lambda f: "[" + ", ".join(f(half + m) for m in range(half + 1)) + "]"
    value = lambda w: "s[1]" + "".join(f" + 2 * s[{m + 1}] * cos({m} * {w})" for m in range(1, half + 1))
    even = "[" + ", ".join(f"pi() * {j} / {n}" for j in range(1, order + 1)) + "]"
    grid = 4096
    with_ = frames.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{with_}{_lags_sql(order)}, {_recursion_sql(order)},
pq AS (SELECT sig, frame, 0 AS kind, {series(whole)} AS s FROM l{order} UNION ALL SELECT sig, frame, 1, {series(diff)} FROM l{order}),
g AS (SELECT sig, frame, kind, s, j, {value(f'(j * pi() / {grid})')} AS y FROM pq, range({grid + 1}) t(j)),
br AS (SELECT * FROM (SELECT *, lead(y) OVER (PARTITION BY sig, frame, kind ORDER BY j) AS y2 FROM g) WHERE sign(y) <> sign(y2)),
bis(sig, frame, s, lo, hi, up, n) AS (SELECT sig, frame, s, j * pi() / {grid}, (j + 1) * pi() / {grid}, y2 > y, 0 FROM br
  UNION ALL SELECT sig, frame, s, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, up, n + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, ({value('((lo + hi) / 2)')} < 0) = up AS low FROM bis WHERE n < 45)),
roots AS (SELECT sig, frame, list(lo ORDER BY lo) AS l FROM bis WHERE n = 45 GROUP BY sig, frame),
found AS (SELECT l{order}.sig, l{order}.frame, CASE WHEN len(l) = {order} THEN l ELSE {even} END AS l FROM l{order} LEFT JOIN roots USING (sig, frame)),
{spread_sql(0.001, 'found', 'spread', order, 'sig, frame')} SELECT sig, frame, j::INTEGER AS j, round(list_sort(l)[j + 1], 6) + 0.0 AS lsp FROM spread, range({order}) t(j)"""


@query(_FRAMED + _lags_sql(8) + " SELECT sig, frame, lag, round(r, 8) + 0.0 AS r FROM r")
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lpc.lags(framing.hop_arrays(_signal(spark, sf_dir), N), N, 8)
    return rows.select("sig", "frame", F.posexplode("x").alias("lag", "r")).select("sig", "frame", "lag", rounded("r", 8))


@query(_levinson_sql(ORDER))
def levinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lpc.predictors(lpc.lags(framing.hop_arrays(_signal(spark, sf_dir), N), N, ORDER), ORDER)
    return rows.select("sig", "frame", *[(F.round(F.col("x")[j], 6) + F.lit(0.0)).alias(f"a{j}") for j in range(1, ORDER + 1)])


@query(line_spectra_sql(_FRAMED, 8))
def line_spectral_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lpc.line_spectra(lpc.predictors(lpc.lags(framing.hop_arrays(_signal(spark, sf_dir), N), N, 8), 8), 8)
    return rows.select("sig", "frame", F.posexplode("x").alias("j", "lsp")).select("sig", "frame", "j", rounded("lsp"))


_ENVELOPE = line_spectra_sql(_FRAMED, 8).rpartition(" SELECT sig, frame, j::INTEGER")[0] + """,
e AS (SELECT sig, frame, list_sort(l) AS l, bin, cos((2 * bin + 1) * pi() / 128) AS c FROM spread, range(64) t(bin)),
ev AS (SELECT sig, frame, bin, 0.5 / (power(0.5 * list_product(list_transform([2, 4, 6, 8], lambda j: 2 * cos(l[j]) - 2 * c)), 2) * (2 - 2 * c) + power(0.5 * list_product(list_transform([1, 3, 5, 7], lambda j: 2 * cos(l[j]) - 2 * c)), 2) * (2 + 2 * c)) AS v FROM e),
node AS (SELECT *, CASE WHEN bin < 32 THEN 0 ELSE 1 END AS part, CASE WHEN bin < 32 THEN 4 ELSE 8 END AS step FROM ev WHERE bin < 32 AND bin % 4 = 0 OR bin >= 32 AND bin % 8 = 0),
near AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM node WINDOW w AS (PARTITION BY sig, frame, part ORDER BY bin)),
knot AS (SELECT sig, frame, bin FROM node UNION SELECT sig, frame, bin - step // 2 FROM near WHERE before IS NOT NULL AND after IS NOT NULL AND NOT (after + before > 1.95 * v OR after >= before)),
kv AS (SELECT knot.sig, knot.frame, knot.bin, v, lead(knot.bin) OVER (PARTITION BY knot.sig, knot.frame ORDER BY knot.bin) AS bin2, lead(v) OVER (PARTITION BY knot.sig, knot.frame ORDER BY knot.bin) AS v2 FROM knot JOIN ev ON ev.sig = knot.sig AND ev.frame = knot.frame AND ev.bin = knot.bin)
SELECT sig, frame, b::INTEGER AS bin, round(v + coalesce((v2 - v) * (b - bin) / (bin2 - bin), 0), 6) + 0.0 AS envelope FROM kv, range(64) t(b) WHERE b >= bin AND b < coalesce(bin2, 64)"""


@query(_ENVELOPE)
def spectral_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    order, bins = 8, 64
    rows = lpc.line_spectra(lpc.predictors(lpc.lags(framing.hop_arrays(_signal(spark, sf_dir), N), N, order), order), order)
    rows = transform.apply_arrays(rows, "x", order, lambda x: np.stack([lpc.envelope(row, bins, 4, 8) for row in x]) if len(x) else np.zeros((0, bins)))
    return rows.select("sig", "frame", F.posexplode("x").alias("bin", "envelope")).select("sig", "frame", "bin", F.round("envelope", 6).alias("envelope"))


_MU = "SELECT event_id, value * 30 - 1000 AS x FROM events"


@query(f"""WITH v AS ({_MU}), y AS (SELECT event_id, x, sign(x) * 13000 * ln(1 + 100 * least(abs(x) / 13000, 1.0)) / ln(101) AS y FROM v),
q AS (SELECT event_id, x, least(greatest(floor(y / (13000.0 / 255)), 0), 255)::INTEGER AS idx FROM y)
SELECT event_id, idx, round(13000 * (exp(ln(101) * least((idx + 0.5) * (13000.0 / 255) / 13000, 1.0)) - 1) / 100, 4) + 0.0 AS recon FROM q""")
def mulaw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 30 - 1000).alias("x"))
    rows = rows.withColumn("idx", companding.quantize_mu(F.col("x"), 13_000.0, 100.0, 8))
    return rows.select("event_id", "idx", companding.dequantize_mu(F.col("idx"), 13_000.0, 100.0, 8).alias("recon")).select("event_id", "idx", rounded("recon", 4))


@query("""WITH g AS (SELECT event_id, 13000 * (exp(ln(101) * least((event_id % 256 + 0.5) * (13000.0 / 255) / 13000, 1.0)) - 1) / 100 AS g,
  4500 * (exp(ln(101) * least((event_id % 32 + 0.5) * (4500.0 / 31) / 4500, 1.0)) - 1) / 100 AS s FROM events)
SELECT event_id, round(g / 8192, 9) + 0.0 AS frame_gain, round(g * s / 8388608, 9) + 0.0 AS block_gain FROM g""")
def gain_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 256).alias("g"), (F.col("event_id") % 32).alias("s"))
    rows = rows.select("event_id", companding.frame_gain(F.col("g")).alias("frame_gain"), companding.block_gain(F.col("g"), F.col("s")).alias("block_gain"))
    return rows.select("event_id", rounded("frame_gain", 9), rounded("block_gain", 9))


@query("SELECT event_id, round_even(least(greatest((value - 250) / 200, -1.0), 1.0) * 32767, 0)::INTEGER AS pcm, abs((value - 250) / 200) >= 1 AS clipped FROM events")
def pcm16_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("value") - 250) / 200
    return table(spark, sf_dir, "events").select("event_id", companding.to_pcm16(x).alias("pcm"), (F.abs(x) >= 1).alias("clipped"))


_PCM = _SIG + ", p AS (SELECT sig, x, round_even(least(greatest(x, -1.0), 1.0) * 32767, 0)::INTEGER / 32768.0::DOUBLE AS y FROM sig)"


@query(_PCM + """SELECT sig, count(*) AS n, round(10 * log10(sum(x * x) / sum((x - y) * (x - y))), 4) + 0.0 AS snr_db, round(10 * log10(sum(y * y) / sum(x * x)), 6) + 0.0 AS gain_db,
round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) + 0.0 AS correlation, round(max(abs(y)), 6) + 0.0 AS peak, round(avg(CASE WHEN abs(y) >= 1 THEN 100.0 ELSE 0.0 END), 6) + 0.0 AS clipped_percent FROM p GROUP BY sig""")
def snr_gain_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _signal(spark, sf_dir).withColumn("y", companding.from_pcm16(companding.to_pcm16(F.col("x"))))
    out = metrics.quality(pairs, ["sig"])
    return out.select("sig", "n", rounded("snr_db", 4), *[rounded(c) for c in ("gain_db", "correlation", "peak", "clipped_percent")])


@query(_SIG + """, l AS (SELECT unnest(range(-6, 7))::INTEGER AS lag), y AS (SELECT sig, i + 3 AS i, -0.8 * x AS y FROM sig),
c AS (SELECT sig.sig, lag, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS c FROM sig, l JOIN y ON y.sig = sig.sig AND y.i = sig.i + l.lag GROUP BY sig.sig, lag)
SELECT sig, lag, round(c, 6) + 0.0 AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY round(abs(c), 12) DESC, lag) AS r FROM c) WHERE r = 1""")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _signal(spark, sf_dir)
    y = x.select("sig", (F.col("i") + 3).alias("i"), (F.col("x") * -0.8).alias("x"))
    return metrics.best_lag(x, y, list(range(-6, 7))).select("sig", "lag", rounded("correlation"))


@query(_SIG + """, v AS (SELECT DISTINCT sig, i // 32 AS frame FROM sig), k AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY frame) AS r FROM v WHERE frame % 5 <> 3) SELECT sig, frame FROM k WHERE r > 2""")
def priming_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, _ = framing.hop(N)
    frames = _signal(spark, sf_dir).select("sig", frame).distinct()
    return framing.valid_after_priming(frames, F.col("frame") % 5 != 3).select("sig", "frame")


@query(_SIG + "SELECT sig, round(max(abs(x)), 9) + 0.0 AS peak, max(abs(x)) <= 0.001 AS silent FROM sig GROUP BY sig")
def silence_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir).groupBy("sig").agg(F.max(F.abs("x")).alias("peak")).select("sig", rounded("peak", 9), (F.col("peak") <= 0.001).alias("silent"))
