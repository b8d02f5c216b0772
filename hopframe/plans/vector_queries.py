"""Queries over embeddings as vectors, with codebooks taken from the same table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import framing, lpc, vq
from .registry import query, rounded, table

ORDER, SPLIT, WIDTHS = 12, 3, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]

_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_DIST = "list_sum(list_transform(range(1, {n} + 1), lambda j: power({a}[j] - {b}[j], 2)))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _book(vectors: DataFrame, low: int, high: int, n: int = 64) -> tuple:
    rows = vectors.where((F.col("vec_id") >= low) & (F.col("vec_id") < high))
    return vq.load_codebook(rows.select("vec_id", F.slice("v", 1, n).alias("v")), "vec_id", "v")


_ERR = _V + ", d AS (SELECT a.vec_id, b.vec_id AS code, " + _DIST.format(n=64, a="a.e", b="b.e") + " AS err FROM v a JOIN v b ON b.vec_id < 64)"


@query(_ERR + "SELECT vec_id, code, round(err, 6) + 0.0 AS err FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, code) AS r FROM d) WHERE r = 1")
def vq_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vq.nearest(v, _book(v, 0, 64), ["vec_id"]).select("vec_id", "code", rounded("err"))


@query(_ERR + "SELECT vec_id, (r - 1)::INTEGER AS slot, code, round(err, 6) + 0.0 AS err FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, code) AS r FROM d) WHERE r <= 4")
def vq_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vq.nearest(v, _book(v, 0, 64), ["vec_id"], k=4).select("vec_id", "slot", "code", rounded("err"))


_W16 = "list_sum(list_transform(range(1, 17), lambda j: w[j] * power({x}[j] - sg * {c}[j], 2)))"


_TWO_STAGE = f"""{_V[5:]}, t AS (SELECT vec_id, e[1:16] AS x, list_transform(e[1:16], lambda u: 1 + abs(u)) AS w0 FROM v),
x AS (SELECT vec_id, x, list_transform(w0, lambda u: u / list_max(w0)) AS w FROM t), sg AS (SELECT * FROM (VALUES (0, 1), (1, -1)) s(o, sg)),
one AS (SELECT x.vec_id, x.x, w, c.vec_id AS code0, sg.o AS o0, sg AS sign0, c.e AS c0, {_W16.format(x="x.x", c="c.e")} AS err FROM x, sg JOIN v c ON c.vec_id < 32),
beam AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, code0, o0) AS slot FROM one QUALIFY slot <= 4),
rest AS (SELECT vec_id, x, w, slot, code0, sign0, list_transform(range(1, 17), lambda j: x[j] - sign0 * c0[j]) AS y FROM beam),
two AS (SELECT rest.vec_id, x, w, slot, code0, sign0, c.vec_id AS code1, sg.o AS o1, sg AS sign1, {_W16.format(x="rest.y", c="c.e")} AS err FROM rest, sg JOIN v c ON c.vec_id >= 32 AND c.vec_id < 64),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, slot, code1, o1) AS r FROM two) WHERE r = 1)"""


@query(f"WITH {_TWO_STAGE} SELECT vec_id, code0, sign0::INTEGER AS sign0, code1, sign1::INTEGER AS sign1, round(err, 6) + 0.0 AS err FROM best")
def vq_two_stage_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    short = v.select("vec_id", F.slice("v", 1, 16).alias("v"))
    out = vq.quantize_two_stage(short, _book(v, 0, 32, 16), _book(v, 32, 64, 16), ["vec_id"], weight=lambda x: 1 + np.abs(x), passes=0)
    return out.select("vec_id", "code0", "sign0", "code1", "sign1", rounded("err"))


def _refined_sql(passes: int) -> str:
    """Each stage searched again with the other held; the earlier choice stays unless the error gets smaller."""
    steps, last = [], "best"
    for k in range(passes):
        for stage, held in ((0, 1), (1, 0)):
            own = "c.vec_id < 32" if stage == 0 else "c.vec_id >= 32 AND c.vec_id < 64"
            name = f"s{k}_{stage}"
            steps.append(f"""{name}r AS (SELECT b.vec_id, b.x, b.w, list_transform(range(1, 17), lambda j: b.x[j] - b.sign{held} * h.e[j]) AS y, b.code0, b.sign0, b.code1, b.sign1, b.err FROM {last} b JOIN v h ON h.vec_id = b.code{held}),
{name}t AS (SELECT r.*, c.vec_id AS code, sg, o, {_W16.format(x="r.y", c="c.e")} AS e2 FROM {name}r r, sg JOIN v c ON {own}),
{name} AS (SELECT vec_id, x, w, {', '.join(f'CASE WHEN e2 < err THEN {n} ELSE {c}{stage} END AS {c}{stage}' for c, n in (('code', 'code'), ('sign', 'sg')))}, code{held}, sign{held}, least(err, e2) AS err
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e2, code, o) AS r FROM {name}t) WHERE r = 1)""")
            last = name
    return ", ".join(steps) + f" SELECT vec_id, code0, sign0::INTEGER AS sign0, code1, sign1::INTEGER AS sign1, round(err, 6) + 0.0 AS err FROM {last}"


@query(f"WITH {_TWO_STAGE}, " + _refined_sql(2))
def vq_two_stage_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    short = v.select("vec_id", F.slice("v", 1, 16).alias("v"))
    out = vq.quantize_two_stage(short, _book(v, 0, 32, 16), _book(v, 32, 64, 16), ["vec_id"], weight=lambda x: 1 + np.abs(x))
    return out.select("vec_id", "code0", "sign0", "code1", "sign1", rounded("err"))


_ENDS = vq.split_ends(ORDER, SPLIT)


@query(_V + f""", s AS (SELECT * FROM (VALUES {', '.join(f'({k}, {lo}, {hi})' for k, (lo, hi) in enumerate(zip([0, *_ENDS], _ENDS, strict=False)))}) t(segment, lo, hi)),
d AS (SELECT a.vec_id, segment, b.vec_id AS code, list_sum(list_transform(range(lo + 1, hi + 1), lambda j: power(a.e[j] - b.e[j], 2))) AS err FROM v a, s JOIN v b ON b.vec_id < 16)
SELECT vec_id, segment::INTEGER AS segment, code, round(err, 6) + 0.0 AS err FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, segment ORDER BY err, code) AS r FROM d) WHERE r = 1""")
def split_vq(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    short = v.select("vec_id", F.slice("v", 1, ORDER).alias("v"))
    return vq.split_codes(short, _book(v, 0, 16, ORDER), _ENDS, ["vec_id"]).select("vec_id", "segment", "code", rounded("err"))


@query(_ERR + """, n AS (SELECT vec_id, code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY err, code) AS r FROM d) WHERE r = 1)
SELECT n.vec_id, n.code, round(greatest(0.0, list_dot_product(a.e, b.e) / list_dot_product(b.e, b.e)), 6) + 0.0 AS factor FROM n JOIN v a ON a.vec_id = n.vec_id JOIN v b ON b.vec_id = n.code""")
def ls_gain_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    best = vq.nearest(v, _book(v, 0, 64), ["vec_id", "v"])
    codes = v.where("vec_id < 64").select(F.col("vec_id").alias("code"), F.col("v").alias("y"))
    joined = best.join(F.broadcast(codes), "code")  # the codebook: 64 rows
    return joined.select("vec_id", "code", vq.gain_fit(F.col("v"), F.col("y")).alias("factor")).select("vec_id", "code", rounded("factor"))


@query(_V + f""", b AS (SELECT * FROM (VALUES {', '.join(f'({i + 1}, {w}, {sum(WIDTHS[:i])})' for i, w in enumerate(WIDTHS))}) t(band, width, start)),
x AS (SELECT vec_id, start, width, CASE WHEN e[band] * 8 + 1 < -1 THEN 1.0 ELSE e[band] * 8 + 1 END AS value FROM v, b)
SELECT vec_id, (start + k)::INTEGER AS bin, round(value, 6) + 0.0 AS value FROM x, range(10) r(k) WHERE k < width""")
def bark_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    values = F.transform(F.slice("v", 1, len(WIDTHS)), lambda x: vq.band_value(x * 8))
    return v.select("vec_id", F.posexplode(vq.expand_bands(values, WIDTHS)).alias("bin", "value")).select("vec_id", "bin", rounded("value"))


@query(_V + """, x AS (SELECT vec_id, label, band::INTEGER AS band, e[band + 1] * 8 AS now FROM v, range(10) r(band)),
h AS (SELECT *, lag(now, 1, 0.1) OVER (PARTITION BY label, band ORDER BY vec_id) AS before FROM x)
SELECT vec_id, band, round(CASE WHEN 0.72 * now + 0.28 * before + 1 < -1 THEN 1.0 ELSE 0.72 * now + 0.28 * before + 1 END, 6) + 0.0 AS value FROM h""")
def bark_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("vec_id", "label", F.transform(F.slice("v", 1, 10), lambda x: x * 8).alias("now"))
    beside = framing.previous(v, ["label"], "vec_id", ["now"])
    before = F.coalesce("before.now", F.array_repeat(F.lit(0.1), 10))
    value = F.zip_with("now", before, lambda a, b: vq.band_value(a, b, 0.28))
    return beside.select("vec_id", F.posexplode(value).alias("band", "value")).select("vec_id", "band", rounded("value"))


def _raw(e: str) -> str:
    return f"list_transform(range({ORDER}), lambda j: (j + 1) * pi() / {ORDER + 1} + 0.8 * {e}[j + 1])"


def _spread_sql(least: float, source: str = "raw", name: str = "spread", order: int = ORDER, key: str = "vec_id") -> str:
    """From source(key, l): one column for each place, as the pass goes up; then the finished list, in name."""
    steps = [f"{name}0 AS (SELECT {key}, {', '.join(f'l[{j + 1}] AS l{j}' for j in range(order))}, l[1] AS u FROM {source})"]
    for i in range(1, order):
        done = "".join(f"o{j}, " for j in range(i - 1))
        rest = "".join(f", l{j}" for j in range(i + 1, order))
        near = f"l{i} - u < {least}"
        steps.append(f"{name}{i} AS (SELECT {key}, {done}CASE WHEN {near} THEN (u + l{i}) / 2 - {least / 2} ELSE u END AS o{i - 1}, CASE WHEN {near} THEN (u + l{i}) / 2 + {least / 2} ELSE l{i} END AS u{rest} FROM {name}{i - 1})")
    return ", ".join(steps) + f", {name} AS (SELECT {key}, [{', '.join(f'o{j}' for j in range(order - 1))}, u] AS l FROM {name}{order - 1})"


_SPREAD = _V + f", raw AS (SELECT vec_id, {_raw('e')} AS l FROM v), " + _spread_sql(0.05)


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    raw = F.transform(F.sequence(F.lit(0), F.lit(ORDER - 1)), lambda j: (j + 1) * (math.pi / (ORDER + 1)) + 0.8 * F.col("v")[j])
    return v.select("vec_id", "label", raw.alias("l"))


@query(_SPREAD + "SELECT vec_id, j::INTEGER AS j, round(l[j + 1], 6) + 0.0 AS lsp FROM spread, range(12) r(j)")
def lsp_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frequencies(spark, sf_dir).select("vec_id", F.posexplode(lpc.spread_column(F.col("l"), 0.05)).alias("j", "lsp"))
    return rows.select("vec_id", "j", rounded("lsp"))


@query(_SPREAD + "SELECT vec_id, j::INTEGER AS j, round(list_sort(l)[j + 1], 6) + 0.0 AS lsp FROM spread, range(12) r(j)")
def lsp_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frequencies(spark, sf_dir).select("vec_id", F.posexplode(F.array_sort(lpc.spread_column(F.col("l"), 0.05))).alias("j", "lsp"))
    return rows.select("vec_id", "j", rounded("lsp"))


@query(_SPREAD + """, c AS (SELECT vec_id, bin::INTEGER AS bin, cos((2 * bin + 1) * pi() / 32) AS c, list_sort(l) AS l FROM spread, range(16) r(bin)),
pq AS (SELECT vec_id, bin, c, 0.5 * list_product(list_transform([1, 3, 5, 7, 9, 11], lambda j: 2 * cos(l[j]) - 2 * c)) AS q, 0.5 * list_product(list_transform([2, 4, 6, 8, 10, 12], lambda j: 2 * cos(l[j]) - 2 * c)) AS p FROM c)
SELECT vec_id, bin, round(log10(0.5 / (p * p * (2 - 2 * c) + q * q * (2 + 2 * c))), 5) + 0.0 AS log_envelope FROM pq""")
def lpc_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frequencies(spark, sf_dir).select("vec_id", F.array_sort(lpc.spread_column(F.col("l"), 0.05)).alias("l"))
    rows = rows.select("vec_id", "l", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("bin"))
    value = lpc.envelope_column(F.col("l"), F.cos((2 * F.col("bin") + 1) * (math.pi / 32)))
    return rows.select("vec_id", "bin", F.log10(value).alias("log_envelope")).select("vec_id", "bin", rounded("log_envelope", 5))


@query(_SPREAD + """, b AS (SELECT s.vec_id, v.label, j::INTEGER AS j, s.l[j + 1] AS now FROM spread s JOIN v USING (vec_id), range(12) r(j)),
h AS (SELECT *, lag(now, 1, 0.0) OVER (PARTITION BY label, j ORDER BY vec_id) AS before FROM b),
mixed AS (SELECT vec_id, list(now * 0.7 + before * 0.3 ORDER BY j) AS l FROM h GROUP BY vec_id), """ + _spread_sql(1e-4, "mixed", "once") + ", " + _spread_sql(9.5e-5, "once", "twice") + " SELECT vec_id, j::INTEGER AS j, round(list_sort(l)[j + 1], 6) + 0.0 AS lsp FROM twice, range(12) r(j)")
def lsp_history_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies blended with those of the row before of the label, spread twice and sorted."""
    rows = _frequencies(spark, sf_dir).select("vec_id", "label", lpc.spread_column(F.col("l"), 0.05).alias("now"))
    beside = framing.previous(rows, ["label"], "vec_id", ["now"]).select("vec_id", lpc.blended(F.col("now"), F.col("before.now"), 0.3).alias("lsp"))
    return beside.select("vec_id", F.posexplode("lsp").alias("j", "lsp")).select("vec_id", "j", rounded("lsp"))
