"""Coding modes: the table of frame layouts, mode lookup, bit plans and permutations, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values, a row for each mode: rate class in kHz, kbit/s of a channel, frame length, prediction order, bits of the
#: three frequency codebooks, their split, pitch period bits, pitch shape bits, pitch shape length, pitch gain bits, peak
#: width, and for short, medium and long frames: blocks, band envelope size, coefficients, bits and codebook length.
MODES = (
    (8, 8, 512, 12, (1, 5, 3), 3, 8, 28, 20, 6, 40, ((8, 10, 1, 5, 18), (2, 20, 2, 5, 16), (1, 30, 3, 6, 17))),
    (11, 8, 512, 16, (1, 6, 4), 3, 9, 36, 30, 7, 90, ((8, 10, 1, 5, 29), (2, 20, 2, 5, 24), (1, 30, 3, 6, 27))),
    (11, 10, 512, 16, (1, 6, 4), 3, 9, 36, 30, 7, 90, ((8, 10, 1, 5, 21), (2, 20, 2, 5, 18), (1, 30, 3, 6, 20))),
    (16, 16, 1024, 16, (1, 6, 4), 3, 9, 56, 60, 7, 180, ((8, 10, 1, 5, 16), (2, 20, 2, 5, 15), (1, 30, 3, 6, 16))),
    (22, 20, 1024, 16, (1, 6, 4), 3, 9, 56, 36, 7, 144, ((8, 10, 1, 6, 18), (2, 20, 2, 6, 17), (1, 32, 4, 6, 18))),
    (22, 24, 1024, 16, (1, 6, 4), 3, 9, 56, 36, 7, 144, ((8, 10, 1, 6, 15), (2, 20, 2, 6, 14), (1, 32, 4, 6, 15))),
    (22, 32, 512, 16, (1, 6, 4), 4, 9, 56, 36, 7, 72, ((4, 10, 1, 6, 11), (2, 20, 2, 6, 11), (1, 32, 4, 6, 12))),
    (44, 40, 2048, 20, (1, 6, 4), 4, 9, 84, 54, 7, 432, ((16, 10, 1, 6, 18), (4, 20, 2, 6, 17), (1, 40, 4, 6, 17))),
    (44, 48, 2048, 20, (1, 6, 4), 4, 9, 84, 54, 7, 432, ((16, 10, 1, 6, 15), (4, 20, 2, 6, 14), (1, 40, 4, 6, 14))),
)
#: Sample rate of each rate class, and the lowest rate that goes to it.
RATES = ((44, 44_100, 32_000), (22, 22_050, 18_000), (16, 16_000, 14_000), (11, 11_025, 10_000), (8, 8_000, 0))
FRAME_TYPES = ("short", "medium", "long", "pitch")


def mode_table(spark: SparkSession) -> DataFrame:
    """The modes, with the sample rate; fmodes is an array for short, medium and long frames."""
    rates = {k: r for k, r, _ in RATES}
    schema = "rate_class int, kbps_ch int, n int, n_lsp int, lsp_bits array<int>, lsp_split int, ppc_period_bit int, ppc_shape_bit int, ppc_shape_len int, pgain_bit int, peak_per2wid int, fmodes array<struct<sub:int, bark_env_size:int, bark_n_coef:int, bark_n_bit:int, cb_len:int>>, rate int"
    return spark.createDataFrame([(*m[:4], list(m[4]), *m[5:11], list(m[11]), rates[m[0]]) for m in MODES], schema)


def rate_class(rate: Column, exact: bool = False) -> Column:
    """Class of a sample rate: of just the modes' own rates, or the nearest class from below."""
    out = F.lit(None).cast("int")
    for k, own, least in reversed(RATES):
        out = F.when(rate == own if exact else rate >= least, k).otherwise(out)
    return out


def exact_modes(requests: DataFrame) -> DataFrame:
    """requests (rate, kbps, channels) with kbps_ch, n and frame_bits of their mode, null where there is none."""
    m = mode_table(requests.sparkSession).select(F.col("rate_class").alias("__c"), F.col("kbps_ch").alias("__k"), "kbps_ch", "n", F.col("rate").alias("__r"))
    per = F.when(F.col("channels").between(1, 2), F.call_function("div", F.col("kbps"), F.col("channels")))
    joined = requests.join(F.broadcast(m), (rate_class(F.col("rate"), exact=True) == F.col("__c")) & (per == F.col("__k")), "left")
    bits = F.call_function("div", F.col("kbps").cast("long") * 1000 * F.col("n"), F.col("__r"))
    return joined.withColumn("frame_bits", bits).drop("__c", "__k", "__r")


def nearest_modes(requests: DataFrame) -> DataFrame:
    """requests with out_rate and out_kbps: of the modes of the rate's class that whose total is nearest to kbps, the lower
    on ties; channels are held within 1 and 2, and kbps of 0 or less asks for 96, 64 or 32 by class."""
    spark = requests.sparkSession
    ch = F.least(F.greatest(F.col("channels"), F.lit(1)), F.lit(2))
    c = rate_class(F.col("rate"))
    want = F.when(F.col("kbps") > 0, F.col("kbps")).when(c == 44, 96).when(c.isin(22, 16), 64).otherwise(32)
    asked = requests.withColumns({"__class": c, "__ch": ch, "__want": want})
    by_class: dict[int, list[int]] = {}
    for m in MODES:
        by_class.setdefault(m[0], []).append(m[1])
    best = F.lit(None).cast("int")
    for k, per in by_class.items():
        choices = F.array(*[F.struct(F.abs(F.col("__ch") * p - F.col("__want")).alias("d"), (F.col("__ch") * p).alias("t")) for p in per])
        best = F.when(F.col("__class") == k, F.array_min(choices)["t"]).otherwise(best)
    rates = spark.createDataFrame([(k, r) for k, r, _ in RATES], "__k int, out_rate int")
    out = asked.withColumn("out_kbps", best).join(F.broadcast(rates), F.col("__class") == F.col("__k"))
    return out.drop("__class", "__ch", "__want", "__k")


def bit_plan(spark: SparkSession) -> DataFrame:
    """A row for each mode, number of channels and frame type: bits, vectors, and how both are dealt to the vectors.

    nd vectors share the bits that overhead leaves, 14 at most to each: up_n of them get up bits and the others dn; the
    two codebooks get the larger and the smaller half. Likewise vu_n vectors have vu values and the others vd.
    """
    div = lambda a, b: F.call_function("div", a, b)
    ch = F.explode(F.array(F.lit(1), F.lit(2))).alias("ch")
    m = mode_table(spark).select("*", ch)
    m = m.withColumn("frame_bits", div(F.col("kbps_ch") * F.col("ch") * 1000 * F.col("n"), F.col("rate")).cast("int"))
    lsp = F.col("ch") * (F.col("lsp_bits")[0] + F.col("lsp_bits")[1] + F.col("lsp_split") * F.col("lsp_bits")[2])
    ppc = F.col("ch") * (F.col("pgain_bit") + F.col("ppc_shape_bit") + F.col("ppc_period_bit"))
    m = m.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("ftype"))
    f = F.col("fmodes")[F.least("ftype", F.lit(2))]
    bse = F.col("ch") * (f["bark_n_coef"] * f["bark_n_bit"] + 1)
    overhead = F.when(F.col("ftype") == 2, bse + lsp + ppc + 4 + 8 * F.col("ch")).otherwise(lsp + 8 * F.col("ch") + 4 + f["sub"] * (bse + 5 * F.col("ch")))
    pitch = F.col("ftype") == 3
    m = m.withColumn("bits", F.when(pitch, F.col("ch") * F.col("ppc_shape_bit")).otherwise(F.col("frame_bits") - overhead))
    m = m.withColumn("size", F.when(pitch, F.col("ch") * F.col("ppc_shape_len")).otherwise(F.col("ch") * F.col("n")))
    m = m.withColumn("blocks", F.when(pitch, F.col("ch")).otherwise(F.col("ch") * f["sub"]))
    m = m.withColumn("nd", div(F.col("bits") + 13, F.lit(14)).cast("int"))
    up, vu = F.ceil(F.col("bits") / F.col("nd")).cast("int"), F.ceil(F.col("size") / F.col("nd")).cast("int")
    m = m.withColumns({"up": up, "vu": vu, "dn": div(F.col("bits"), F.col("nd")).cast("int"), "vd": div(F.col("size"), F.col("nd")).cast("int")})
    m = m.withColumns({"up_n": F.col("nd") - (F.col("up") * F.col("nd") - F.col("bits")), "vu_n": F.col("nd") - (F.col("vu") * F.col("nd") - F.col("size"))})
    return m.select("rate_class", "kbps_ch", "ch", "ftype", "frame_bits", "bits", "size", "blocks", "nd", "up", "dn", "up_n", "vu", "vd", "vu_n")


def permutations(spark: SparkSession) -> DataFrame:
    """(rate_class, kbps_ch, ch, ftype, place, target): where each value of the concatenated vectors stands in the frame.

    Values are dealt to the nd vectors row by row, each row turned by a shift; vectors are then read one after the other,
    and a value's number t goes to block t mod blocks.
    """
    div = lambda a, b: F.call_function("div", a, b)
    m = bit_plan(spark).select("rate_class", "kbps_ch", "ch", "ftype", "size", "blocks", "nd", "vu", "vd", "vu_n")
    rows = m.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
    rows = rows.withColumns({"row": div(F.col("at"), F.col("nd")).cast("int"), "vector": (F.col("at") % F.col("nd")).cast("int")})
    long = F.col("ftype") == 2
    still = (F.col("blocks") == 1) | (long & (F.col("nd") % F.col("blocks") != 0)) | (~long & (F.col("nd") % 2 == 1)) | (F.col("row") == F.col("vd"))
    shift = F.when(still, 0).when(long, F.col("row")).otherwise(F.col("row") * F.col("row"))
    t = F.col("row") * F.col("nd") + (F.col("vector") + shift) % F.col("nd")
    block = div(F.col("size"), F.col("blocks")).cast("int")
    place = F.row_number().over(Window.partitionBy("rate_class", "kbps_ch", "ch", "ftype").orderBy("vector", "row")) - 1
    return rows.select("rate_class", "kbps_ch", "ch", "ftype", place.cast("int").alias("place"), (block * (t % F.col("blocks")) + div(t, F.col("blocks")).cast("int")).cast("int").alias("target"))


def duration_seconds(data_size: Column, kbps: Column) -> Column:
    return F.when(kbps > 0, data_size * 8 / (kbps * 1000)).otherwise(0.0)
