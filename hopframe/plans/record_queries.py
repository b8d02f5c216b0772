"""Queries over modes, bit records and tagged containers, made from orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, companding
from ..sources import container, host
from . import modes
from .registry import query, table

_MODES = "modes(rate_class, kbps_ch, n, rate) AS (VALUES " + ", ".join(f"({m[0]}, {m[1]}, {m[2]}, { {k: r for k, r, _ in modes.RATES}[m[0]] })" for m in modes.MODES) + ")"
_REQUESTS = """req AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  [44100, 22050, 16000, 11025, 8000, 48000][(l_partkey % 6 + 1)::INTEGER] AS rate, (l_suppkey % 13 * 8)::INTEGER AS kbps, (l_partkey % 4)::INTEGER AS channels FROM lineitem)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.element_at(F.array(*[F.lit(r) for r in (44_100, 22_050, 16_000, 11_025, 8_000, 48_000)]), (F.col("l_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(rate.alias("rate"), (F.col("l_suppkey") % 13 * 8).cast("int").alias("kbps"), (F.col("l_partkey") % 4).cast("int").alias("channels"))


@query(f"""WITH {_MODES}, {_REQUESTS}
SELECT req.rate, kbps, channels, kbps_ch, n, (kbps * 1000::BIGINT * n // modes.rate)::BIGINT AS frame_bits, count(*) AS requests
FROM req LEFT JOIN modes ON req.rate = modes.rate AND channels BETWEEN 1 AND 2 AND kbps // nullif(channels, 0) = kbps_ch GROUP BY ALL""")
def mode_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _requests(spark, sf_dir).groupBy("rate", "kbps", "channels").agg(F.count("*").alias("requests"))
    return modes.exact_modes(counted).select("rate", "kbps", "channels", "kbps_ch", "n", "frame_bits", "requests")


@query(f"""WITH {_MODES}, {_REQUESTS}, asked AS (SELECT DISTINCT rate, kbps, channels FROM req),
w AS (SELECT *, CASE WHEN rate >= 32000 THEN 44 WHEN rate >= 18000 THEN 22 WHEN rate >= 14000 THEN 16 WHEN rate >= 10000 THEN 11 ELSE 8 END AS class, least(greatest(channels, 1), 2) AS ch FROM asked),
x AS (SELECT *, CASE WHEN kbps > 0 THEN kbps WHEN class = 44 THEN 96 WHEN class IN (22, 16) THEN 64 ELSE 32 END AS want FROM w),
best AS (SELECT x.rate, kbps, channels, modes.rate AS out_rate, kbps_ch * ch AS out_kbps, row_number() OVER (PARTITION BY x.rate, kbps, channels ORDER BY abs(kbps_ch * ch - want), kbps_ch * ch) AS r FROM x JOIN modes ON rate_class = class)
SELECT best.rate, best.kbps, best.channels, out_rate, out_kbps, count(*) AS requests FROM best JOIN req USING (rate, kbps, channels) WHERE r = 1 GROUP BY ALL""")
def mode_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _requests(spark, sf_dir).groupBy("rate", "kbps", "channels").agg(F.count("*").alias("requests"))
    return modes.nearest_modes(counted).select("rate", "kbps", "channels", "out_rate", "out_kbps", "requests")


_FULL = ", ".join(
    f"({m[0]}, {m[1]}, {m[2]}, {m[4][0] + m[4][1] + m[5] * m[4][2]}, {m[9] + m[7] + m[6]}, {m[7]}, {m[8]}, {ft}, {m[11][min(ft, 2)][0]}, {m[11][min(ft, 2)][2] * m[11][min(ft, 2)][3] + 1}, { {k: r for k, r, _ in modes.RATES}[m[0]] })"
    for m in modes.MODES
    for ft in range(4)
)
_PLAN = f"""m(rate_class, kbps_ch, n, lsp, ppc, shape_bit, shape_len, ftype, sub, bse, rate) AS (VALUES {_FULL}),
a AS (SELECT *, kbps_ch * ch * 1000 * n // rate AS frame_bits FROM m, (VALUES (1), (2)) c(ch)),
b AS (SELECT *, CASE WHEN ftype = 3 THEN ch * shape_bit WHEN ftype = 2 THEN frame_bits - (ch * (bse + lsp + ppc + 8) + 4) ELSE frame_bits - (ch * (lsp + 8) + 4 + sub * ch * (bse + 5)) END AS bits,
  CASE WHEN ftype = 3 THEN ch * shape_len ELSE ch * n END AS size, CASE WHEN ftype = 3 THEN ch ELSE ch * sub END AS blocks FROM a),
d AS (SELECT *, (bits + 13) // 14 AS nd FROM b),
plan AS (SELECT rate_class, kbps_ch, ch, ftype, frame_bits, bits, size, blocks, nd, (bits + nd - 1) // nd AS up, bits // nd AS dn, nd - ((bits + nd - 1) // nd * nd - bits) AS up_n,
  (size + nd - 1) // nd AS vu, size // nd AS vd, nd - ((size + nd - 1) // nd * nd - size) AS vu_n FROM d)"""
_PLAN_COLUMNS = ("rate_class", "kbps_ch", "ch", "ftype", "frame_bits", "bits", "size", "blocks", "nd", "up", "dn", "up_n", "vu", "vd", "vu_n")


@query(f"WITH {_PLAN} SELECT {', '.join(f'{c}::INTEGER AS {c}' for c in _PLAN_COLUMNS)} FROM plan")
def bit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.bit_plan(spark).select(*[F.col(c).cast("int").alias(c) for c in _PLAN_COLUMNS])


@query(f"""WITH {_PLAN}, g AS (SELECT plan.*, pos // nd AS i, pos % nd AS j FROM plan, range(4096) r(pos) WHERE pos < size),
t AS (SELECT *, i * nd + (j + CASE WHEN blocks = 1 OR (ftype = 2 AND nd % blocks <> 0) OR (ftype <> 2 AND nd % 2 = 1) OR i = vd THEN 0 WHEN ftype = 2 THEN i ELSE i * i END) % nd AS t FROM g)
SELECT rate_class::INTEGER AS rate_class, kbps_ch::INTEGER AS kbps_ch, ch::INTEGER AS ch, ftype::INTEGER AS ftype,
  (row_number() OVER (PARTITION BY rate_class, kbps_ch, ch, ftype ORDER BY j, i) - 1)::INTEGER AS place, (size // blocks * (t % blocks) + t // blocks)::INTEGER AS target FROM t""")
def perm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.permutations(spark)


_FIELDS = (("o_orderkey", 16), ("o_custkey", 9), ("extract(year from o_orderdate)::BIGINT", 12), ("extract(month from o_orderdate)::BIGINT", 4), ("extract(day from o_orderdate)::BIGINT", 5))


def _packed(orders: DataFrame) -> DataFrame:
    date = F.col("o_orderdate")
    fields = [(F.col("o_orderkey"), 16), (F.col("o_custkey"), 9), (F.year(date), 12), (F.month(date), 4), (F.dayofmonth(date), 5)]
    return orders.select("o_orderkey", bits.pack(fields).alias("packed"))


_PACKED = " + ".join(f"({c} & {(1 << b) - 1}) * {1 << sum(x for _, x in _FIELDS[k + 1 :])}::BIGINT" for k, (c, b) in enumerate(_FIELDS))


@query(f"SELECT o_orderkey, ({_PACKED})::BIGINT AS packed, upper(printf('%012x', ({_PACKED})::BIGINT)) AS bytes_hex FROM orders")
def bit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(table(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", "packed", F.hex(bits.be_bytes(F.col("packed"), 6)).alias("bytes_hex"))


@query("SELECT o_orderkey, " + ", ".join(f"({c} & {(1 << b) - 1})::BIGINT AS f{k}" for k, (c, b) in enumerate(_FIELDS)) + " FROM orders")
def bit_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(table(spark, sf_dir, "orders")).select("o_orderkey", bits.be_int(bits.be_bytes(F.col("packed"), 6), 1, 6).alias("packed"))
    return rows.select("o_orderkey", *[x.cast("long").alias(f"f{k}") for k, x in enumerate(bits.unpack(F.col("packed"), [b for _, b in _FIELDS]))])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for each document: format, five tags, an unknown chunk and the size."""
    d = table(spark, sf_dir, "documents")
    utf8 = lambda c: F.encode(c, "UTF-8")
    channels, kbps = (F.col("doc_id") % 2 + 1), F.col("doc_id") % 5 * 8 + 16
    rate = F.element_at(F.array(F.lit(44_100), F.lit(22_050), F.lit(16_000)), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.coalesce("text", F.lit(""))
    chunks = F.array(
        container.chunk("COMM", container.comm_payload(channels, kbps, rate)),
        container.chunk("NAME", utf8(name)), container.chunk("AUTH", utf8(F.col("source"))), container.chunk("GENR", utf8(F.col("lang"))),
        container.chunk("TRAC", bits.be_bytes(F.col("doc_id") % 30, 2)), container.chunk("YEAR", bits.be_bytes(F.col("doc_id") % 60 + 1960, 2)),
        container.chunk("TEST", utf8(F.col("doc_id").cast("string"))), container.chunk("DSIZ", bits.be_bytes(F.col("n_chars"), 4)),
    )
    return d.select(F.col("doc_id").alias("file"), container.header(chunks).alias("content"))


_DOC = "f AS (SELECT doc_id AS file, doc_id % 2 + 1 AS channels, doc_id % 5 * 8 + 16 AS kbps, [44100, 22050, 16000][(doc_id % 3 + 1)::INTEGER] AS rate, coalesce(text, '') AS name, source, lang, doc_id % 30 AS track, doc_id % 60 + 1960 AS year, n_chars FROM documents)"
_CHUNKS = _DOC + """, c AS (SELECT file, 0 AS chunk_no, 'COMM' AS id, upper(printf('%08x%08x%08x', channels - 1, kbps, CASE rate WHEN 44100 THEN 44 WHEN 22050 THEN 22 ELSE rate // 1000 END)) AS payload FROM f
UNION ALL SELECT file, 1, 'NAME', hex(encode(name)) FROM f UNION ALL SELECT file, 2, 'AUTH', hex(encode(source)) FROM f UNION ALL SELECT file, 3, 'GENR', hex(encode(lang)) FROM f
UNION ALL SELECT file, 4, 'TRAC', upper(printf('%04x', track)) FROM f UNION ALL SELECT file, 5, 'YEAR', upper(printf('%04x', year)) FROM f
UNION ALL SELECT file, 6, 'TEST', hex(encode(file::VARCHAR)) FROM f UNION ALL SELECT file, 7, 'DSIZ', upper(printf('%08x', n_chars)) FROM f)"""


@query(f"WITH {_CHUNKS} SELECT file, chunk_no::INTEGER AS chunk_no, id, payload FROM c")
def tlv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = container.exploded(container.parse(_files(spark, sf_dir)))
    return chunks.select("file", "chunk_no", "id", F.hex("payload").alias("payload"))


@query(f"""WITH {_MODES}, {_DOC} SELECT file, channels::BIGINT AS channels, kbps::BIGINT AS kbps, rate::BIGINT AS rate, n_chars::BIGINT AS data_size,
CASE WHEN NOT EXISTS (FROM modes m WHERE m.rate = f.rate AND m.kbps_ch = f.kbps // f.channels) THEN 'mode' END AS error FROM f""")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.header_fields(container.parse(_files(spark, sf_dir)))


@query(f"WITH {_DOC} SELECT file, name AS title, source AS artist, '' AS comment, '' AS copyright, '' AS album, lang AS genre, track::VARCHAR AS track, year::VARCHAR AS year, '' AS composer, '' AS publisher FROM f")
def tag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.pivot_tags(container.exploded(container.parse(_files(spark, sf_dir))))


@query(f"""WITH {_CHUNKS} SELECT file, 0::INTEGER AS chunk_no, id, payload FROM c WHERE id = 'COMM'
UNION ALL SELECT file, 1::INTEGER, 'NAME', hex(encode('T' || file::VARCHAR)) FROM f
UNION ALL SELECT file, 2::INTEGER, 'ALBM', hex(encode(source)) FROM f UNION ALL SELECT file, 3::INTEGER, 'TEST', payload FROM c WHERE id = 'TEST'
UNION ALL SELECT file, 4::INTEGER, 'DSIZ', payload FROM c WHERE id = 'DSIZ'""")
def tag_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = container.exploded(container.parse(_files(spark, sf_dir)))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("t"), "source")
    tags = d.select("file", F.explode(F.array(F.struct(F.lit("NAME").alias("id"), F.col("t").alias("value")), F.struct(F.lit("ALBM").alias("id"), F.col("source").alias("value")), F.struct(F.lit("YEAR").alias("id"), F.lit("").alias("value")))).alias("x")).select("file", "x.id", "x.value")
    return container.upsert_tags(chunks, tags).select("file", "chunk_no", "id", F.hex("payload").alias("payload"))


_SIZES = "s AS (SELECT o_orderkey AS file, (o_orderkey % 400 + 40)::BIGINT AS data_size, [371, 512, 743][(o_orderkey % 3 + 1)::INTEGER]::BIGINT AS frame_bits FROM orders)"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    size = F.element_at(F.array(F.lit(371), F.lit(512), F.lit(743)), (key % 3 + 1).cast("int")).cast("long")
    return table(spark, sf_dir, "orders").select(key.alias("file"), (key % 400 + 40).alias("data_size"), size.alias("frame_bits"))


@query(f"""WITH {_SIZES}, g AS (SELECT file, frame_bits, frame, frame * frame_bits AS first_bit FROM s, range(32) r(frame) WHERE frame < data_size * 8 // frame_bits)
SELECT file, frame::BIGINT AS frame, first_bit, first_bit // 8 AS byte, first_bit % 8 AS skip, (first_bit + frame_bits + 7) // 8 - first_bit // 8 AS n_bytes FROM g""")
def frame_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.frame_slices(_sized(spark, sf_dir))


@query("SELECT o_orderkey, (o_custkey * 371 - 700)::BIGINT AS bit, (100 + CASE WHEN o_custkey * 371 - 700 <= 0 THEN 0 ELSE greatest((o_custkey * 371 - 707) >> 3, 0) END)::BIGINT AS file_offset FROM orders")
def seek_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.col("o_custkey") * 371 - 700
    return table(spark, sf_dir, "orders").select("o_orderkey", bit.alias("bit"), container.seek_offset(bit, F.lit(100)).cast("long").alias("file_offset"))


@query("SELECT o_orderkey, ((o_custkey + o_orderkey % 97 // 2) // nullif(o_orderkey % 97, 0))::BIGINT AS ratio, CASE WHEN o_orderkey > 0 THEN bit_length(bin(o_orderkey)) // 8 - 1 END::INTEGER AS log2 FROM orders")
def integer_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", companding.rounded_div(F.col("o_custkey"), F.col("o_orderkey") % 97).alias("ratio"), companding.log2_int(F.col("o_orderkey")).alias("log2"))


@query("SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 1000 AS data_size, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE round(l_quantity::BIGINT * 1000 * 8 / (l_linenumber * 1000), 6) END + 0.0 AS seconds, count(*) AS n FROM lineitem GROUP BY ALL")
def duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("l_quantity").cast("long") * 1000
    kbps = F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("data_size"), (F.round(modes.duration_seconds(size, kbps), 6) + F.lit(0.0)).alias("seconds"))
    return rows.groupBy("l_orderkey", "l_linenumber", "data_size", "seconds").agg(F.count("*").alias("n"))


@query("""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.[^.]*$', ''), ''), 'track') || CASE WHEN page_id % 3 > 0 THEN '.' || (page_id % 3)::VARCHAR ELSE '' END || '.bin' AS name FROM pages""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", host.output_name(F.col("url"), F.col("page_id") % 3, "bin").alias("name"))


@query(f"""WITH {_MODES}, {_REQUESTS}, asked AS (SELECT DISTINCT rate, kbps, channels FROM req),
w AS (SELECT *, CASE WHEN rate >= 32000 THEN 44 WHEN rate >= 18000 THEN 22 WHEN rate >= 14000 THEN 16 WHEN rate >= 10000 THEN 11 ELSE 8 END AS class, least(greatest(channels, 1), 2) AS ch FROM asked)
SELECT w.rate, kbps, channels, coalesce(max(kbps_ch * ch) FILTER (kbps_ch * ch <= kbps), min(kbps_ch * ch))::INTEGER AS preselected FROM w JOIN modes ON rate_class = class GROUP BY ALL""")
def preselected_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requests(spark, sf_dir).distinct()
    return asked.select("rate", "kbps", "channels", host.preselected_kbps(F.col("rate"), F.col("channels"), F.col("kbps")).alias("preselected"))


@query(f"WITH {_DOC} SELECT file, name = 'T' || file::VARCHAR AS same FROM f")
def tag_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = container.pivot_tags(container.exploded(container.parse(_files(spark, sf_dir))))
    right = left.withColumn("title", F.concat(F.lit("T"), F.col("file").cast("string")))
    return host.same_tags(left, right)


@query("""WITH f AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'no data marker' WHEN doc_id % 11 = 0 THEN 'no container' END AS error FROM documents)
SELECT lang, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, array_to_string(list_sort(list_distinct(list(error) FILTER (error IS NOT NULL))), ', ') AS errors FROM f GROUP BY lang""")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    cut = F.expr("substring(content, 1, length(content) - 6)")
    content = F.when(F.col("file") % 7 == 0, cut).when(F.col("file") % 11 == 0, F.lit(b"XXXX")).otherwise(F.col("content"))
    parsed = container.parse(files.withColumn("content", content))
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "lang")
    out = host.batch_result(parsed.select("file", "error").join(lang, "file"), "lang")
    return out.select("lang", "ok", "failed", F.array_join("errors", ", ").alias("errors"))


@query(f"WITH {_DOC} SELECT file, (20 + 8 * 8 + 12 + strlen(name) + strlen(source) + strlen(lang) + 2 + 2 + strlen(file::VARCHAR) + 4)::BIGINT AS header_bytes FROM f")
def header_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.parse(_files(spark, sf_dir)).select("file", F.col("data_offset").cast("long").alias("header_bytes"))


_TEXT_CHUNK = "CASE WHEN {1} <> '' THEN hex('{0}') || printf('%08x', strlen({1})) || hex(encode({1})) ELSE '' END"


@query(f"""WITH {_DOC}, b AS (SELECT file, name, strlen(name) AS size, hex('COMM') || printf('%08x%08x%08x%08x', 12, channels - 1, kbps, CASE rate WHEN 44100 THEN 44 WHEN 22050 THEN 22 ELSE rate // 1000 END)
  || {_TEXT_CHUNK.format('NAME', 'name')} || {_TEXT_CHUNK.format('GENR', 'lang')} || hex('DSIZ') || printf('%08x%08x', 4, strlen(name)) AS chunks FROM f)
SELECT file, (20 + length(chunks) // 2 + size)::BIGINT AS n_bytes, sha1(unhex(hex('TWIN97012000') || printf('%08x', length(chunks) // 2) || chunks || hex('DATA') || hex(encode(name)))) AS digest FROM b""")
def file_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files: format, two tags, the size, and the text as data."""
    d = table(spark, sf_dir, "documents")
    rate = F.element_at(F.array(F.lit(44_100), F.lit(22_050), F.lit(16_000)), (F.col("doc_id") % 3 + 1).cast("int"))
    body = F.coalesce("text", F.lit(""))
    infos = d.select(F.col("doc_id").alias("file"), (F.col("doc_id") % 2 + 1).alias("channels"), (F.col("doc_id") % 5 * 8 + 16).alias("kbps"), rate.alias("rate"), F.lit(7).alias("data_size"), F.create_map(F.lit("genre"), F.col("lang"), F.lit("title"), body).alias("tags"))
    files = container.build(container.info_chunks(infos), d.select(F.col("doc_id").alias("file"), F.encode(body, "UTF-8").alias("data")))
    return files.select("file", F.octet_length("content").cast("long").alias("n_bytes"), F.sha1("content").alias("digest"))


@query(f"""WITH {_DOC}, s AS (SELECT file, [371, 512, 743][(file % 3 + 1)::INTEGER]::BIGINT AS frame_bits, hex(encode(name)) AS h, strlen(name) AS size FROM f),
g AS (SELECT file, h, frame_bits, unnest(range(size * 8 // frame_bits)) AS frame FROM s)
SELECT file, frame::BIGINT AS frame, frame * frame_bits % 8 AS skip, substring(h, (frame * frame_bits // 8 * 2 + 1)::BIGINT, (((frame * frame_bits + frame_bits + 7) // 8 - frame * frame_bits // 8) * 2)::BIGINT) AS record FROM g""")
def data_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of files whose data are texts, cut at whole frames."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.element_at(F.array(F.lit(371), F.lit(512), F.lit(743)), (F.col("doc_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit(b"TWIN"), body).alias("content"), F.lit(4).alias("data_offset"), F.octet_length(body).alias("data_size"), size.alias("frame_bits"))
    return container.packets(files).select("file", "frame", "skip", F.hex("record").alias("record"))
