"""Tagged binary containers: a magic, a version, the header's size, chunks of (id, size, payload), then a data marker.

Everything is column expressions over a BINARY column; a bad file gives an error text, never a failed job."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import be_bytes, be_int
from ..plans.modes import MODES, RATES

#: Fixed values of the format.
MAGIC, VERSIONS, DATA = "TWIN", ("97012000", "00052200"), "DATA"
#: Chunk id of each tag, in the order in which tags are written; a track number has a second id.
TAGS = (("title", "NAME"), ("artist", "AUTH"), ("comment", "COMT"), ("copyright", "(c) "), ("album", "ALBM"), ("genre", "GENR"), ("track", "TRCK"), ("year", "YEAR"), ("composer", "MUSC"), ("publisher", "LABL"))
ALIASES = {"TRAC": "TRCK"}


def text(payload: Column) -> Column:
    return F.decode(payload, "UTF-8")


def chunk(name: Column | str, payload: Column) -> Column:
    """A chunk's bytes."""
    head = F.encode(F.lit(name) if isinstance(name, str) else name, "UTF-8")
    return F.concat(head, be_bytes(F.octet_length(payload), 4), payload)


def comm_payload(channels: Column, kbps: Column, rate: Column) -> Column:
    """Channels - 1, kbit/s, a flag for the rate (44, 22, 11 for the odd rates, else kHz)."""
    flag = F.when(rate == 44_100, 44).when(rate == 22_050, 22).when(rate == 11_025, 11).otherwise(F.call_function("div", rate, F.lit(1000)))
    return F.concat(be_bytes(channels - 1, 4), be_bytes(kbps, 4), be_bytes(flag, 4))


def header(chunks: Column, version: str = VERSIONS[0]) -> Column:
    """Header bytes of an array of chunks' bytes, up to the data marker; the size counts the chunks."""
    body = F.aggregate(chunks, F.lit(b""), lambda a, c: F.concat(a, c))
    lead = F.concat(F.encode(F.lit(MAGIC), "UTF-8"), F.encode(F.rpad(F.lit(version), 8, "0"), "UTF-8"), be_bytes(F.octet_length(body), 4))
    return F.concat(lead, body, F.encode(F.lit(DATA), "UTF-8"))


def _once(value: Column) -> Column:
    """value, a row of its own: as a plain column the optimizer would repeat it wherever it is read, and what reads that."""
    return F.explode(F.array(value))


def read(spark: SparkSession, paths: str) -> DataFrame:
    """(file, content) of the files that Spark finds at paths, a URI or a pattern."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")


def parse(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """keep, version, chunks array<struct<chunk_no, id, payload>>, data_offset, error.

    The header's size bounds its chunks, of any number: once they take more than it says, there is no data marker. That and
    a chunk that reaches past the file are errors; then chunks has what came before, and data_offset is null.
    """
    c = F.col(content)
    size, said = F.octet_length(c), be_int(c, 13, 4)
    start = F.struct(F.lit(17).cast("long").alias("at"), said.cast("long").alias("left"), F.array().cast("array<struct<chunk_no:int,id:string,payload:binary>>").alias("chunks"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("error"))

    def step(s: Column, k: Column) -> Column:
        name = text(F.substring(c, s["at"].cast("int"), F.lit(4)))
        n = be_int(c, (s["at"] + 4).cast("int"), 4)
        past = (s["left"] < 0) | (s["at"] + 7 > size) | (s["at"] + 7 + n > size)
        one = F.struct(k.cast("int").alias("chunk_no"), name.alias("id"), F.substring(c, (s["at"] + 8).cast("int"), n.cast("int")).alias("payload"))
        stop, at_data = s["done"] | s["error"].isNotNull(), (s["left"] >= 0) & (name == DATA)
        return F.struct(
            F.when(stop, s["at"]).when(at_data, s["at"] + 4).when(past, s["at"]).otherwise(s["at"] + 8 + n).alias("at"),
            F.when(stop | at_data | past, s["left"]).otherwise(s["left"] - 8 - n).alias("left"),
            F.when(stop | at_data | past, s["chunks"]).otherwise(F.concat(s["chunks"], F.array(one))).alias("chunks"),
            (s["done"] | (~stop & at_data)).alias("done"),
            F.when(stop | at_data, s["error"]).when(past, F.lit("no data marker")).alias("error"),
        )

    # a chunk takes 8 bytes at least, of the header and of the file
    most = F.call_function("div", F.greatest(F.coalesce(F.least(said, size), F.lit(0)), F.lit(0)), F.lit(8)).cast("int")
    walked = F.aggregate(F.sequence(F.lit(0), most), start, step)
    version = text(F.substring(c, 5, 8))
    bad = F.when(c.isNull() | (size < 16) | (text(F.substring(c, 1, 4)) != MAGIC), "no container").when(~version.isin(*VERSIONS), "unknown version").when(said > 0x7FFFFFFF, "header size")
    out = files.select(*keep, version.alias("version"), bad.alias("b"), _once(walked).alias("w"))
    error = F.coalesce("b", "w.error", F.when(~F.col("w.done"), F.lit("no data marker")))
    return out.select(*keep, "version", F.when(F.col("b").isNull(), F.col("w.chunks")).alias("chunks"), F.when(error.isNull(), F.col("w.at") - 1).alias("data_offset"), error.alias("error"))


def exploded(parsed: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keep, chunk_no, id, payload) of parse()."""
    # the outer form, as the plain one makes the optimizer repeat the whole walk in a filter below
    rows = parsed.select(*keep, F.explode_outer("chunks").alias("c")).where("c is not null")
    return rows.select(*keep, "c.chunk_no", "c.id", "c.payload")


def tag_value(name: Column, payload: Column, compat: bool = False) -> Column:
    """A tag's text: a two-byte track is a number, unless it is two digits and compat is off; a year of 2 to 4 bytes is a
    number if that is between 1 and 2999; all else is text."""
    n = F.octet_length(payload)
    number = F.coalesce(be_int(payload, 1, 2), F.lit(0))
    digits = F.lit(False) if compat else F.coalesce(text(payload).rlike(r"\A[0-9]{2}\z"), F.lit(False))
    whole = F.conv(F.hex(payload), 16, 10).cast("long")
    year = F.when(n.between(2, 4) & (whole > 0) & (whole < 3000), whole.cast("string"))
    return F.when((name == "TRCK") & (n == 2) & ~digits, number.cast("string")).when(name == "YEAR", F.coalesce(year, text(payload))).otherwise(text(payload))


def canonical(name: Column) -> Column:
    for other, own in ALIASES.items():
        name = F.when(name == other, own).otherwise(name)
    return name


def pivot_tags(chunks: DataFrame, keep: str = "file") -> DataFrame:
    """A row for each file with a column for each tag; the last chunk of a tag counts, a missing one is the empty text."""
    rows = chunks.withColumn("id", canonical(F.col("id"))).where(F.col("id").isin(*[i for _, i in TAGS]))
    last = rows.groupBy(keep, "id").agg(F.max_by("payload", "chunk_no").alias("payload"))
    value = tag_value(F.col("id"), F.col("payload"))
    return last.groupBy(keep).agg(*[F.coalesce(F.max(F.when(F.col("id") == i, value)), F.lit("")).alias(t) for t, i in TAGS])


def upsert_tags(chunks: DataFrame, tags: DataFrame, keep: str = "file", strip_all: bool = False) -> DataFrame:
    """(keep, chunk_no, id, payload) with new tags: the last COMM chunk, then tags (keep, id, value) that are not empty in
    their order (none with strip_all), then unknown chunks in theirs, then the data's size as the last size chunk has it (0
    without one), numbered anew; old tags go."""
    known = [i for _, i in TAGS]
    order = F.lit(len(known))
    for k, i in enumerate(known):
        order = F.when(F.col("id") == i, k).otherwise(order)
    last = lambda name: F.max_by(F.when(F.col("id") == name, F.col("payload")), F.when(F.col("id") == name, F.col("chunk_no")))
    ends = chunks.groupBy(keep).agg(last("COMM").alias("comm"), last("DSIZ").alias("dsiz"))
    data_size = F.coalesce(F.when(F.octet_length("dsiz") >= 4, be_int(F.col("dsiz"), 1, 4)), F.lit(0))
    both = F.array(F.struct(F.lit(0).alias("a"), F.lit("COMM").alias("id"), F.col("comm").alias("payload")), F.struct(F.lit(3).alias("a"), F.lit("DSIZ").alias("id"), be_bytes(data_size, 4).alias("payload")))
    ends = ends.select(keep, F.explode(both).alias("x")).where("x.payload is not null").select(keep, "x.a", F.lit(0).alias("b"), "x.id", "x.payload")
    new = tags.where(F.lit(not strip_all) & F.col("id").isin(*known) & (F.col("value") != "")).select(keep, F.lit(1).alias("a"), order.alias("b"), "id", F.encode("value", "UTF-8").alias("payload"))
    rest = chunks.where(~canonical(F.col("id")).isin(*known, "COMM", "DSIZ")).select(keep, F.lit(2).alias("a"), F.col("chunk_no").alias("b"), "id", "payload")
    number = F.row_number().over(Window.partitionBy(keep).orderBy("a", "b")) - 1  # the chunks of one header
    return ends.union(new).union(rest).select(keep, number.cast("int").alias("chunk_no"), "id", "payload")


def header_bytes(chunks: DataFrame, keep: str = "file") -> DataFrame:
    """(keep, data_offset) of chunk rows: the bytes of their header, data marker included."""
    return chunks.groupBy(keep).agg((F.sum(F.octet_length("payload") + 8) + 20).cast("long").alias("data_offset"))


def info_chunks(infos: DataFrame, keep: str = "file") -> DataFrame:
    """(keep, chunk_no, id, payload) of rows (keep, channels, kbps, rate, data_size, tags map<tag, value>): the format, the
    tags that are not empty in their order, and the data's size."""
    none = F.lit(None).cast("string")
    tagged = [F.struct(F.lit(i).alias("id"), F.encode(F.nullif(F.coalesce(F.try_element_at("tags", F.lit(t)), none), F.lit("")), "UTF-8").alias("payload")) for t, i in TAGS]
    comm = F.struct(F.lit("COMM").alias("id"), comm_payload(F.col("channels"), F.col("kbps"), F.col("rate")).alias("payload"))
    dsiz = F.struct(F.lit("DSIZ").alias("id"), be_bytes(F.coalesce("data_size", F.lit(0)), 4).alias("payload"))
    kept = F.filter(F.array(comm, *tagged, dsiz), lambda c: c["payload"].isNotNull())
    return infos.select(keep, F.posexplode(kept).alias("chunk_no", "c")).select(keep, "chunk_no", "c.id", "c.payload")


def build(chunks: DataFrame, data: DataFrame, keep: str = "file", version: str = VERSIONS[0]) -> DataFrame:
    """(keep, content): whole files of chunk rows (keep, chunk_no, id, payload) and data (keep, data binary, null or absent
    for none). The size chunks say the data's size; one is added last where there is none."""
    sizes = data.select(F.col(keep).alias("__k"), F.coalesce("data", F.lit(b"")).alias("data"))
    rows = chunks.groupBy(keep).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "id", "payload"))).alias("cs"))  # one header's
    rows = rows.join(sizes, F.col(keep) == F.col("__k"), "left").withColumn("data", F.coalesce("data", F.lit(b"")))
    size = be_bytes(F.octet_length("data"), 4)
    made = F.transform("cs", lambda c: chunk(c["id"], F.when(c["id"] == "DSIZ", size).otherwise(c["payload"])))
    made = F.when(F.exists("cs", lambda c: c["id"] == "DSIZ"), made).otherwise(F.concat(made, F.array(chunk("DSIZ", size))))
    return rows.select(keep, _once(F.concat(header(made, version), F.col("data"))).alias("content"))


def write(files: DataFrame, folder: str, name: str = "file") -> DataFrame:
    """Write rows (name, content) as files of those names, with / and other separators as _, under folder, a URI that all
    executors reach; returns (name, path, n_bytes). A file is written beside its place and moved there whole, so that a
    repeated task leaves one file. Null names or contents give no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        disk.create_dir(base, recursive=True)
        for batch in batches:
            names, paths, sizes = batch.column(0).to_pylist(), [], []
            for n, body in zip(names, batch.column(1), strict=True):
                path = f"{base}/{re.sub(r'[^A-Za-z0-9._-]', '_', n)}"
                part = f"{path}.{uuid.uuid4().hex}.part"
                with disk.open_output_stream(part) as out:
                    out.write(body.as_buffer())
                disk.move(part, path)
                paths.append(path), sizes.append(len(body.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["name", "path", "n_bytes"])

    rows = files.select(F.col(name).cast("string").alias("name"), "content").where("name is not null and content is not null")
    return rows.mapInArrow(run, "name string, path string, n_bytes long")


def header_fields(parsed: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """keep, channels, kbps, rate, data_size, error of the COMM and DSIZ chunks, the last of each. A rate and kbit/s of a
    channel that no mode has are an error."""
    pick = lambda name: F.element_at(F.filter("chunks", lambda c: c["id"] == name), -1)["payload"]
    out = parsed.select(*keep, pick("COMM").alias("comm"), pick("DSIZ").alias("dsiz"), "error")
    flag = be_int(F.col("comm"), 9, 4)
    rate = F.when(flag == 44, 44_100).when(flag == 22, 22_050).when(flag == 11, 11_025).when(flag.between(8, 44), flag * 1000)
    channels = be_int(F.col("comm"), 1, 4) + 1
    modes = [f"{r} {m[1]}" for k, r, _ in RATES for m in MODES if m[0] == k]
    legal = F.concat_ws(" ", rate.cast("string"), F.call_function("div", be_int(F.col("comm"), 5, 4), F.greatest(channels, F.lit(1))).cast("string")).isin(*modes)
    error = F.coalesce("error", F.when(F.col("comm").isNull() | (F.octet_length("comm") < 12), F.lit("no COMM chunk")).when(~channels.between(1, 2), F.lit("channels")).when(rate.isNull(), F.lit("rate")).when(~legal, F.lit("mode")))
    fields = F.struct(channels.alias("channels"), be_int(F.col("comm"), 5, 4).alias("kbps"), rate.cast("long").alias("rate"), F.when(F.octet_length("dsiz") >= 4, be_int(F.col("dsiz"), 1, 4)).alias("data_size"), error.alias("error"))
    return out.select(*keep, _once(fields).alias("h")).select(*keep, "h.*")


def frame_slices(files: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """keep, frame, first_bit, byte, skip, n_bytes: where each whole frame of frame_bits lies in data_size bytes."""
    div = lambda a, b: F.call_function("div", a, b)
    frames = div(F.col("data_size") * 8, F.col("frame_bits"))
    rows = files.where((F.col("frame_bits") > 0) & (frames > 0)).select(*keep, "frame_bits", F.explode(F.sequence(F.lit(0).cast("long"), frames - 1)).alias("frame"))
    first = F.col("frame") * F.col("frame_bits")
    return rows.select(*keep, "frame", first.alias("first_bit"), div(first, F.lit(8)).alias("byte"), (first % 8).alias("skip"), (div(first + F.col("frame_bits") + 7, F.lit(8)) - div(first, F.lit(8))).alias("n_bytes"))


def packets(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """keep, frame, skip, record: the bytes that hold each whole frame of files (keep, content, data_offset, data_size,
    frame_bits), and the bits to skip in the first. Without a data_size, or past the content's end, the content ends it."""
    c, bits = F.col(content), F.col("frame_bits").cast("long")
    there = F.greatest(F.octet_length(c) - F.col("data_offset"), F.lit(0))
    size = F.when(F.col("data_size") > 0, F.least(there, F.col("data_size"))).otherwise(there).cast("long")
    div = lambda a, b: F.call_function("div", a, b)

    def cut(frame: Column) -> Column:
        first, last = div(frame * bits, F.lit(8)), div(frame * bits + bits + 7, F.lit(8))
        return F.struct(frame.alias("frame"), (frame * bits % 8).alias("skip"), F.substring(c, (F.col("data_offset") + first + 1).cast("int"), (last - first).cast("int")).alias("record"))

    frames = div(size * 8, F.greatest(bits, F.lit(1)))
    # cut before the rows part, so that none carries the file
    rows = files.where((F.col("frame_bits") > 0) & F.col("data_offset").isNotNull() & (frames > 0)).select(*keep, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), frames - 1), cut)).alias("x"))
    return rows.select(*keep, "x.frame", "x.skip", "x.record")


def seek_offset(bit: Column, data_offset: Column) -> Column:
    """File offset at which reading starts for a bit position: (bit - 7) >> 3 past the data's start, that for bit <= 0."""
    return data_offset + F.when(bit <= 0, 0).otherwise(F.greatest(F.shiftright(bit - 7, 3), F.lit(0)))
