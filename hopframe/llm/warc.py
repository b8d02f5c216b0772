"""WARC archives: writing, and a normaliser for files that are gzipped as a whole.

A whole-file gzip stream cannot be read from the middle. The normaliser inflates such a file once, from start to end,
writes every record as a gzip member of its own, and a sidecar index with each member's offset and length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import bound_batches, materialize, scratch_path

_CHUNK = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
#: Payload bytes of one archive; a partition with more writes several.
ARCHIVE_BYTES = 256 << 20


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(url: str | None) -> str:
    """A header value: no line ends or other control characters."""
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response or revisit record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
    ]
    if is_revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def _inflated(raw) -> Iterator[bytes]:
    """Chunks of bounded size of the plain bytes of a gzip file of one or more members, in one pass."""
    z = zlib.decompressobj(31)
    while data := raw.read(_CHUNK):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(data, _CHUNK)
            data = z.unused_data if z.eof else z.unconsumed_tail
    if not z.eof:
        raise ValueError("the gzip stream is cut short")


def records(raw) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields in lower case, block, whole record) of each record of a gzipped WARC file object, in order."""
    buffer = bytearray()
    source = _inflated(raw)

    def fill(until: int) -> bool:
        while len(buffer) < until:
            chunk = next(source, None)
            if chunk is None:
                return False
            buffer.extend(chunk)
        return True

    while True:
        end, looked = -1, 0
        while end < 0:
            end = buffer.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(buffer)
            if end < 0 and not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("the archive ends within a header")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC header: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        whole = end + 4 + size + 4
        if not fill(whole) or buffer[whole - 4 : whole] != b"\r\n\r\n":
            raise ValueError("the archive ends within a record")
        yield fields, bytes(buffer[end + 4 : end + 4 + size]), bytes(buffer[:whole])
        del buffer[:whole]


def normalise(source, archive, index) -> int:
    """Rewrite the gzipped WARC file object source to archive, a gzip member for each record, and to index a JSON line
    for each: record_id, type, offset, length. Returns the number of records. Memory holds one record."""
    n = offset = 0
    for fields, _, whole in records(source):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = z.compress(whole) + z.flush()
        archive.write(member)
        line = {"record_id": fields.get("warc-record-id", ""), "type": fields.get("warc-type", ""), "offset": offset, "length": len(member)}
        index.write((json.dumps(line) + "\n").encode())
        offset += len(member)
        n += 1
    return n


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record."""
    number = lambda x: int(x) if (x := x.removeprefix("<urn:x-page:").removesuffix(">")) else None
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its header says")
    return number(fields["warc-record-id"]), size, digest, kind, number(fields["warc-refers-to"]) if kind == "revisit" else None, payload


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, is_revisit) for each page.

    Of pages with equal payloads of at least least bytes that with the largest id is the response and the others refer
    to it; rows that repeat that id are responses too, and a null id is smaller than any (where all are null, all are
    responses). Null html is an empty payload.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumns({"sha1": F.sha1("payload"), "key": F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))})
    keys = pages.select(F.col(id_col).cast("long").alias("page_id"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload")).where(F.octet_length("payload") >= least)
    firsts = keys.groupBy(F.sha2("payload", 256).alias("key")).agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    firsts = materialize(firsts, "repeated-payloads")
    if firsts.count() <= 250_000:  # 100 bytes a row
        firsts = F.broadcast(firsts)
    joined = src.join(firsts, "key", "left")
    revisit = F.coalesce(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    return joined.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("is_revisit"))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write plan()'s rows to archives in folder, a URI that all executors reach (file, hdfs, s3, gs), and return the
    manifest (archive, index, n_records) of normalised archives.

    Each task writes files gzipped as a whole, normalises them, and deletes them. Names hold a random part: what a lost
    or repeated task leaves is in no manifest, as the manifest has only the rows of tasks that succeeded.
    """
    bound_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)

        def finish(name: str) -> pa.RecordBatch:
            with files.open_input_stream(f"{base}/{name}.mono.warc.gz", compression=None) as a, files.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as b, files.open_output_stream(f"{base}/{name}.idx.jsonl") as c:
                n = normalise(a, b, c)
            files.delete_file(f"{base}/{name}.mono.warc.gz")
            return pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "index": [f"{name}.idx.jsonl"], "n_records": [n]})

        name, out, z, size = "", None, None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to", "is_revisit")), strict=True):
                if out is None:
                    name, size, z = uuid.uuid4().hex, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                    out = files.open_output_stream(f"{base}/{name}.mono.warc.gz", compression=None)
                data = record(*(x.as_py() for x in row))
                out.write(z.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield finish(name)
        if out is not None:
            out.write(z.flush())
            out.close()
            yield finish(name)

    return materialize(planned.select("page_id", "url", "payload", "sha1", "refers_to", "is_revisit").mapInArrow(run, "archive string, index string, n_records long"), "manifest")


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the manifest's
    archives, each found through its index and inflated by itself; responses are checked against their digest.
    A revisit has a null payload; without payloads all have."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{index}", compression=None) as lines, files.open_input_file(f"{base}/{archive}") as f:
                    for line in _lines(lines):
                        at = json.loads(line)
                        f.seek(at["offset"])
                        whole = zlib.decompress(f.read(at["length"]), 31)
                        ((fields, block, _),) = _single(whole)
                        row = _parsed(fields, block)
                        rows.append(row if payloads and row[3] == "response" else (*row[:5], None))
                        held += len(row[5] or b"") if payloads else 100
                        if held >= 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("archive", "index").repartition(min(n, 4096)).mapInArrow(run, schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(_CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _single(whole: bytes) -> list[tuple[dict[str, str], bytes, bytes]]:
    end = whole.index(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in whole[:end].decode("utf-8", "replace").split("\r\n")[1:])}
    return [(fields, whole[end + 4 : end + 4 + int(fields["content-length"])], whole)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back, without payloads."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(plan(pages, **columns), folder), folder, payloads=False)
