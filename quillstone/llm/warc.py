"""WARC archives: writing with revisits and segments, reading with reassembly.

A payload that exceeds one segment is written as a record and continuation
records. Reading groups the segments by their origin's identifier, orders them by
segment number, verifies the total length, and undoes the chunked transfer
framing of the HTTP block.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Out, materialise, staged_path

END = b"\r\n\r\n"
#: Bytes of compressed records from which on they make a file.
FILE_BYTES = 1 << 24
#: A gzip member without content, which ends each file.
LAST = gzip.compress(b"", 6, mtime=0)
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are ignored.

    A size line that is no hexadecimal number, or a body that ends early, is an error.
    """
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body ends within a size line")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if at + size + 2 > len(framed) or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunked body ends within a chunk")
        parts.append(framed[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _line(value: str | None) -> str:
    """A header value: control characters and blanks percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value or "")


def page_records(key: str, serial: str, url: str | None, payload: bytes, refers_to: str | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page. key: its id as text; serial: makes identifiers of repeated pages differ."""
    name = f"<urn:x-page:{key}:{serial}>"
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-page:{key}:{serial}:{number}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)), *last], block[at : at + segment])


def write(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", segment: int = 1 << 16, chunk: int = 1 << 13, file_bytes: int = FILE_BYTES, names: bool = True) -> None:
    """Write a response or revisit record for each row to WARC files under ``path``, each record a gzip member.

    A worker holds the members of one file. Files are written by Spark's text
    sink, whose line separator is a gzip member without content. With ``names``
    the driver then names them ``.warc.gz``, one by one.

    Of rows with equal payloads that with the smallest id gets the response, its
    repetitions with the same id too; the others refer to it. A null payload is
    empty, a null url an empty one, a null id is larger than any other; payloads
    of any length are cut into segments; further columns are ignored; an empty
    table gives a folder without records.
    """
    body = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    small = materialise(rows.select("id", "digest"), "warc-digests")
    first = small.groupBy("digest").agg(F.min("id").alias("first"))
    # only rows that refer to another one meet the pages again
    again = small.join(first, "digest").filter(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("id_"), F.col("digest").alias("digest_"), "first").distinct()
    paired = rows.join(again, F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            content = b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for i, url, payload, to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                n += 1
                for record in page_records("" if i is None else quote(str(i), safe=""), f"{part}.{n}", url, payload, None if to is None else quote(str(to), safe=""), segment, chunk):
                    held.append(gzip.compress(record + END, 6, mtime=0))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield file()
                        size = 0
        if held:
            yield file()

    files = paired.select("id", "url", "body", F.col("first").alias("to")).mapInArrow(run, "content binary")
    sink = files.select(F.col("content").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", LAST.decode("latin-1"))
    sink.option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    if names:
        _name(pages.sparkSession, path)


def _name(spark: SparkSession, path: str) -> None:
    """Name the archives under ``path`` as readers expect, and remove the sink's mark and files without records."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        file = status.getPath()
        if status.getLen() == 0:
            system.delete(file, False)
        elif file.getName().endswith(".txt"):
            system.rename(file, jvm.org.apache.hadoop.fs.Path(folder, file.getName().removesuffix(".txt") + ".warc.gz"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record; data may be gzip, in one member or several, with zeros behind."""
    if data[:2] == b"\x1f\x8b":
        at = 0
        while at < len(data) and data[at]:
            member = zlib.decompressobj(31)
            # members are cut out step by step, so that what is behind them is not copied for each
            step, parts = 1 << 16, []
            while not member.eof:
                if at >= len(data):
                    raise ValueError("a gzip member ends early")
                parts.append(member.decompress(data[at : at + step]))
                at += min(step, len(data) - at)
            at -= len(member.unused_data)
            yield from _plain(b"".join(parts))
        if data[at:].strip(b"\0"):
            raise ValueError(f"no gzip member at byte {at}")
    else:
        yield from _plain(data)


def _plain(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        start, size = end + 4, int(fields["content-length"])
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} ends early")
        yield fields, data[start : start + size]
        at = start + size + 4


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return dechunked(body) if framed else body


def _page_row(fields: dict[str, str], block: bytes, number: int | None = None, total: int | None = None) -> tuple:
    key = unquote(fields.get("warc-record-id", "").removeprefix("<urn:x-page:").partition(":")[0])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        head = dict(x.lower().split(b":", 1) for x in block.split(b"\r\n\r\n")[0].split(b"\r\n")[1:])
        return key, int(head[b"content-length"]), digest, "revisit", unquote(fields["warc-refers-to"].removeprefix("<urn:x-page:").rstrip(">")), None
    payload = http_payload(block)
    if base32_sha1(payload) != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have the digest {digest}")
    return key, len(payload), digest, "response", None, payload


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id as text, payload_bytes, payload_digest, record_type, refers_to as text, and payload, of each page in the archives.

    A file is read whole by one task, so its size, 2 GB at most, is bounded by what
    a worker holds; its records are bounded by the segments' size. Segments of one record meet in one task, those of other records do not.
    Missing segments, a wrong total length and a wrong digest are errors; segments
    may come in any order. A record that is there twice gives two rows, unless it
    is in segments, where a second one is an error. Fields besides those needed
    are ignored; empty payloads have rows; a folder without records gives none.
    """
    longs = pa.int64()
    names = pa.schema([("page_id", pa.string()), ("payload_bytes", longs), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("origin", pa.string()), ("number", longs), ("total", longs), ("block", pa.binary())])
    page = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(names, 256)
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse(content.as_py()):
                    if "warc-segment-number" in fields:
                        number, total = int(fields["warc-segment-number"]), fields.get("warc-segment-total-length")
                        origin = fields["warc-record-id"] if number == 1 else fields["warc-segment-origin-id"]
                        yield from out.add(None, None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), None, None, None, origin, number, int(total) if total else None, block)
                    elif fields["warc-type"] in ("response", "revisit"):
                        row = _page_row(fields, block)
                        yield from out.add(*row[:5], row[5] if with_payload else None, None, None, None, None)
        yield out.flush()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.filter(F.col("length") > 0).select("content").mapInArrow(run, f"{page}, origin string, number bigint, total bigint, block binary")
    found = materialise(found, "warc-records")
    segments = found.filter(F.col("origin").isNotNull()).groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("payload_digest").alias("digest"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema(list(names)[:6]), 64)
        for batch in batches:
            for k in range(batch.num_rows):
                origin, parts, total, digest = (batch.column(c)[k].as_py() for c in range(4))
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"{origin} lacks a segment")
                block = b"".join(p["block"] for p in parts)
                if len(block) != total:
                    raise ValueError(f"{origin} has {len(block)} bytes, not {total}")
                row = _page_row({"warc-type": "response", "warc-record-id": origin, "warc-payload-digest": f"sha1:{digest}"}, block)
                yield from out.add(*row[:5], row[5] if with_payload else None)
        yield out.flush()

    columns = [f.name for f in list(names)[:6]]
    return found.filter(F.col("origin").isNull()).select(*columns).unionByName(segments.select("origin", "parts", "total", "digest").mapInArrow(join, page))


def round_trip(pages: DataFrame, id_column: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without the payloads: a row for each of ``pages``.

    Null, empty and long payloads, equal ones, repeated rows and further columns
    are treated as ``write`` says; ids come back in their own type. An empty table
    gives no rows.
    """
    path = staged_path(pages.sparkSession, "warc")
    write(pages, path, id_column, names=False, **options)
    back = read(pages.sparkSession, path, with_payload=False)
    kind = pages.schema[id_column].dataType
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return back.select(number("page_id").alias(id_column), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
