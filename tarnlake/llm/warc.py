"""WARC archives from legacy ARC archives.

ARC files are parsed by their version block: version 1 headers have five fields, version 2 ten, and the declared length delimits each body. A
WARC record is then synthesised with the same target, a record identifier derived from the target, date and content, an ISO timestamp, the type (response, or revisit
of an equal payload's response) and base-32 SHA-1 digests of block and payload.

Spark's text writer writes the archives, one row to a file, so that any store that Spark writes to will do; binaryFile reads them back. A file is closed when its
records reach a size, so that tasks hold one small archive at a time whatever the table's size. Equal payloads are found by digest and length with one aggregate, which
pre-aggregates in each task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.staging import new_path

#: Characters of records after which an archive file is closed.
ARCHIVE_CHARS = 8 << 20

# The field names of ARC version blocks.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _token(text: str | None) -> str:
    """A header field may not hold white space."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (text or "").encode()) if any(c.isspace() or ord(c) < 33 for c in text or "") else text or "-"


def arc_file(name: str, date: str, records: list[tuple[str, str, str, str]], version: int = 2) -> str:
    """A whole ARC file of (url, ip, content type, body) records."""
    fields = ARC_FIELDS[version]
    block = f"{version} 0 tarnlake\n{' '.join(fields)}\n"
    about = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", "200", "-", "-", "0", name]
    out = [" ".join([*about[: 4 if version == 1 else 9], str(len(block.encode()))]) + f"\n{block}"]
    for url, ip, kind, body in records:
        line = [_token(url), ip, date, kind, "200", "-", "-", "0", name]
        out.append("\n" + " ".join([*line[: 4 if version == 1 else 9], str(len(body.encode()))]) + "\n" + body)
    return "".join(out) + "\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block; bodies end by declared length alone."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if not line.strip():
            at = (end if end >= 0 else len(data)) + 1
            continue
        values = line.decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        length = int(values[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"an ARC record of {length} declared bytes has {len(body)}")
        at = end + 1 + length
        if fields is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its filedesc record")
            head, names = body.decode().split("\n")[:2]
            fields = names.split()
            if fields != ARC_FIELDS.get(int(head.split()[0])):
                raise ValueError(f"fields of ARC version {head.split()[0]}: {names}")
            continue
        if len(values) != len(fields):  # some writers leave blanks in the content type or the URL
            spare = len(values) - len(fields)
            if spare < 0:
                raise ValueError(f"an ARC header of {len(values)} fields: {line[:200]!r}")
            at_type = fields.index("Content-type")
            values[at_type : at_type + 1 + spare] = [" ".join(values[at_type : at_type + 1 + spare])]
        yield dict(zip(fields, values, strict=True)), body


def iso_date(arc_date: str) -> str:
    """14-digit archive dates, or 12-digit ones of old files, as WARC-Date."""
    return datetime.strptime(arc_date.ljust(14, "0")[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, digest: str) -> str:
    """The same for the same record, whichever task makes it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest}')}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block.encode())))]
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n" + block + "\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n:
            raise ValueError(f"a WARC record of {n} declared bytes has {len(block)}")
        yield headers, block
        at = end + 4 + n


_archives = pa.schema([("value", pa.string())])


def _arc_files(batches: Iterator[pa.RecordBatch], date: str, version: int, most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, file, records, held = TaskContext.get().partitionId(), 0, [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([arc_file(f"part-{part:06d}-{file:06d}.arc", date, records, version)], pa.string())], schema=_archives)

    for batch in batches:
        for ident, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
            body = html.as_py() or ""
            ident = ident.as_py()
            records.append((f"{_token(url.as_py())}#page={'' if ident is None else ident}", "0.0.0.0", "text/html", body))
            held += len(body) + 200
            if held >= most:
                yield close()
                file, records, held = file + 1, [], 0
    if records:
        yield close()


_parsed = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("type", pa.string()), ("payload", pa.string()), ("digest", pa.string()), ("bytes", pa.int64())])
PARSED = "page_id long, url string, date string, type string, payload string, digest string, bytes long"


def _batched(rows: Iterator[tuple], schema: pa.Schema, size, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += size(r)
        if len(out) >= 2000 or held >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _unzip(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _read_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for content in batch.column(0):
                for head, body in parse_arc(_unzip(content.as_py())):
                    url, _, ident = head["URL"].rpartition("#page=")
                    yield int(ident) if ident else None, url, head["Archive-date"], head["Content-type"], body.decode("utf-8", "replace"), base32_sha1(body), len(body)

    yield from _batched(rows(), _parsed, lambda r: r[6])


def _warc_files(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    def close(records: list[str], date: str) -> pa.RecordBatch:
        info = warc_record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", date, "")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], "software: tarnlake\r\nformat: WARC File Format 1.0\r\n")
        return pa.RecordBatch.from_arrays([pa.array([info + "".join(records)], pa.string())], schema=_archives)

    records, held, date = [], 0, ""
    for batch in batches:
        for ident, url, arc_date, kind, payload, digest, size, first in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            date = iso_date(arc_date)
            page = f"{url}#page={'' if ident is None else ident}"
            headers = [("WARC-Record-ID", record_id(page, date, digest)), ("WARC-Target-URI", page), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
            head = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {size}\r\n\r\n"
            if first is not None and first != ident and size >= least:
                headers += [("WARC-Refers-To-Page", str(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
                block, what = head, "revisit"
            else:
                block, what = head + payload, "response"
            headers += [("WARC-Block-Digest", f"sha1:{base32_sha1(block.encode())}"), ("Content-Type", "application/http; msgtype=response")]
            records.append(warc_record(what, headers, block))
            held += len(records[-1])
            if held >= most:
                yield close(records, date)
                records, held = [], 0
    if records:
        yield close(records, date)


_read = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for content in batch.column(0):
                for head, block in parse_warc(_unzip(content.as_py())):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    if head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"{head['WARC-Record-ID']}: the block has another digest")
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":  # from the payload itself
                        digest, size = base32_sha1(payload), len(payload)
                    ident = head["WARC-Target-URI"].rpartition("#page=")[2]
                    yield int(ident) if ident else None, size, digest, head["WARC-Type"], int(head["WARC-Refers-To-Page"]) if "WARC-Refers-To-Page" in head else None

    yield from _batched(rows(), _read, lambda r: 100)


def _write(files: DataFrame, path: str) -> DataFrame:
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return files.sparkSession.read.format("binaryFile").load(path).select("content")


def write_arcs(pages: DataFrame, path: str, date: str = "20240101000000", version: int = 2, most: int = ARCHIVE_CHARS) -> DataFrame:
    """Legacy archives of pages (page_id, url, html), and their content as read back."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return _write(rows.mapInArrow(lambda it: _arc_files(it, date, version, most), "value string"), path)


def convert_arcs(arcs: DataFrame, path: str, least: int = 0, most: int = ARCHIVE_CHARS) -> DataFrame:
    """WARC archives of ARC files' content, and their content as read back.

    Of records with equal payloads of at least `least` bytes, the one with the largest page_id is response and the others revisit it. Repeated rows of that id are all response."""
    records = arcs.mapInArrow(_read_arcs, PARSED)
    firsts = records.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "bytes", "first")
    typed = records.join(firsts, ["digest", "bytes"], "left").select("page_id", "url", "date", "type", "payload", "digest", "bytes", "first")
    return _write(typed.mapInArrow(lambda it: _warc_files(it, least, most), "value string"), path)


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages written as ARC, converted to WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload; a null url becomes "-"."""
    spark = pages.sparkSession
    arcs = write_arcs(pages, new_path(spark, "arc"))
    return convert_arcs(arcs, new_path(spark, "warc"), least).mapInArrow(_read_warcs, READ)
