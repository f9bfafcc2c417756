"""Legacy archive converter: ARC files in, WARC files out, and readers for both.

ARC records have one header line whose fields depend on the version that the file's first record states, and a declared
length. The converter reads them by these lengths and makes up what ARC lacks: record identifiers, ISO times, record
types (response, revisit, metadata of the file itself) and SHA-1 digests of block and payload.

Archives are ordinary text files written by Spark (gzip per file), of about ``ARCHIVE_BYTES`` each, and are read back
whole, one file to a row. Payloads are UTF-8.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.session import scratch_dir, written

ARCHIVE_BYTES = 4 << 20
SMALLEST_REVISIT = 0               # payloads of fewer bytes are never revisits
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# The two published header layouts (fixed values).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}

_SPACE = uuid.UUID("8d6e6a3c-52a1-5c5e-9d3b-7c2f60b0a6f1")
_DATE = "20240101000000"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


# ---- ARC -----------------------------------------------------------------------------------------------------------

def arc_head(name: str, version: int) -> bytes:
    """The version block that opens an ARC file."""
    fields = ARC_FIELDS[version]
    block = f"{version} 0 tablewright\n{' '.join(fields)}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": _DATE, "Content-type": "text/plain", "Archive-length": str(len(block)), "Result-code": "200"}
    return " ".join(values.get(f, "-") for f in fields).encode() + b"\n" + block + b"\n"


def arc_record(url: str | None, block: bytes, version: int, offset: int = 0, name: str = "-", date: str = _DATE) -> bytes:
    values = {"URL": quote(url, safe="%/:=&?~#+!$,;'@()*[]-._") if url else "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
              "Archive-length": str(len(block)), "Result-code": "200", "Checksum": digest(block), "Offset": str(offset), "Filename": name}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """``(fields, offset, block)`` of every record after the version block, by its declared length."""
    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] in b"\r\n":              # blank lines between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at byte {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8").split(" ")
        if fields is None:
            if not line[0].startswith("filedesc:"):
                raise ValueError("not an ARC file: it does not begin with a version block")
            length = int(line[-1])
            head = data[end + 1:end + 1 + length].decode("utf-8").split("\n")
            version = int(head[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = head[1].rstrip("\r").split(" ") if len(head) > 1 and head[1] else ARC_FIELDS[version]
        else:
            if len(line) != len(fields):
                raise ValueError(f"header line at byte {at} has {len(line)} fields, not {len(fields)}")
            record = dict(zip(fields, line))
            length = int(record["Archive-length"])
            if end + 1 + length > len(data):
                raise ValueError(f"record at byte {at} declares {length} bytes, {len(data) - end - 1} are left")
            yield record, at, data[end + 1:end + 1 + length]
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a block without a head is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


# ---- WARC ----------------------------------------------------------------------------------------------------------

def record_id(archive: str, offset: int) -> str:
    """An identifier that depends on where the record stands in its archive, so a retried task makes it again."""
    return uuid.uuid5(_SPACE, f"{archive}@{offset}").urn


def iso_date(date: str) -> str:
    """The 14-digit (or 12-digit) ARC time as WARC wants it; 1970 where there is none."""
    if not date.isdigit() or len(date) not in (12, 14):
        return "1970-01-01T00:00:00Z"
    date = date.ljust(14, "0")
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def warc_record(fields: dict[str, str], archive: str, offset: int, block: bytes, refers_to: str | None) -> bytes:
    """The response, or with ``refers_to`` the revisit, that stands for an ARC record (without the two closing breaks)."""
    head, payload = split_http(block)
    body = block if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(archive, offset)}>", f"WARC-Date: {iso_date(fields['Archive-date'])}"]
    if fields["URL"] != "-":
        lines.append(f"WARC-Target-URI: {fields['URL']}")
    if fields.get("IP-address", "-") not in ("-", "0.0.0.0"):
        lines.append(f"WARC-IP-Address: {fields['IP-address']}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(body)}",
              f"Content-Type: {'application/http; msgtype=response' if head else fields.get('Content-type', 'application/octet-stream')}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of every record, by its Content-Length; header names in lower case."""
    at = 0
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
        length = int(headers["content-length"])
        if end + 4 + length > len(data):
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(data) - end - 4} are left")
        yield headers, data[end + 4:end + 4 + length]
        at = end + 4 + length


# ---- tables --------------------------------------------------------------------------------------------------------

def _opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _save(archives: DataFrame, folder: str, line_end: str) -> None:
    """One archive to a file: every row of the one column is a whole file; the writer adds the last record's end."""
    archives.write.option("compression", "gzip").option("lineSep", line_end).option("maxRecordsPerFile", 1).text(folder)


def _filled(items: Iterator, size_of, head, make, most: int) -> Iterator[str]:
    """Items joined to archives of about ``most`` bytes: ``head(number)`` opens one, ``make(item, number, offset)`` follows.

    Where an archive ends is decided by ``size_of(item)`` alone, before the item's record is made.
    """
    held, size, planned, number = [], 0, 0, 0
    for item in items:
        if held and planned + size_of(item) > most:
            yield b"".join(held).decode("utf-8")
            held, size, planned, number = [], 0, 0, number + 1
        if not held:
            held = [head(number)]
            size = len(held[0])
        record = make(item, number, size)
        held.append(record)
        size += len(record)
        planned += size_of(item)
    if held:
        yield b"".join(held).decode("utf-8")


def _batches(texts: Iterator[str]) -> Iterator[pa.RecordBatch]:
    for text in texts:
        yield pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])


def write_arc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One ARC record per row, version 1 and 2 files in turn. The HTTP head keeps the page's id and length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[str | None, bytes]]:
            for batch in batches:
                for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    payload = (html.as_py() or "").encode()
                    own = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                    yield url, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload

        yield from _batches(_filled(blocks(), lambda item: len(item[1]), lambda number: arc_head(f"pages-{number}.arc", 1 + number % 2),
                                    lambda item, number, at: arc_record(*item, 1 + number % 2, at), archive_bytes))

    # the writer's line end closes the last record's own one with a blank line, which readers skip
    _save(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "value string"), folder, "\n")


def arc_index(spark: SparkSession, folder: str) -> DataFrame:
    """``archive, offset, page_id, digest, length`` of every ARC record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for _, offset, block in read_arc(_opened(content.as_py())):
                    head, payload = split_http(block)
                    page = http_field(head, "X-Page-Id")
                    rows.append((archive, offset, None if page is None else int(page), digest(payload), len(payload)))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=["archive", "offset", "page_id", "digest", "length"])

    return _files(spark, folder).mapInArrow(run, "archive string, offset long, page_id long, digest string, length long")


def revisits(index: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """``archive, offset, to_archive, to_offset`` of the records that revisit another.

    Of records with one payload that with the largest page id is the response (of equal ids, and of records without
    id, the last by archive and offset; a record with an id goes before one without).
    """
    place = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "archive", "offset")
    last = index.where(F.col("length") >= smallest).groupBy("digest", "length").agg(F.max(place).alias("last"), F.count("*").alias("n")).where("n > 1")
    return (index.join(last, ["digest", "length"]).where("archive <> last.archive or offset <> last.offset")
            .select("archive", "offset", F.col("last.archive").alias("to_archive"), F.col("last.offset").alias("to_offset")))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, smallest: int = SMALLEST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Convert all ARC files of a folder to WARC files in another.

    Which records revisit others is worked out from an index of digests and written first. The table of revisits is read
    from there, so Spark knows its true size and broadcasts it only if that is small; payloads are not shuffled then.
    """
    again = written(revisits(written(arc_index(spark, arc_folder)), smallest))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(read_arc(_opened(content.as_py())))
                for a in range(0, len(rows), 256):
                    part = rows[a:a + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * len(part)), pa.array([r[1] for r in part], type=pa.int64()), pa.array(["\t".join(f"{k} {v}" for k, v in r[0].items()) for r in part]),
                                                      pa.array([r[2].decode("utf-8") for r in part])], names=["archive", "offset", "fields", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                archive, offset, fields, to_archive, to_offset = (batch.column(c).to_pylist() for c in ("archive", "offset", "fields", "to_archive", "to_offset"))
                for i, block in enumerate(batch.column("block")):
                    named = dict(f.split(" ", 1) for f in fields[i].split("\t"))
                    target = None if to_archive[i] is None else record_id(to_archive[i], to_offset[i])
                    yield warc_record(named, archive[i], offset[i], block.as_py().encode(), target) + b"\r\n\r\n"

        yield from _batches(_filled(records(), len, lambda number: b"", lambda record, number, at: record, archive_bytes))

    parsed = _files(spark, arc_folder).mapInArrow(parse, "archive string, offset long, fields string, block string")
    _save(parsed.join(again, ["archive", "offset"], "left").mapInArrow(run, "value string"), warc_folder, "\r\n")


def warc_table(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, record_type, refers_to, url, date, page_id, payload_bytes, payload_digest`` of every WARC record.

    A response's digest and length are those of the payload that is there, and must agree with its header; a revisit
    has them from its headers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in read_warc(_opened(content.as_py())):
                    head, payload = split_http(block)
                    told = h["warc-payload-digest"].removeprefix("sha1:")
                    length = len(payload)
                    if h["warc-type"] == "revisit":
                        length = int(http_field(head, "Content-Length"))
                    elif digest(payload) != told:
                        raise ValueError(f"{h['warc-record-id']}: the payload does not have the digest {told}")
                    page = http_field(head, "X-Page-Id")
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"], None if page is None else int(page), length, told))
                if rows:
                    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)],
                                                     names=["record_id", "record_type", "refers_to", "url", "date", "page_id", "payload_bytes", "payload_digest"])

    return _files(spark, folder).select("content").mapInArrow(run, "record_id string, record_type string, refers_to string, url string, date string, page_id long, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """One row per page: written to ARC, converted to WARC, read back from the WARC files.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` (the page id of the response). Null html is an
    empty payload; empty payloads are equal to each other; a null url has no target URI; a null page id comes back null.
    Repeated rows are records of their own. No rows give no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    legacy, modern = scratch_dir(spark), scratch_dir(spark)
    write_arc(pages, legacy)
    convert(spark, legacy, modern, smallest)
    records = written(warc_table(spark, modern))
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("response_page"))
    return records.join(first, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("response_page").alias("refers_to"))
