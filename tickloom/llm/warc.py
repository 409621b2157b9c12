"""WARC derivative builder (operator 8).

Responses become two linked records each: a metadata record with what is known of the response, and a
plain-text conversion record. Both name the response in WARC-Refers-To, keep its target URI and date, and the
metadata record carries the source's headers and digests word for word. Record ids are name-based UUIDs of the
source record's id and the kind, so that a rerun after a lost executor writes the same records.

`read_records` splits files (plain or in gzip members) into records, `responses_of_pages` makes response
records of a table of pages, `derivatives` builds the derivatives and `members` packs records for files.

Nulls: a null page is an empty payload; a null url leaves WARC-Target-URI out; a null page_id counts as the
text "null" in the id. Equal rows give equal records. Empty tables give no rows; further columns are ignored.
Other kinds of records than responses give no derivatives. What is no record in a file is a row of type malformed, up to
the next record; it has no derivatives. A response whose chunks or gzip payload break off is converted up to the
fault, which its metadata record names (http-payload-fault)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_arrow, plain, table
from .html import blocks

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, record_date string, block_digest string, record binary"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(map(str, parts)))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version line, headers, empty line, block, two line ends. Line ends inside a value become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[list[tuple[str, str]], bytes, int]:
    """Headers, block and end of the record at an offset."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/", at) or end < 0:
        raise ValueError(f"no record at offset {at}")
    headers: list[tuple[str, str]] = []
    for line in data[at:end].split(b"\r\n")[1:]:
        if line[:1] in b" \t" and headers:  # a folded value
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip().decode('utf-8', 'replace')}")
            continue
        name, _, value = line.partition(b":")
        headers.append((name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    size = field(headers, "Content-Length")
    if size is None or not size.isdigit() or end + 4 + int(size) > len(data):
        raise ValueError(f"no whole block at offset {at}")
    block = data[end + 4 : end + 4 + int(size)]
    at = end + 4 + int(size)
    return headers, block, at + 4 if data.startswith(b"\r\n\r\n", at) else at


def field(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members, one after the other; a broken member gives what precedes the fault."""
    view, at = memoryview(data), 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        one, parts, start = zlib.decompressobj(31), [], at
        try:
            while not one.eof and at < len(view):
                step = view[at : at + (1 << 16)]
                parts.append(one.decompress(step))
                at += len(step) - len(one.unused_data)
        except zlib.error:
            at = start + 3  # the next member, if any, is found by its first bytes
        yield b"".join(parts)


def parse_all(data: bytes) -> Iterator[tuple[list[tuple[str, str]] | None, bytes]]:
    """The records of a file, of one or many gzip members or plain. What is no record, up to the next one's version line, has no headers (None)."""
    held = bytearray()
    parts = _unpacked(data) if data[:2] == b"\x1f\x8b" else iter([data])
    more = True
    while more or held:
        part = next(parts, None)
        more = part is not None
        held += part or b""
        whole, at = bytes(held), 0
        while at < len(whole):
            try:
                headers, block, at = parse(whole, at)
            except ValueError:
                if more:  # the rest of the record may follow
                    break
                after = whole.find(b"\nWARC/", at)
                end = after + 1 if after >= 0 else len(whole)
                if whole[at:end].strip(b"\0\r\n"):
                    yield None, whole[at:end]
                at = end
                continue
            yield headers, block
        del held[:at]


def response(page_id, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    """A response record of a page."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", "null" if page_id is None else page_id, url or "", sha1(payload))), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", sha1(block)), ("WARC-Payload-Digest", sha1(payload))]
    return build(headers, block)


def _body(block: bytes) -> tuple[list[tuple[str, str]], bytes, str]:
    """Headers and payload of an HTTP response, chunks joined and gzip undone; where that fails, what precedes the fault, and what failed."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = [(k.strip().decode("latin-1"), v.strip().decode("latin-1")) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])]
    fault = ""
    if (field(headers, "Transfer-Encoding") or "").lower() == "chunked":
        out, at = [], 0
        while True:
            end = body.find(b"\r\n", at)
            digits = body[at:end].split(b";")[0].strip() if end >= 0 else b""
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
                fault = f"no chunk size at {at}"
                break
            if not (size := int(digits, 16)):
                break
            out.append(body[end + 2 : end + 2 + size])
            if len(out[-1]) < size:
                fault = f"a chunk is cut off at {len(body)}"
                break
            at = end + 2 + size + 2
        body = b"".join(out)
    if (field(headers, "Content-Encoding") or "").lower() in ("gzip", "x-gzip"):
        one, parts, at = zlib.decompressobj(31), [], 0
        try:
            while not one.eof and at < len(body):
                step = body[at : at + (1 << 16)]
                parts.append(one.decompress(step))
                at += len(step)
            fault = fault or ("" if one.eof else "the gzip stream is cut off")
        except zlib.error as e:
            fault = fault or f"gzip: {e}"
        body = b"".join(parts)
    return headers, body, fault


def plain_text(headers: list[tuple[str, str]], body: bytes) -> str:
    """All text blocks of an HTML page, one to a line; other text as it is."""
    kind = field(headers, "Content-Type") or "text/html"
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return "\n".join(b.text for b in blocks(text)) if "html" in kind.lower() else text


def derive(record: bytes) -> list[tuple[str, bytes]]:
    """(kind, record) of the metadata and the conversion record of a response; none for other kinds and for what is no record."""
    try:
        headers, block, _ = parse(record)
    except ValueError:
        return []
    if field(headers, "WARC-Type") != "response":
        return []
    source = field(headers, "WARC-Record-ID") or ""
    http, body, fault = _body(block)
    text = plain_text(http, body).encode()
    linked = [("WARC-Refers-To", source)]
    linked += [(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := field(headers, k)) is not None]
    if (uri := field(headers, "WARC-Target-URI")) is not None:
        linked.append(("WARC-Refers-To-Target-URI", uri))
    if (date := field(headers, "WARC-Date")) is not None:
        linked.append(("WARC-Refers-To-Date", date))
    converted = record_id("conversion", source)
    facts = [f"source-{k}: {v}" for k, v in headers] + [f"http-{k}: {v}" for k, v in http]
    facts += [f"conversion-record-id: {converted}", f"conversion-digest: {sha1(text)}", f"conversion-chars: {len(text.decode())}"]
    facts += [f"http-payload-fault: {fault}"] if fault else []
    about = "".join(f"{x}\r\n" for x in facts).encode()
    out = []
    for kind, name, content_type, data in (("metadata", record_id("metadata", source), "application/warc-fields", about), ("conversion", converted, "text/plain; charset=utf-8", text)):
        own = [("WARC-Type", kind), ("WARC-Record-ID", name), *linked, ("Content-Type", content_type), ("WARC-Block-Digest", sha1(data))]
        out.append((kind, build(own, data)))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 6, pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _row(page_id, kind: str, record: bytes) -> tuple:
    headers, _, _ = parse(record)
    return page_id, kind, *(field(headers, k) for k in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest")), record


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """A response record for each page."""

    def make(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), plain(batch.column(2)).to_pylist(), strict=True)
            yield _batch([_row(p, "response", response(p, u, h.encode())) for p, u, h in rows])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files under a path (each below 2 GB); page_id is null. What is no record is a row of type malformed."""

    def split(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for h, b in parse_all(data.as_py()):
                    if h is None:
                        rows.append((None, "malformed", None, None, None, None, sha1(b), b))
                    else:
                        rows.append(_row(None, field(h, "WARC-Type"), build([(k, v) for k, v in h if k.lower() != "content-length"], b)))
                    size += len(b)
                    if len(rows) == 256 or size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), split, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the response records."""

    def make(batches):
        for batch in batches:
            rows = [_row(p, kind, own) for p, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for kind, own in derive(record)]
            if rows:
                yield _batch(rows)

    return map_arrow(records.where("record_type = 'response'").select("page_id", "record"), make, RECORD)


def members(records: DataFrame) -> DataFrame:
    """(record_id, member): each record as a gzip member; a file of members, one after the other, is a WARC file."""

    def pack(batches):
        for batch in batches:
            packed = [gzip.compress(r.as_py(), mtime=0) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["record_id", "member"])

    return map_arrow(records.select("record_id", "record"), pack, "record_id string, member binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivatives of all pages, with the record's size and digest."""
    rows = derivatives(responses_of_pages(table(spark, sf_dir, "pages")))
    own = [x.split()[0] for x in RECORD.split(", ")]
    return rows.select(*own, F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"))
