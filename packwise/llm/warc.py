"""Derived WARC records: a metadata and a plain-text conversion record for every response.

``derive`` reads WARC/1.1 response records (one a row, as bytes), parses their named fields, the
HTTP header and the body, and returns the two records that follow from each: both refer to the
response (WARC-Refers-To, its target URI and date), carry digests of their own block and, in the
metadata, the source's fields, HTTP status and headers and digests (as given and as counted). Ids
of derived records are name-based, so deriving again gives the same records.

A body is freed of its transfer coding (chunked) and content codings (gzip, deflate, zstd) first; one that
was stored without the coding that its header names is taken as it stands.

Defined results: a null record gives no rows; a record that isn't a readable response gives one row
of type ``unreadable`` with the reason, so nothing disappears; a response whose body isn't text, is damaged, has
another coding or more than ``MOST`` bytes has its metadata record and, instead of the conversion, an ``unreadable``
row; an unknown or unusable charset counts as UTF-8; a record without id is referred to by
the id that its bytes give; rows that repeat are derived each; other columns are not read.
``read_files`` gives the records of WARC files, plain or of one or several gzip members, by file and place; what
follows a damaged place is one record more, for ``derive`` to report.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwise.llm.common import blocks, col
from packwise.llm.html_blocks import read

VERSION = "WARC/1.1"
#: Namespace of the ids of derived records.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = ("warc_type string, record_id string, refers_to string, target_uri string, date string, "
           "content_type string, content_length long, block_digest string, source_digest string, reason string, "
           "record binary")
_ARROW = pa.schema([(c, pa.string()) for c in ("warc_type", "record_id", "refers_to", "target_uri", "date",
                                               "content_type")]
                   + [("content_length", pa.int64())]
                   + [(c, pa.string()) for c in ("block_digest", "source_digest", "reason")]
                   + [("record", pa.binary())])


def sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def fields_of(head: bytes) -> list[tuple[str, str]]:
    """Named fields in order; a line that begins with a blank goes on with the field before it."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def split_head(data: bytes) -> tuple[bytes, bytes] | None:
    ends = [(data.find(mark), len(mark)) for mark in (b"\r\n\r\n", b"\n\n")]
    ends = [e for e in ends if e[0] >= 0]
    if not ends:
        return None
    at, size = min(ends)
    return data[:at], data[at + size:]


class Unusable(Exception):
    """A body that gives no text, with the reason."""


#: Bytes that a coded body may grow to, and that are decoded at once.
MOST, PIECE = 1 << 30, 1 << 20
#: Parts of content types whose bodies are text.
TEXTUAL = ("text/", "html", "xml", "json", "javascript", "ecmascript", "yaml", "x-www-form-urlencoded")


def unchunked(body: bytes) -> bytes:
    """The body without chunk sizes; as it stands if it isn't chunked, and up to where it breaks off."""
    parts, at = [], 0
    while at < len(body):
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not 0 < len(size) <= 15 or size.strip(b"0123456789abcdefABCDEF"):
            return b"".join(parts) if parts else body
        n = int(size, 16)
        if not n:
            break
        parts.append(body[end + 1:end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at:at + 2] == b"\r\n" else body[at:at + 1] == b"\n"
    return b"".join(parts)


def _inflated(body: bytes, bits: int) -> bytes:
    """What zlib makes of the body, of all members where there are several."""
    parts, total = [], 0
    while body:
        one = zlib.decompressobj(bits)
        while body and not one.eof:
            parts.append(one.decompress(body, PIECE))
            total += len(parts[-1])
            if total > MOST:
                raise Unusable(f"body of over {MOST} bytes")
            body = one.unconsumed_tail or one.unused_data
        parts.append(one.flush())
        if not one.eof:
            raise Unusable("body breaks off in its content coding")
        if bits < 0 or body[:2] != b"\x1f\x8b":  # padding, or another format, after the last member
            break
    return b"".join(parts)


def uncoded(body: bytes, coding: str) -> bytes:
    """The body without one content coding."""
    try:
        if coding in ("gzip", "x-gzip"):
            return _inflated(body, 31) if body[:2] == b"\x1f\x8b" else body
        if coding == "deflate":
            wrapped = len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0
            return _inflated(body, 15 if wrapped else -15)
        if coding == "zstd":
            if body[:4] != b"\x28\xb5\x2f\xfd":
                return body
            out, parts = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True), []
            while piece := out.read(PIECE):
                parts.append(piece)
                if len(parts) * PIECE > MOST:
                    raise Unusable(f"body of over {MOST} bytes")
            return b"".join(parts)
    except (zlib.error, zstandard.ZstdError) as error:
        raise Unusable(f"body damaged in its content coding: {error}") from None
    if coding in ("", "identity"):
        return body
    raise Unusable(f"content coding {coding}")


def text_of(body: bytes, headers: list[tuple[str, str]]) -> str:
    """The plain text of a response's body."""
    by_name: dict[str, str] = {}
    for k, v in headers:
        by_name[k.lower()] = f"{by_name[k.lower()]},{v}" if k.lower() in by_name else v
    if "chunked" in by_name.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed(by_name.get("content-encoding", "").lower().split(",")):
        body = uncoded(body, coding.strip())
    kind = next((v for k, v in headers if k.lower() == "content-type"), "").lower()
    if kind and not any(t in kind.split(";")[0] for t in TEXTUAL):
        raise Unusable(f"body is not text: {kind.split(';')[0].strip()[:100]}")
    charset = kind.partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        text = body.decode(charset, "replace")
    except (LookupError, ValueError):  # unknown, not for text, or refusing (UnicodeError is a ValueError)
        charset, text = "utf-8", body.decode("utf-8", "replace")
    if not kind and "\0" in text:
        raise Unusable("body is not text")
    return plain_text(text) if "html" in kind or not kind else text


def build(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plain_text(body: str) -> str:
    return "\n".join(t for t in (b.text() for b in read(body)[0]) if t)


def derived(record: bytes) -> list[tuple]:
    """The rows that one response record gives."""
    def unreadable(reason: str) -> list[tuple]:
        return [("unreadable", None, None, None, None, None, len(record), sha256(record), None, reason, record)]

    parts = split_head(record)
    if parts is None or not record.startswith(b"WARC/"):
        return unreadable("no WARC header")
    named = fields_of(parts[0].partition(b"\n")[2])
    by_name = {}
    for k, v in named:
        by_name.setdefault(k.lower(), v)
    if by_name.get("warc-type") != "response":
        return unreadable("not a response")
    length = by_name.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 18 or int(length) > len(parts[1]):
        return unreadable("content length missing or beyond the record")
    block = parts[1][:int(length)]
    http = split_head(block)
    if http is None or not block.startswith(b"HTTP/"):
        return unreadable("no HTTP header")
    status, _, rest = http[0].partition(b"\n")
    headers, body = fields_of(rest), http[1]
    source = by_name.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(NAMESPACE, sha256(record))}>"
    uri, date = by_name.get("warc-target-uri"), by_name.get("warc-date")
    try:
        text, reason = text_of(body, headers), None
    except Unusable as unusable:
        text, reason = None, str(unusable)
    about = {
        "source": named, "http-status": status.decode("utf-8", "replace").strip(), "http-headers": headers,
        "block-digest": sha256(block), "payload-digest": sha256(body), "payload-length": len(body),
    }
    meta = json.dumps(about, ensure_ascii=False, separators=(",", ":")).encode()
    rows = []
    made = [("metadata", "application/json", meta)]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    for name, content_type, data in made:
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, name + source + sha256(data))}>"
        out = [("WARC-Record-ID", own), ("WARC-Refers-To", source)]
        out += [(k, v) for k, v in (("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri), ("WARC-Date", date),
                                    ("WARC-Refers-To-Date", date)) if v is not None]
        out += [("WARC-Block-Digest", sha256(data)), ("Content-Type", content_type)]
        rows.append((name, own, source, uri, date, content_type, len(data), sha256(data),
                     by_name.get("warc-payload-digest") or sha256(body), None, build(name, out, data)))
    if text is None:
        rows.append(("unreadable", None, source, uri, date, None, len(record), sha256(record),
                     by_name.get("warc-payload-digest") or sha256(body), reason, record))
    return rows


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file's bytes, plain or of gzip members; from a damaged place on, the rest is one."""
    if data[:2] == b"\x1f\x8b":
        while data:
            one, parts = zlib.decompressobj(31), []
            rest = data
            try:
                while rest and not one.eof:
                    parts.append(one.decompress(rest, PIECE))
                    rest = one.unconsumed_tail or one.unused_data
                parts.append(one.flush())
            except zlib.error:
                parts = []
            if not one.eof:
                yield b"".join(parts) or data
                return
            yield from records_of(b"".join(parts))
            data = rest.lstrip(b"\0")
        return
    at = 0
    while at < len(data):
        head = split_head(data[at:at + (1 << 16)]) or split_head(data[at:])
        length = next((v for k, v in fields_of(head[0]) if k.lower() == "content-length"), "") if head else ""
        if not length.isascii() or not length.isdigit() or len(length) > 18 or not data.startswith(b"WARC/", at):
            yield data[at:]
            return
        body = data.index(head[0], at) + len(head[0])
        body += 4 if data.startswith(b"\r\n\r\n", body) else 2
        end = body + int(length)
        while data[end:end + 1] in (b"\r", b"\n"):
            end += 1
        yield data[at:end]
        at = end


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, place, record of all records in the WARC files below ``path``; a file is one task's work and has
    2 GB at most, as Spark reads whole files."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for place, record in enumerate(records_of(data)):
                    yield pa.RecordBatch.from_pydict({"path": [name], "place": [place], "record": [record]}, schema=rows)

    rows = pa.schema([("path", pa.string()), ("place", pa.int64()), ("record", pa.binary())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(split, "path string, place long, record binary")


def derive(responses: DataFrame, column: str = "record") -> DataFrame:
    """The derived records of responses, whose ``column`` holds one WARC record's bytes a row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "record"):
            rows = [x for r in batch.column("record").to_pylist() if r is not None for x in derived(r)]
            cols = list(zip(*rows)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    return responses.select(col(column).cast("binary").alias("record")).mapInArrow(convert, RECORDS)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages(page_id, url, html), a crawl table that has no dates of its own."""
    html = F.coalesce(col("html"), F.lit("")).cast("binary")
    http = F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "utf-8")
    block = F.concat(http, html)
    name = F.md5(F.concat_ws("\n", F.coalesce(col("page_id").cast("string"), F.lit("")), F.coalesce(col("url"), F.lit("")),
                             F.sha2(html, 256)))
    dashed = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")

    def line(field: str, value: Column) -> Column:
        return F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))

    clean = F.regexp_replace(F.coalesce(col("url"), F.lit("")), r"[\r\n]+", " ")
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\n"), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))),
        line("WARC-Target-URI", clean), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(html, 256))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    tail = F.encode(F.lit("\r\n\r\n"), "utf-8")
    return pages.select(F.concat(F.encode(head, "utf-8"), block, tail).alias("record"))
