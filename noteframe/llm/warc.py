"""WARC derivatives: metadata and plain-text conversion records from response records.

A response record is read as bytes: its named fields, its HTTP head, its body. From it come a
metadata record (the HTTP headers and digests of the source as WARC fields) and a conversion
record (the page's text). Both refer to the response by WARC-Refers-To and to each other by
WARC-Concurrent-To, keep its target URI and date, and carry block digests of their own and the
payload digest of the source. Records are row-local, so there is no shuffle; identifiers are
made from contents, so a repeated task gives the same records.
"""

from __future__ import annotations

from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wrapper import Block, parse

DATE = "1970-01-01T00:00:00Z"
RESPONSES = "key long, record binary"
DERIVED = (
    "key long, type string, record_id string, refers_to string, target_uri string, "
    "block_digest string, source_digest string, content_length long, record binary"
)


def digest(data: bytes) -> str:
    return "sha1:" + b32encode(sha1(data).digest()).decode()


def identifier(kind: str, *parts: str) -> str:
    """A record id from what the record is made of."""
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, chr(10).join((kind, *parts)))}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def written(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record: version, named fields, an empty line, the block, two line ends."""
    head = "".join(f"{n}: {_field(v)}\r\n" for n, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _head(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, header fields (folded lines joined) and what follows the empty line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0], fields, rest


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) and block of a WARC record, by its Content-Length."""
    _, fields, rest = _head(data)
    named = {n.lower(): v for n, v in fields}
    size = named.get("content-length", "")
    return named, rest[: int(size)] if size.isdigit() else rest


def plain_text(html: str) -> str:
    """The text of a page, one line per block, without scripts, styles and markup."""
    lines: list[str] = []
    line: list[str] = []

    def close() -> None:
        if said := " ".join("".join(line).split()):
            lines.append(said)
        line.clear()

    def walk(block: Block) -> None:
        for part in block.parts:
            if isinstance(part, str):
                line.append(part)
            else:
                close()
                walk(part)
                close()

    walk(parse(html))
    close()
    return "\n".join(lines)


def response(key: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a response record; a null url or html is empty."""
    body = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Source-Key: {'' if key is None else key}\r\n\r\n"
    block, payload = http.encode() + body, digest(body)
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", identifier("response", str(key), url or "", payload)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", payload),
        ("WARC-Block-Digest", digest(block)),
    ]
    return written(fields, block)


def derivatives(record: bytes) -> list[tuple]:
    """(type, id, refers to, uri, block digest, source digest, length, record) of both records."""
    named, block = read_record(record)
    status, headers, body = _head(block)
    source, uri = named.get("warc-record-id", ""), named.get("warc-target-uri", "")
    payload = named.get("warc-payload-digest") or digest(body)
    ids = {t: identifier(t, source, payload) for t in ("metadata", "conversion")}
    lines = [("http-status", status), *[(f"http-{n.lower()}", v) for n, v in headers]]
    lines += [("source-payload-digest", payload), ("source-block-digest", named.get("warc-block-digest", ""))]
    blocks = {
        "metadata": "".join(f"{n}: {_field(v)}\r\n" for n, v in lines).encode(),
        "conversion": plain_text(body.decode("utf-8", "replace")).encode(),
    }
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    out = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        own = digest(blocks[kind])
        fields = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", ids[kind]),
            ("WARC-Date", named.get("warc-date", DATE)),
            ("WARC-Target-URI", uri),
            ("WARC-Refers-To", source),
            ("WARC-Concurrent-To", ids[other]),
            ("Content-Type", kinds[kind]),
            ("WARC-Source-Payload-Digest", payload),
            ("WARC-Block-Digest", own),
        ]
        size = len(blocks[kind])
        out.append((kind, ids[kind], source, uri, own, payload, size, written(fields, blocks[kind])))
    return out


def responses(pages: DataFrame) -> DataFrame:
    """(key, record): every page as a response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls, html = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            records = [response(k, urls[i].as_py(), html[i].as_py()) for i, k in enumerate(keys)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(records, pa.binary())], ["key", "record"]
            )

    slim = pages.select(F.col("page_id").cast("long").alias("key"), "url", "html")
    return slim.mapInArrow(run, RESPONSES)


def derived(records: DataFrame) -> DataFrame:
    """Two rows per response record: its metadata and its conversion record.

    Null records are read as empty ones, broken headers as far as they go. Equal responses give
    equal derivatives, an empty table gives no rows, further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0).to_pylist(), batch.column(1)
            rows = [(k, *x) for i, k in enumerate(keys) for x in derivatives(data[i].as_py() or b"")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
            names = ["key", "type", "record_id", "refers_to", "target_uri", "block_digest"]
            names += ["source_digest", "content_length", "record"]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return records.select(F.col("key").cast("long").alias("key"), "record").mapInArrow(run, DERIVED)
