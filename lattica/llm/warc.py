"""WARC/1.1 records and the two derivatives of a response: linked metadata and plain text.

``responses`` wraps raw pages as response records. ``derivatives`` reads response
records and makes, for each, a ``metadata`` record (JSON: the source's WARC and
HTTP headers, the page's title, metas and links) and a ``conversion`` record
(plain text). Both refer to the response by its record id and carry its target,
date and payload digest; ids are name-based UUIDs, so a task that runs again
makes the same records. Every step works row by row: nothing is shuffled.

Defined results: a null page is an empty body; a null URL gives a record without a target; a
response whose block isn't HTTP is all body; one without a body gives an empty text; repeated
rows give equal records, repeated headers are kept in their order; a body is read by its charset;
pages of any length are read whole; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes of pages that a task works on at once.
PORTION = 4 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: names that are URLs
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long, block binary"

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HEAD_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|section|article|aside|header|footer|nav|main|blockquote|pre|form|title|body|head|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_BLANKS, _LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source|embed)\b([^>]*)>", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(name))}>"


def plain_text(page: str) -> str:
    text = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", page)))
    if "&" in text:
        text = entities.unescape(text)
    return _LINES.sub("\n", _BLANKS.sub(" ", text.replace("\r", "\n"))).strip()


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(tag)}


def page_metadata(page: str) -> dict:
    page = re.sub(r"<!--.*?(?:-->|\Z)", "", page, flags=re.S)
    title = _HEAD_TITLE.search(page)
    metas = [_attributes(m) for m in _META.findall(page)]
    links = []
    for tag, rest in _LINK.findall(page):
        a = _attributes(rest)
        if url := a.get("href") or a.get("src"):
            links.append({"path": f"{tag.upper()}@/{'href' if 'href' in a else 'src'}", "url": url} | ({"rel": a["rel"]} if "rel" in a else {}))
    return {"Title": entities.unescape(_TAG.sub("", title[1])).strip() if title else "", "Metas": metas, "Links": links}


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers in order, repeated ones too, body); a block without an HTTP head is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if ":" in x)], body


def _decoded(body: bytes, headers: list[tuple[str, str]]) -> str:
    """The body's text by the charset of its content type, else that of a meta tag in its first bytes, else UTF-8; unknown charsets count as UTF-8."""
    said = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = _CHARSET.search(said) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _by_bytes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PORTION bytes of the column, so that a task never holds many pages at once."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PORTION, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _respond(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    for batch in _by_bytes(batches, "html"):
        rows = []
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            body = (page or "").encode()
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
            rows.append((page_id, "response", record_id("response", str(page_id), url or "", date), None, url, date, "application/http; msgtype=response", digest(body), digest(block), len(block), block))
        if rows:
            yield _batch(rows)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html)."""
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(lambda it: _respond(it, date), RECORD)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "record_type", "record_id", "target_uri", "date", "payload_digest", "block_digest", "content_type", "content_length", "block")
    for batch in _by_bytes(batches, "block"):
        rows = []
        for page_id, kind, source, url, date, payload, block_digest, content_type, length, block in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if kind != "response":
                continue
            status, headers, body = http_parts(block or b"")
            page = _decoded(body, headers)
            envelope = {
                "WARC-Header-Metadata": {"WARC-Type": kind, "WARC-Record-ID": source, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": payload, "WARC-Block-Digest": block_digest, "Content-Type": content_type, "Content-Length": length},
                "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": [{"name": k, "value": v} for k, v in headers], "Entity-Length": len(body), "Entity-Digest": digest(body), "HTML-Metadata": page_metadata(page)}},
            }
            for made, mime, content in (("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain", plain_text(page).encode())):
                rows.append((page_id, made, record_id(made, source or ""), source, url, date, mime, payload, digest(content), len(content), content))
        if rows:
            yield _batch(rows)


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record."""
    return records.mapInArrow(_derive, RECORD)


def record_bytes(row: dict) -> bytes:
    """A record as it stands in a file."""
    derived = row["refers_to"] is not None
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["date"]),
            ("WARC-Source-Payload-Digest" if derived else "WARC-Payload-Digest", row["payload_digest"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Page-ID", row["page_id"]), ("Content-Type", row["content_type"]), ("Content-Length", row["content_length"])]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + (row["block"] or b"") + b"\r\n\r\n"


def parse_records(file) -> Iterator[dict]:
    """The records of an open (unzipped) file, one after the other. Names of header fields count in any case; of repeated ones the last."""
    while line := file.readline():
        if not line.strip():
            continue
        h = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            h[name.strip().lower()] = value.strip()
        size = int(h["content-length"])
        yield {
            "page_id": int(h["warc-page-id"]) if "warc-page-id" in h else None, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
            "content_type": h.get("content-type"), "payload_digest": h.get("warc-payload-digest") or h.get("warc-source-payload-digest"), "block_digest": h.get("warc-block-digest"), "content_length": size, "block": file.read(size),
        }


def write_warc(records: DataFrame, folder: str, prefix: str = "part", file_bytes: int = 64 << 20) -> DataFrame:
    """Writes records as .warc.gz files (a gzip member a record) to a folder URI that executors can write; returns (file, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, members, total = TaskContext.get().partitionId(), 0, [], 0
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)

        def flush() -> pa.RecordBatch:
            nonlocal number, members, total
            name = f"{prefix}-{part:06d}-{number:06d}.warc.gz"
            temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(temporary, compression=None) as out:
                out.write(b"".join(members))
            files.move(temporary, f"{root}/{name}")
            row = pa.record_batch([pa.array([name]), pa.array([len(members)], pa.int64())], ["file", "n_records"])
            number, members, total = number + 1, [], 0
            return row

        for batch in batches:
            for row in batch.to_pylist():
                members.append(gzip.compress(record_bytes(row), 6, mtime=0))
                total += len(members[-1])
                if total >= file_bytes:
                    yield flush()
        if members:
            yield flush()

    return records.mapInArrow(run, "file string, n_records long")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's .warc.gz files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                # unzipped as it is read: only the records of one batch are held
                for r in parse_records(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                    rows.append(tuple(r[n] for n in names))
                    held += r["content_length"]
                    if held > PORTION:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").mapInArrow(run, RECORD)
