r"""WARC derivatives: from responses to linked metadata and plain-text conversion records.

Each captured page becomes three records: the response (HTTP header block and body), a metadata record
(application/warc-fields) and a conversion record (text/plain).  The two derived ones refer to the response's
WARC-Record-ID, repeat its target URI and date, and name its payload digest and the response's own header lines, so a
reader can go back to the source.  Record ids are name-based (from type, page id, URL and payload), digests are SHA-1
in base 32.  `serialised` gives a record's bytes as WARC/1.1, `parse` reads them back.

Text: comments, scripts, styles and templates are dropped, block tags end a line, other tags vanish, the common
entities are decoded, white space is collapsed.

Defined results: a null body is an empty one and a null URL an empty URI; null ids and repeated rows keep their rows
(repeated rows get equal record ids); header maps and dates may be given as columns `headers` and `date`, otherwise the
fixed `HEADERS` and `DATE` stand in; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import slices

#: What a page without headers or date is taken to have been sent with, and the base-32 alphabet.
HEADERS = {"Content-Type": "text/html; charset=utf-8"}
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DROPPED = ("script", "style", "noscript", "template")
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
CRLF = "\r\n"
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block string, content_length int, block_digest string, payload_digest string, source_digest string, source_headers string"


_DROP = [re.compile(r"<!--.*?-->", re.S), *(re.compile(rf"<{tag}\b[^>]*>.*?</{tag}\s*>", re.S | re.I | re.A) for tag in DROPPED)]
_SPACE, _BLOCK, _TAG = re.compile(r"\s+", re.A), re.compile(rf"</?(?:{BLOCKS})\b[^>]*>", re.I | re.A), re.compile(r"<[^>]*>")
_BLANKS, _LINES = re.compile(r" +"), re.compile(r" ?\n[ \n]*")
_TITLE, _LINK = re.compile(r"<title[^>]*>([^<]*)", re.I | re.A), re.compile(r"<a\b[^>]*\bhref", re.I | re.A)


def sha1_base32(value: str) -> str:
    """`sha1:` and the 32 base-32 digits of the SHA-1 of a string's UTF-8."""
    return "sha1:" + base64.b32encode(hashlib.sha1(value.encode()).digest()).decode()


def record_id(*parts: object) -> str:
    """A name-based urn:uuid."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(chr(1).join('' if p is None else str(p) for p in parts).encode()).hexdigest())}>"


def text_of(html: str) -> str:
    for pattern in _DROP:
        html = pattern.sub("", html)
    text = _TAG.sub("", _BLOCK.sub("\n", _SPACE.sub(" ", html)))
    if "&" in text:
        for entity, sign in ENTITIES:
            text = text.replace(entity, sign)
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")


def records_of(page_id: int | None, url: str, html: str, headers: list[tuple[str, str | None]], date: str) -> Iterator[tuple]:
    """The three records of a page, as rows of SCHEMA."""
    lines = [f"{k}: {v or ''}" for k, v in sorted(headers, key=lambda h: h[0])]
    sent, payload, text = "\n".join(lines), sha1_base32(html), text_of(html)
    response = record_id("response", page_id, url, payload)
    title = _TITLE.search(html)
    http = CRLF.join(["HTTP/1.1 200 OK", *lines, f"Content-Length: {len(html.encode())}", "", html])
    fields = [("title", _SPACE.sub(" ", title[1]).strip(" ") if title else ""), ("source-content-type", dict(headers).get("Content-Type") or ""), ("source-payload-digest", payload), ("links", len(_LINK.findall(html))), ("text-characters", len(text))]
    for kind, content, block in (("response", "application/http; msgtype=response", http), ("metadata", "application/warc-fields", "".join(f"{k}: {v}{CRLF}" for k, v in fields)), ("conversion", "text/plain", text)):
        digest, derived = sha1_base32(block), kind != "response"
        yield page_id, kind, record_id(kind, response, digest) if derived else response, response if derived else None, url, date, content, block, len(block.encode()), digest, digest if derived else payload, payload if derived else None, sent


def derive(pages: DataFrame) -> DataFrame:
    """Three rows for each page (SCHEMA)."""
    headers = F.col("headers").cast("map<string,string>") if "headers" in pages.columns else F.create_map(*(F.lit(x) for kv in HEADERS.items() for x in kv))
    date = F.coalesce(F.col("date").cast("string"), F.lit(DATE)) if "date" in pages.columns else F.lit(DATE)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), text("url").alias("url"), text("html").alias("html"), headers.alias("headers"), date.alias("date"))
    names, kinds = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)
    arrow = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "headers", "date")]
                rows = [r for i, u, h, m, d in zip(*columns, strict=True) for r in records_of(i, u, h, m or [], d)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True)], names)

    return page.mapInArrow(run, SCHEMA)


def serialised(records: DataFrame) -> DataFrame:
    """The records with a column `bytes`: the record as WARC/1.1; source headers travel as WARC-Source-Header lines."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    source = F.when((F.col("record_type") != "response") & (F.col("source_headers") != ""), F.array_join(F.transform(F.split("source_headers", "\n"), lambda h: F.concat(F.lit("WARC-Source-Header: "), h, F.lit(CRLF))), "")).otherwise(F.lit(""))
    head = F.concat(F.lit("WARC/1.1" + CRLF), *(line(name, F.col(c).cast("string")) for name, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Source-Payload-Digest", "source_digest"))), source, *(line(name, F.col(c).cast("string")) for name, c in (("Content-Type", "content_type"), ("Content-Length", "content_length"))), F.lit(CRLF))
    return records.withColumn("bytes", F.encode(F.concat(head, F.col("block"), F.lit(CRLF * 2)), "UTF-8"))


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header lines and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(CRLF)
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = [tuple(x.split(": ", 1)) for x in lines]
    return headers, rest[: int(dict(headers)["Content-Length"])]
