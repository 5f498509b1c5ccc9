"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record keeps its identifier, target and date; each derived record
refers to it by WARC-Refers-To and carries the source's payload digest in its
body or header, so that either can be traced back and checked.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_HIDDEN = ("script", "style", "noscript", "template")
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in _HIDDEN} | {"--": re.compile("-->")}
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|td|th|section|article|aside|header|footer|nav|main|title|head|body|html|pre|blockquote|form|figure)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
#: Name space of record identifiers.
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "veilframe:warc")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, json.dumps(parts))}>"


@cache
def _opening(names: frozenset[str]) -> re.Pattern:
    tags = "|".join(sorted(names - {"--"}))
    forms = (["<!--"] if "--" in names else []) + ([rf"<({tags})\b[^>]*>"] if tags else [])
    return re.compile("|".join(forms), re.I)


def without_hidden(page: str) -> str:
    """The page without comments, scripts and the like, each up to its end; one without an end stays. One scan, however many begin."""
    last = {n: max((m.start() for m in close.finditer(page)), default=-1) for n, close in _CLOSE.items()}
    out, at, open_ = [], 0, frozenset(n for n in last if last[n] >= 0)
    while open_ and (m := _opening(open_).search(page, at)):
        name = (m[1] or "--").lower() if m.re.groups else "--"
        if last[name] < m.end():  # nothing of this kind ends any more
            open_ -= {name}
            continue
        out.append(page[at : m.start()])
        at = _CLOSE[name].search(page, m.end()).end()
    return "".join(out) + page[at:]


def plain_text(page: str) -> str:
    """Text of an HTML page, a line for each block element; scripts, styles and comments are left out."""
    end = page.rfind(">") + 1  # no tag ends behind it
    text = without_hidden(page[:end])
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", text)) + page[end:])
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip(" \n")


def record(kind: str, identifier: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = {"WARC-Type": kind, "WARC-Record-ID": identifier, **fields, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Records (header, block) of an uncompressed WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


def split_http(block: bytes) -> tuple[list[str], bytes]:
    """Status and header lines, and the body, of an HTTP message; all is body if there is no header."""
    if not block.startswith(b"HTTP/"):
        return [], block
    head, _, body = block.partition(b"\r\n\r\n")
    return head.decode("utf-8", "replace").split("\r\n"), body


def response(page_id, url: str | None, page: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record for a stored page; a null url leaves the target out, a null page is an empty body."""
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    fields = {"WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": digest(body), "Content-Type": "application/http; msgtype=response"}
    return record("response", record_id("response", page_id, url), fields, block)


def derive(data: bytes) -> list[tuple[str, str, dict, bytes]]:
    """(kind, identifier, header, block) of the derived records of a response record."""
    (head, block) = parse(data)[0]
    lines, body = split_http(block)
    source, uri = head["WARC-Record-ID"], head.get("WARC-Target-URI")
    page = body.decode("utf-8", "replace")
    title = _TITLE.search(page)
    meta = {
        "status": lines[0] if lines else "",
        "headers": [x.split(": ", 1) for x in lines[1:]],
        "payload-digest": head.get("WARC-Payload-Digest") or digest(body),
        "block-digest": head.get("WARC-Block-Digest"),
        "title": plain_text(title[1]) if title else "",
        "links": len(re.findall(r"<a\b[^>]*\bhref\s*=", page, re.I)),
    }
    text = plain_text(page).encode()
    common = {"WARC-Target-URI": uri, "WARC-Date": head.get("WARC-Date"), "WARC-Refers-To": source}
    out = []
    for kind, block, mime in (("metadata", json.dumps(meta, ensure_ascii=False).encode(), "application/json"), ("conversion", text, "text/plain; charset=utf-8")):
        fields = {**common, "WARC-Refers-To-Payload-Digest": meta["payload-digest"], "Content-Type": mime}
        out.append((kind, record_id(kind, source), fields, block))
    return out


SCHEMA = "page_id long, kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, record binary"


def derivatives(pages: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each page (page_id, url, html), with the whole record.

    Nulls: see response(). Pages that repeat id and url get equal identifiers.
    """

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for page_id, url, page in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for kind, identifier, fields, block in derive(response(page_id, url, page)):
                    rows.append((page_id, kind, identifier, fields["WARC-Refers-To"], url, fields["WARC-Refers-To-Payload-Digest"], digest(block), len(block), record(kind, identifier, fields, block)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(run, SCHEMA)


def op5_warc_derivatives(spark, sf_dir):
    """Metadata and conversion records of all pages; nulls as in derivatives()."""
    out = derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))
