"""Operator 8: WARC derivatives: response records become linked metadata and plain-text conversion records.

Responses are rows of (record id, target, date, HTTP header block, payload). For each response the builder makes two
records that refer to it: a ``metadata`` record (fields of the fetch: status, source headers, title, number of links,
length and digest of the payload) and a ``conversion`` record (the visible text). Both keep the identifier of the
response in ``WARC-Refers-To`` together with the target, date and payload digest of the source; their own identifiers are
derived from it, so a rerun makes the same records. Digests are ``sha1:`` in base 32 over the exact bytes of a block.

Each record is made from one response alone, so nothing is shuffled.

Defined cases: a null or empty payload gives an empty conversion and a digest of no bytes; a response without a header
block keeps none; a null target stays null; repeated responses give repeated records; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs

_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template)\b[^>]*>", re.I)
_CLOSER = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "title")} | {"": re.compile("-->")}
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|aside|blockquote|pre|hr|title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_LINK = re.compile(r"\bhref\s*=", re.I)
_SPACE = re.compile(r"[ \t\r\f\v ]+")
#: What would end a header line or is no text: control characters and the line separators of Unicode.
_CONTROL = re.compile(r"[\x00-\x20\x7F\x85\u2028\u2029]+")


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(p or '' for p in parts))}>"


def _tagged(page: str) -> tuple[str, str]:
    """The page up to its last ``>``, in which every tag that opens also closes, so that a search is linear; and the rest."""
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def _without_hidden(page: str) -> str:
    """Comments and hidden elements become a space, in one pass; an opener that never closes is left as it stands."""
    head, tail = _tagged(page)
    out, at, open_ended, seek = [], 0, set(), 0
    while m := _HIDDEN.search(head, seek):
        kind = (m[1] or "").lower()
        close = None if kind in open_ended else _CLOSER[kind].search(head, m.end())
        if close is None:
            open_ended.add(kind)  # no later one of this kind closes either
            seek = m.end()
        else:
            out += [head[at : m.start()], " "]
            at = seek = close.end()
    return "".join(out) + head[at:] + tail


def one_line(value: str) -> str:
    """A value as one header line: every run of white space and control characters is a space."""
    return _CONTROL.sub(" ", value).strip()


def uri(value: str | None) -> str | None:
    """A URI as one header value: white space and control characters are percent-encoded."""
    return None if value is None else _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value.strip())


def page_title(page: str) -> str:
    head, _ = _tagged(page)
    opened = _TITLE.search(head)
    closed = opened and _CLOSER["title"].search(head, opened.end())
    return one_line(html.unescape(head[opened.end() : closed.start()])) if closed else ""


def count_links(page: str) -> int:
    return sum(t[1:2] in "aA" and not t[2:3].isalnum() and bool(_LINK.search(t)) for t in _TAG.findall(_tagged(page)[0]))


def record_bytes(r: dict) -> bytes:
    """The record as WARC/1.1: named fields, an empty line, the block, two empty lines. Fields without a value are left out."""
    named = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"]),
        ("WARC-Refers-To-Target-URI", r["refers_to_target"]), ("WARC-Refers-To-Date", r["refers_to_date"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Payload-Digest", r["payload_digest"]),
        ("Content-Type", r["content_type"]), ("Content-Length", str(r["content_length"])),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in named if v is not None)
    return head.encode() + b"\r\n" + r["content"].encode() + b"\r\n\r\n"


def visible_text(page: str) -> str:
    """The text a reader sees: hidden elements go, block elements end lines, entities are resolved, spaces are folded."""
    head, tail = _tagged(_without_hidden(page))
    text = _TAG.sub("", _BLOCK.sub("\n", head)) + tail
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def header_fields(block: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(status line, header fields in their order) of an HTTP header block."""
    if not block:
        return None, []
    lines = [x for x in block.replace("\r\n", "\n").split("\n") if x]
    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    return (lines[0] if lines else None), fields


_FIELDS = ("record_type", "record_id", "refers_to", "refers_to_target", "refers_to_date", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "source_headers", "content", "content_length", "record")
_KINDS = {"content_length": ("bigint", pa.int64()), "source_headers": ("array<struct<name:string,value:string>>", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), "record": ("binary", pa.binary())}
SCHEMA = "key {kind}, " + ", ".join(f"{f} {_KINDS.get(f, ('string',))[0]}" for f in _FIELDS)


def derive(response: str | None, target: str | None, date: str | None, headers: str | None, payload: str | None, created: str | None = None) -> list[dict]:
    """The metadata record and the conversion record of one response, dated ``created`` (the response's own date if not given)."""
    payload = payload or ""
    digest = sha1_base32(payload.encode())
    status, fields = header_fields(headers)
    text = visible_text(payload)
    facts = [("status", status or ""), ("title", page_title(payload)), ("outlinks", str(count_links(payload))), ("payload-length", str(len(payload.encode()))), ("payload-digest", digest)]
    facts += [(f"http-{re.sub(r'[^!-9;-~]', '-', k.lower())}", v) for k, v in fields]
    facts, target = [(k, one_line(v)) for k, v in facts], uri(target)
    meta = "".join(f"{k}: {v}\r\n" for k, v in facts)
    meta_id, text_id = record_id("metadata", response, digest), record_id("conversion", response, digest)
    out = []
    for kind, own, content, content_type in (("metadata", meta_id, meta, "application/warc-fields"), ("conversion", text_id, text, "text/plain")):
        data = content.encode()
        out.append({
            "record_type": kind, "record_id": own, "refers_to": response, "refers_to_target": target, "refers_to_date": date, "target_uri": target, "warc_date": created or date,
            "content_type": content_type, "block_digest": sha1_base32(data), "payload_digest": digest, "source_headers": [{"name": k, "value": v} for k, v in fields], "content": content, "content_length": len(data),
        })
        out[-1]["record"] = record_bytes(out[-1])
    return out


def build_derivatives(responses: DataFrame, *, key_col: str = "key", created: str | None = None) -> DataFrame:
    """Two records per row of ``responses`` (key, record_id, target_uri, warc_date, http_headers, payload), as columns and as WARC/1.1 bytes (``record``)."""
    kind = responses.schema[key_col].dataType.simpleString()

    def build(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                columns = [part.column(c).to_pylist() for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload")]
                made = [derive(*row, created) for row in zip(*columns)]
                rows = [r for pair in made for r in pair]
                keys = part.column("key").take(pa.array([i for i, pair in enumerate(made) for _ in pair], pa.int64()))
                arrays = [pa.array([r[f] for r in rows], _KINDS[f][1] if f in _KINDS else pa.string()) for f in _FIELDS]
                yield pa.RecordBatch.from_arrays([keys, *arrays], ["key", *_FIELDS])

    source = responses.select(F.col(key_col).alias("key"), *[F.col(c).cast("string").alias(c) for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload")])
    return source.mapInArrow(build, SCHEMA.format(kind=kind))


def page_responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records for a table of raw pages, which keeps neither dates nor headers of its own."""
    name = F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.col(url_col)), 256)
    uid = F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(name, a, n)]], F.lit(">"))
    length = F.coalesce(F.octet_length(F.col(html_col)), F.lit(0)).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n"))
    return pages.select(F.col(id_col).alias("key"), uid.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), F.col(html_col).alias("payload"))
