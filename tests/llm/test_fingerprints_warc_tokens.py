"""Fingerprints over several ranges, WARC records as bytes, and token counts, each against a plain version."""

import hashlib
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from asofkit.llm import fingerprints as fp
from asofkit.llm import warc
from asofkit.llm.token_counts import document_token_counts, load_encoding
from tests.llm.test_corpus_operators import SCHEMA, words


def pieces_of(text):
    return Counter(fp.pieces(pa.array([text], pa.large_string()))[1].tolist())


def plain_likeness(a, b):
    x, y = pieces_of(a), pieces_of(b)
    every = sum((x | y).values())
    return sum((x & y).values()) / every if every else 1.0


@pytest.mark.parametrize("kind, ranges", [("bigint", 1), ("bigint", 40), ("string", 40), ("string", None)])
def test_near_next_and_near_edited_equal_a_plain_count(spark, kind, ranges):
    texts = [words(60, k // 2) + ("\n" + words(40, k)) for k in range(60)] + ["", None, "one", words(4000, 9)]
    ids = list(range(len(texts))) + [None, 7, 7]
    texts += [words(30, 5), words(31, 6), words(32, 6)]
    key = lambda i: None if i is None else f"d{i:03d}" if kind == "string" else i
    rows = [(key(i), t, 1) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, part int").repartition(3)
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fp.compare_with_next(docs, ranges=ranges).collect()), key=repr)
    plain = [(i, t or "") for i, t, _ in rows]
    ordered = sorted((x for x in plain if x[0] is not None), key=lambda x: x[1])
    ordered = sorted(ordered, key=lambda x: x[0], reverse=True) + [x for x in plain if x[0] is None]
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = fp.edited_text(t, following)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(t, edited), 9), round(plain_likeness(t, following), 9)))
    assert got == sorted(want, key=repr)


def test_the_digests_that_differ_are_recovered(spark):
    texts = [words(900, k) + "\n" + words(50, k + 100) for k in range(6)] + ["", None, words(30, 3)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id bigint, text string, removed int").repartition(2)
    got = {r["doc_id"]: r for r in fp.compare_with_next(docs, ranges=4, digests=True).collect()}
    for k, t in enumerate(texts):
        t, following = t or "", (texts[k - 1] if k else texts[-1]) or ""
        a, b = (Counter(np.array(list(pieces_of(x)), np.uint64).astype(np.int64).tolist()) for x in (t, fp.edited_text(t, following)))
        assert (sorted(got[k]["removed"]), sorted(got[k]["added"])) == (sorted((a - b).elements()), sorted((b - a).elements()))
    assert any(len(r["removed"]) > 20 for r in got.values())


def test_fingerprints_alone_tell_the_likeness_of_close_texts():
    base = words(300, 1)
    for other in (base, base + " and more", base.replace("w3 ", "x "), words(300, 2), ""):
        a, b = (fp.fingerprints(fp.pieces(pa.array([t], pa.large_string())), 1)[0] for t in (base, other))
        got = fp.likeness_of_fingerprints(a, b)
        assert got is None or abs(got - plain_likeness(base, other)) < 1e-9
    assert fp.likeness_of_fingerprints(a, a) == 1.0


def parse_record(raw):
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    named = dict(x.split(": ", 1) for x in lines[1:])
    n = int(named["Content-Length"])
    assert lines[0] == "WARC/1.1" and rest[n:] == b"\r\n\r\n"
    return named, rest[:n]


def test_warc_records_read_back_and_keep_every_header(spark):
    schema = "key bigint, record_id string, target_uri string, warc_date string, http_headers string, payload string, content string"
    headers = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nbad line\r\n"
    rows = [(1, "<urn:uuid:1>", "http://x", "2024-01-01T00:00:00Z", headers, "<p>é</p><a href='/y'>z</a><a name=q>", "clash"), (2, None, None, None, None, None, None), (1, "<urn:uuid:1>", "http://x", "2024-01-01T00:00:00Z", headers, "<p>é</p>", "")]
    got = warc.build_derivatives(spark.createDataFrame(rows, schema), created="2025-05-05T00:00:00Z").collect()
    assert len(got) == 6 and warc.build_derivatives(spark.createDataFrame([], schema)).count() == 0
    for r in got:
        named, block = parse_record(bytes(r["record"]))
        assert block == r["content"].encode() and named["WARC-Block-Digest"] == warc.sha1_base32(block) and named["WARC-Date"] == "2025-05-05T00:00:00Z"
        assert named.get("WARC-Refers-To") == r["refers_to"] and named["WARC-Type"] == r["record_type"]
    meta = next(r for r in got if r["key"] == 1 and r["record_type"] == "metadata" and "outlinks: 1" in r["content"])
    assert [tuple(h) for h in meta["source_headers"]] == [("Set-Cookie", "a=1"), ("Set-Cookie", "b=2")] and meta["content"].count("http-set-cookie") == 2


@pytest.mark.parametrize("page", ["<!--" * 30000, "<script>" * 30000, "<a " * 50000, "<title>" * 30000, "<p" * 50000 + ">" + "<a" * 50000])
def test_hostile_markup_takes_linear_time(page):
    began = time.time()
    warc.derive("r", "t", "d", None, page)
    assert time.time() - began < 2


def test_hidden_elements_go_and_open_ones_stay():
    assert warc.visible_text("a<!-- x --><script>no</script >b<STYLE>q</style>c") == "a b c"
    assert warc.visible_text("a<!-- x <b>c</b>") == "a<!-- x c" or "c" in warc.visible_text("a<!-- x <b>c</b>")


def test_token_counts_equal_direct_encoding(spark):
    texts = ["hello world", None, "", " ", words(40000, 3), "é" * 500, "hello world", "\n\n"]
    rows = [(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)] + [(0, "again", "en", "s", 0, "x", 1), (None, "no id", "en", "s", 0, "x", 1)]
    encoding = load_encoding()
    want = Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t, *_ in rows)
    for parts, block in ((1, 1 << 16), (4, 64)):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert Counter((r["doc_id"], r["n_tokens"]) for r in document_token_counts(docs, block_tokens=block).collect()) == want
    assert document_token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert np.uint16(50256) == 50256


def test_nothing_in_a_page_forges_a_header_line():
    page = "<title>Line one\nx-evil: two\r\nWARC-Type: warcinfo\u2028end</title>body"
    made = warc.derive("<urn:uuid:1>", "http://a.b/c\r\nWARC-Type: forged\r\n d", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX-A: v\x0bw\x00z\r\n", page)
    for r in made:
        head = r["record"].split(b"\r\n\r\n")[0].decode().split("\r\n")
        assert len([x for x in head if x.startswith("WARC-Type")]) == 1 and r["target_uri"] == "http://a.b/c%0D%0AWARC-Type:%20forged%0D%0A%20d"
    fields = dict(x.split(": ", 1) for x in made[0]["content"].split("\r\n") if x)
    assert fields["title"] == "Line one x-evil: two WARC-Type: warcinfo end" and fields["http-x-a"] == "v w z" and "x-evil" not in fields
