"""Line-first cleaning against plain Python and against SQL, and what stays of the texts."""

import re
from collections import Counter

import duckdb
import pytest

from asofkit.llm import quality_rules as qr
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "Every sentence of this small text says something new about rivers, and none of them ever repeats what stood before it. "


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {k + d for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for d in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


TEXTS = [
    None, "", " \n\t\n", "one", PROSE, PROSE + "\n" + PROSE, PROSE + "\nHome | About | Contact\nClick here to subscribe\n\n" + "Another line that ends well.\r\n" * 2,
    "\n".join(f"Menu {k} | Shop {k} | Cart" for k in range(30)), " ".join(f"w{k}%%%" for k in range(40)), "LOUD!! " * 3 + " ".join(f"Word{k}!!" for k in range(40)), "é東🙂 " * 30,
    " ".join(f"v{k}" for k in range(30)) + ".\n" + "Copyright 2020 by nobody, all rights reserved.", "a b c d e f g h " * 4 + " ".join(f"z{k}" for k in range(200)) + ".",
    " ".join(f"long{k}" for k in range(5_000)) + "。\n» »\n“Quoted.”", "\x00 nul\x0b\x0c sep", "last\nlast\r\nlast\nlast ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else k, t, "x", 7) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_words int").repartition(3)


def test_base_counts_equal_plain_python(spark, docs):
    got = {r["doc_id"]: r for r in qr.clean_lines(docs).collect()}
    assert qr.clean_lines(docs).count() == len(TEXTS) + 1
    for k, text in enumerate(TEXTS):
        r = got[None if k == 3 else k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_base(text), k


def test_rules_and_what_stays(spark, docs):
    got = {r["doc_id"]: r for r in qr.clean_lines(docs).collect()}
    kept = {k for k, r in got.items() if r["kept"]}
    assert kept == {4, 6, 11, 12, 13}
    assert (got[6]["n_navigation"], got[6]["n_boilerplate"], got[6]["n_punctuation"]) == (0, 0, 2)  # the first rule that a line breaks
    assert got[6]["cleaned"] == PROSE + "\n\n" + "Another line that ends well.\r\n" * 2
    assert got[7]["n_navigation"] + got[7]["n_punctuation"] == 30 and got[7]["cleaned"] == ""
    assert got[11]["cleaned"].endswith("v29.\n") and got[11]["n_boilerplate"] == 1
    assert got[13]["cleaned"].endswith("。\n“Quoted.”") and got[0]["cleaned"] == ""
    for k, r in got.items():
        if not r["n_punctuation"] + r["n_navigation"] + r["n_boilerplate"] and k is not None:
            assert r["cleaned"] == (TEXTS[k] or "")


def test_equals_sql(spark, docs, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS) if t is None or "\x00" not in t]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, lambda s, d: qr.clean_lines(s.read.parquet(f"{d}/documents.parquet"), keep_text=False), qr.quality_sql(), str(tmp_path)) is None
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), lambda s, d: qr.clean_lines(s.read.parquet(f"{d}/documents.parquet"), keep_text=False), qr.quality_sql(), sf) is None


def test_empty_table(spark):
    assert qr.clean_lines(spark.createDataFrame([], "doc_id string, text string")).collect() == []
