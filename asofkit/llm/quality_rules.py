"""Operator 12: line-first cleaning. Every line is judged on its own; what fails goes, and a document that loses too much goes with it.

A line with at least one word fails by the first of these rules that it breaks (counts are of the line):

* *punctuation*: it has a symbol of ``# * $ % & < >`` to every four words or more, or a run of two and more ``!`` or ``?`` to every four words or
  more, or it is short (under 8 words) and does not end as a sentence does (a full stop of any script, with closing quotes or brackets);
* *navigation*: it is cut up by ``|``, ``>``, bullets or arrows into items of five words or fewer on average;
* *boilerplate*: it has at most 40 words and holds a phrase of licences, cookie and consent notes, log-ins, share bars or empty templates.

Lines without a word are neither judged nor counted. A document is rejected if it breaks a base rule (fewer than 20 words; or over 30 % of its words stand in windows of 8 words
that occur twice or more in it), or if over half of its word characters stood in failed lines. Whole texts are scanned in one pass without a shuffle, some megabytes of text at a
time; a longer text comes alone.

Defined cases: a null text has no words, so it fails the base rule and cleans to an empty text. Repeated rows are judged each alike. Extra columns do not matter
here; the ones that share a name with an output column are not carried along. Words, windows and lines are compared by 64-bit hashes within one document: two different
ones share a hash with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.text_kernel import mix64, hash_spans, scan_words, slices

# Fixed values of the rules. The patterns are RE2, without look-around, so SQL engines can run them too.
SENTENCE_END = r"""[.!?…。！？।؟]["'”’»)\]}]*[\x20\x09-\x0D]*$"""
SHOUTS = r"[!?]{2,}"
SEPARATORS = r"[|>»›•·→]"
BOILERPLATE = (
    r"(?i)(licensed under|released under|all rights reserved|copyright|creative commons|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum"
    r"|sign in|log in|sign up|subscribe|newsletter|click here|read more|share this|follow us|powered by|skip to)"
)
NAMES = ("punctuation", "navigation", "boilerplate")
WINDOW, LEAST_WORDS, MOST_REPEATED_PCT = 8, 20, 30
SHORT_LINE, ITEM_WORDS, BOILERPLATE_WORDS, MOST_LOST_PCT = 8, 5, 40, 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_NOISE = _SYMBOLS.copy()
_NOISE[ord("|")] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *(f"n_{x}" for x in NAMES), "lost_chars")


def _between(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between two neighbouring edges."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])


def _repeated(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row that stand in a window of 8 words which the row has twice or more."""
    if len(row) < WINDOW:
        return np.zeros(rows, np.int64)
    key = hashes
    for step in (1, 2, 4):  # windows of 2, 4 and 8 words from two halves
        key = mix64(key[:-step] * _STEP + key[step:])
    start = np.flatnonzero(row[: len(key)] == row[WINDOW - 1 :])
    key = mix64(key[start] + row[start].astype(np.uint64) * _STEP)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(row) + 1, dtype=np.int64)
    np.add.at(cover, start[twice], 1)
    np.add.at(cover, start[twice] + WINDOW, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)


def _judge(texts: pa.Array, want_text: bool) -> tuple[dict[str, np.ndarray], pa.Array | None]:
    """The counts of every text of a slice and, if wanted, what is left of it."""
    w = scan_words(texts, lower=False)
    n, edges = w.rows, w.offsets
    letters = np.zeros(len(w.data) + 1, dtype=np.int64)
    letters[w.start] += 1
    letters[w.end] -= 1
    in_word = (np.cumsum(letters[:-1]) > 0) & ((w.data & 0xC0) != 0x80)
    # lines: from an edge to the next, the line break included; a text begins a line
    breaks = np.flatnonzero(w.data == 10) + 1
    line = np.unique(np.concatenate((edges, breaks)))
    line_row = np.searchsorted(edges, line[:-1], side="right") - 1
    words = np.bincount(np.searchsorted(line, w.start, side="right") - 1, minlength=len(line) - 1) if len(line) > 1 else np.zeros(0, np.int64)
    chars, noise = _between(in_word, line), _between(_NOISE[w.data], line)
    strings = pa.LargeStringArray.from_buffers(len(line) - 1, pa.py_buffer(np.ascontiguousarray(line, np.int64)), pa.py_buffer(np.ascontiguousarray(w.data))) if len(line) > 1 else pa.array([], pa.large_string())
    count = lambda p: pc.count_substring_regex(strings, p).to_numpy(zero_copy_only=False)
    match = lambda p: pc.match_substring_regex(strings, p).to_numpy(zero_copy_only=False).astype(bool)
    separators = count(SEPARATORS)
    bad = [
        (4 * noise >= words) & (noise > 0) | (4 * count(SHOUTS) >= words) | (words < SHORT_LINE) & ~match(SENTENCE_END),
        (separators > 0) & (words <= ITEM_WORDS * (separators + 1)),
        (words <= BOILERPLATE_WORDS) & match(BOILERPLATE),
    ]
    real = words > 0
    first = [real & x & ~np.logical_or.reduce(bad[:k], axis=0) if k else real & x for k, x in enumerate(bad)]
    failed = np.logical_or.reduce(first, axis=0)
    by_row = lambda x: np.bincount(line_row, weights=x, minlength=n).astype(np.int64)
    at = np.flatnonzero(real)
    stop = line[1:][at] - (w.data[line[1:][at] - 1] == 10)  # without the line break
    same = mix64(hash_spans(w.data, line[at], stop - line[at]) + line_row[at].astype(np.uint64) * _STEP) if len(at) else np.zeros(0, np.uint64)
    _, seen = np.unique(same, return_index=True)
    lines = by_row(real)
    counts = {
        "n_words": w.counts(), "word_chars": _between(in_word, edges), "n_symbols": _between(_SYMBOLS[w.data], edges),
        "n_dup_lines": lines - np.bincount(line_row[at][seen], minlength=n), "n_repeat_words": _repeated(w.row, w.hash, n), "n_lines": lines,
        **{f"n_{name}": by_row(x) for name, x in zip(NAMES, first)}, "lost_chars": by_row(np.where(failed, chars, 0)),
    }
    if not want_text:
        return counts, None
    stay = np.repeat(~failed, np.diff(line))
    left = np.concatenate(([0], np.cumsum(stay)))[edges]
    return counts, pa.LargeStringArray.from_buffers(n, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(w.data[stay])))


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, the counts of COUNTS, ``base_failed``, ``kept`` and, with ``keep_text``, ``cleaned`` (the text without its failed lines)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, text = _judge(part.column("text"), keep_text)
                arrays = [part.column("id"), *(pa.array(counts[c], pa.int64()) for c in COUNTS), *([text.cast(pa.string())] if keep_text else [])]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *COUNTS, *(["cleaned"] if keep_text else [])])

    schema = f"id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}" + (", cleaned string" if keep_text else "")
    judged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * F.col("n_words"))
    judged = judged.withColumn("base_failed", base).withColumn("kept", ~base & (100 * F.col("lost_chars") <= MOST_LOST_PCT * F.col("word_chars")))
    return judged.withColumnRenamed("id", id_col)


def quality_sql() -> str:
    """The same rows in DuckDB SQL."""
    q = lambda p: p.replace("'", "''")
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '{word}')) AS words, len(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, len(regexp_extract_all(line, '[#*$%&<>]')) AS noise,
  len(regexp_extract_all(line, '{SHOUTS}')) AS shouts, len(regexp_extract_all(line, '{SEPARATORS}')) AS cuts FROM l0 WHERE regexp_matches(line, '{word}')),
b AS (SELECT *, (4 * noise >= words AND noise > 0) OR 4 * shouts >= words OR (words < {SHORT_LINE} AND NOT regexp_matches(line, '{q(SENTENCE_END)}')) AS p,
  cuts > 0 AND words <= {ITEM_WORDS} * (cuts + 1) AS v, words <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}') AS o FROM l),
x AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (p) AS n_punctuation, count(*) FILTER (v AND NOT p) AS n_navigation,
  count(*) FILTER (o AND NOT v AND NOT p) AS n_boilerplate, coalesce(sum(chars) FILTER (p OR v OR o), 0) AS lost_chars FROM b GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
h AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, range(0, {WINDOW}) AS z(k) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation,
  coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN x USING (r) LEFT JOIN h USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PCT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PCT} * n_words) AND 100 * lost_chars <= {MOST_LOST_PCT} * word_chars AS kept FROM c"""
