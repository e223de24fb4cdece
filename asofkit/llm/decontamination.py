"""Operator 10: benchmark decontamination with an FM-index per training shard.

Test phrases are all windows of ten words of a benchmark item (an item of fewer words is one phrase). A task reads its
share of the documents shard by shard (a few megabytes of whole texts each), builds an FM-index over the words of the
shard, searches all phrases backwards through the wavelet ranks, locates every occurrence through sampled suffix
positions, and merges the occurrences into removal spans. Words that no phrase contains cannot lie in an occurrence; they
become separators, and stretches between separators that are shorter than the shortest phrase are left out of the index,
which changes no occurrence.

Documents never move: the phrases are sent to the tasks, in portions of at most ``most_phrases`` phrases. Each portion is
one pass. For several passes the texts are written once with a key of their row, and the hits are merged by that key, word
by word, so that results are those of a single pass whatever the ids are.

Defined cases: null or word-less texts have no words and no hits; items without words have no phrase; repeated items each
count; repeated documents are separate rows; empty tables give empty results. Extra columns are kept by
``drop_contaminated`` and ignored by ``find_contamination``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import cut, work_table
from asofkit.llm.fm_index import FMIndex
from asofkit.llm.text_kernel import ALNUM, chars_before, scan_words, slices

WINDOW = 10
MOST_PHRASES = 500_000
SHARD_BYTES = 4 << 20


@dataclass
class Phrases:
    """Phrases as rows of symbols 1..k of a sorted vocabulary of word hashes, with the items that contain each."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    item_edge: np.ndarray
    items: np.ndarray


def phrases_of(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, length, word hashes padded with 0) of every phrase of the items of a batch."""
    words = scan_words(batch.column("text"), ALNUM)
    count = words.counts()
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    n_windows = np.where(count == 0, 0, np.maximum(count - window + 1, 1))
    item = np.repeat(np.arange(words.rows), n_windows)
    edge = np.concatenate(([0], np.cumsum(n_windows)))[:-1]
    begin = first[item] + np.arange(len(item)) - edge[item]
    length = np.minimum(count[item], window)
    place = begin[:, None] + np.arange(window)[None, :]
    inside = np.arange(window)[None, :] < length[:, None]
    hashes = np.where(inside, words.hash[np.minimum(place, max(len(words.hash) - 1, 0))] if len(words.hash) else 0, np.uint64(0))
    return item, length, hashes


def build_phrases(items: list[str], lengths: np.ndarray, hashes: np.ndarray) -> Phrases:
    unique, where = np.unique(np.concatenate((hashes, lengths[:, None].astype(np.uint64)), axis=1), axis=0, return_inverse=True)
    where = where.ravel()
    symbols_of, lengths = unique[:, :-1], unique[:, -1].astype(np.int64)
    inside = np.arange(symbols_of.shape[1])[None, :] < lengths[:, None]
    vocabulary = np.unique(symbols_of[inside])
    symbols = np.where(inside, np.searchsorted(vocabulary, symbols_of) + 1, 0).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(unique)))))
    return Phrases(vocabulary, symbols, lengths, edge, np.asarray(items, dtype=object)[order])


def search_shard(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list]:
    """Per text: number of words, and (hit words, sorted items, merged spans: start and end in code points, then in words)."""
    words = scan_words(texts, ALNUM)
    counts = words.counts()
    none = [(0, [], [])] * words.rows
    if not len(words.hash) or not len(phrases.lengths):
        return counts, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[at] == words.hash, at + 1, 0)
    # stretches of known words within one text
    breaks = (symbol == 0) | np.concatenate(([True], words.row[1:] != words.row[:-1]))
    stretch = np.cumsum(breaks)
    known = symbol > 0
    long_enough = np.bincount(stretch[known], minlength=stretch[-1] + 1) >= phrases.lengths.min()
    keep = np.flatnonzero(known & long_enough[stretch])
    if not len(keep):
        return counts, none
    new = np.concatenate(([False], stretch[keep][1:] != stretch[keep][:-1]))
    place_in_index = np.arange(len(keep)) + np.cumsum(new)
    text = np.zeros(len(keep) + int(new.sum()) + 1, dtype=np.int64)
    text[place_in_index] = symbol[keep]
    word_at = np.full(len(text), -1, dtype=np.int64)
    word_at[place_in_index] = keep
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return counts, none
    n = (high - low)[found]
    phrase = np.repeat(found, n)
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[phrase]
    first = word_at[index.locate(rows)]
    change = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + phrases.lengths[phrase], -1)
    hit = np.cumsum(change[:-1]) > 0
    n_hit = np.bincount(words.row[hit], minlength=words.rows)
    char = chars_before(words.data)
    begins = hit & ~np.concatenate(([False], hit[:-1] & (words.row[1:] == words.row[:-1])))
    span_first = np.flatnonzero(begins)
    span_last = np.flatnonzero(hit & ~np.concatenate((hit[1:] & (words.row[1:] == words.row[:-1]), [False])))
    base = char[words.offsets[words.row[span_first]]]
    first_word = np.searchsorted(words.row, words.row[span_first])
    spans = np.stack((char[words.start[span_first]] - base, char[words.end[span_last]] - base, span_first - first_word, span_last + 1 - first_word), axis=1)
    span_edge = np.searchsorted(words.row[span_first], np.arange(words.rows + 1))
    pair = np.unique(np.stack((words.row[first], phrase), axis=1), axis=0)
    pair_edge = np.searchsorted(pair[:, 0], np.arange(words.rows + 1))
    out = none.copy()
    for r in np.flatnonzero(n_hit):
        items = set()
        for p in pair[pair_edge[r] : pair_edge[r + 1], 1]:
            items.update(phrases.items[phrases.item_edge[p] : phrases.item_edge[p + 1]])
        out[r] = (int(n_hit[r]), sorted(items, key=lambda i: (i is None, i)), spans[span_edge[r] : span_edge[r + 1]].tolist())
    return counts, out


def benchmark_phrases(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most_phrases: int = MOST_PHRASES) -> Iterator[Phrases]:
    """The phrases of the benchmark in portions of bounded size, made on Spark and brought to the driver one by one."""

    def cut_items(batches):
        for batch in batches:
            item, length, hashes = phrases_of(batch, window)
            ids = batch.column("item").take(pa.array(item))
            yield pa.RecordBatch.from_arrays([ids, pa.array(length.astype(np.int32)), pa.array([row.tobytes() for row in hashes], pa.binary())], ["item", "length", "hashes"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    table = cut(items.mapInArrow(cut_items, "item string, length int, hashes binary"))
    n = table.count()
    portions = max(1, -(-n // most_phrases))
    for k in range(portions):
        part = table if portions == 1 else table.filter(F.pmod(F.xxhash64("hashes"), F.lit(portions)) == k)
        got = part.toArrow()
        hashes = np.frombuffer(b"".join(got.column("hashes").to_pylist()), dtype=np.uint64).reshape(-1, window)
        yield build_phrases(got.column("item").to_pylist(), np.asarray(got.column("length"), dtype=np.int64), hashes)


_SPAN = "struct<start:bigint,end:bigint,first:bigint,last:bigint>"
_FOUND = f"n_words bigint, n_hit bigint, items array<string>, spans array<{_SPAN}>"


def _one_pass(texts: DataFrame, phrases: Phrases) -> DataFrame:
    """``texts`` is (id, text, any further columns); all but the text come back with what was found."""
    sent = texts.sparkSession.sparkContext.broadcast(phrases)
    kept = texts.drop("text")
    span = pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "last")])

    def search(batches):
        for whole in batches:
            for batch in slices(whole, "text", SHARD_BYTES):
                counts, found = search_shard(batch.column("text"), sent.value)
                spans = [[{"start": a, "end": b, "first": c, "last": d} for a, b, c, d in f[2]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
                    [*names, "n_words", "n_hit", "items", "spans"],
                )

    names = kept.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return texts.mapInArrow(search, f"{kinds}, {_FOUND}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_phrases: int = MOST_PHRASES, **columns) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, spans`` (spans in code points, end exclusive, merged).

    Ids may be null or repeat, with one portion of phrases and with several.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    portions = benchmark_phrases(benchmark, window=window, most_phrases=most_phrases, **columns)
    portion, following = next(portions), next(portions, None)
    plain = lambda spans: F.transform(spans, lambda s: s.dropFields("first", "last"))
    if following is None:
        return _one_pass(texts, portion).withColumnRenamed("id", "doc_id").withColumn("spans", plain("spans"))
    # written, as row keys must stay the same in every pass
    texts = work_table(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    every = _one_pass(texts, portion)
    while following is not None:
        every = every.unionByName(_one_pass(texts, following).filter("n_hit > 0"))
        following = next(portions, None)
    merged = every.groupBy("row").agg(
        F.first("id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"), last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], s["last"]).alias("last"))
    joined = F.aggregate(
        "spans", F.expr(f"cast(array() as array<{_SPAN}>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= s["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, s)))).otherwise(F.concat(acc, F.array(s))),
    )
    counted = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return merged.withColumn("spans", joined).select("doc_id", "n_words", counted.alias("n_hit"), "items", plain("spans").alias("spans"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The columns of the query: counts, and the sorted item ids as a digest."""
    found = find_contamination(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, most_phrases: int = MOST_PHRASES, **columns) -> DataFrame:
    """The documents in which no test phrase occurs, with all their columns; one filter after the other for several portions."""
    for phrases in benchmark_phrases(benchmark, window=window, most_phrases=most_phrases, **columns):
        sent = docs.sparkSession.sparkContext.broadcast(phrases)

        def clean(batches, sent=sent):
            for whole in batches:
                for batch in slices(whole, text_col, SHARD_BYTES):
                    _, found = search_shard(batch.column(text_col), sent.value)
                    yield batch.filter(pa.array([f[0] == 0 for f in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
