"""Operator 3: language-model scoring by deleted interpolation of word bigrams.

Tokens are the lower-cased words of a text and one end token. The model mixes maximum-likelihood estimates:

    p(w)     = m * c(w) / N + (1 - m) / (V + 1)
    p(w | v) = k[b] * c(v, w) / c(v) + (1 - k[b]) * p(w),      b = bucket of the context frequency c(v), by powers of two

The weights m and k[b] are learned by expectation-maximisation on held-out counts, by deleted estimation: each training token in turn
is held out, so the estimates that explain it are (c - 1) / (n - 1). All training tokens take part, through counts of
counts (m) and a histogram of likelihood ratios per bucket (k).

How it runs. Texts are scanned in slices of some megabytes. Unigram counts are added up by Spark. The most frequent words
(by their counts in all rows; at most ``MOST_HEAD``, a size bound) and their counts are sent to all tasks. Every token then travels once, packed with
thousands of others, to the part that owns what is still unknown about it: pairs of two head words by pair, tokens with a
rare word by that word, tokens with a rare context by context. Parts count exactly what they own; tokens whose context and word are both
rare go on from the context's part to the word's. The head list only saves traffic: no count depends on it.
Pairs so frequent that they would fill a good share of a part are counted in the tasks first and added up; their counts are sent to
all tasks, and their tokens are dealt out by place in the texts, not by pair.

Defined cases: null and empty texts have the end token only; without training tokens every token has count 0 and scores
follow from the formulas (N = V = 0); repeated rows and repeated or null ids are separate documents; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import cut, work_table
from asofkit.llm.text_kernel import mix64, scan_words, slices

MOST_HEAD = 65_000
TOKENS_PER_PART = 2_000_000
SLICE = 8 << 20
SLICE_DOCS = 32_000
END = np.uint64(0x0E0D0E0D0E0D0E0D)
START = np.uint64(0x57A2757A2757A275)
BUCKETS = 48
BINS = 480  # likelihood ratios 2**-12 .. 2**36 in steps of a tenth, and one for ratio 0

_PACK = "part int, kind tinyint, slice bigint, x binary, y binary, d binary"
_RESULT = "slice bigint, d binary, b binary, r binary, lp binary, base binary, known binary"


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all tokens, the end tokens included, in text order."""
    words = scan_words(texts)
    counts = words.counts()
    n = len(words.hash) + words.rows
    hashes = np.full(n, END, dtype=np.uint64)
    row = np.repeat(np.arange(words.rows), counts + 1)
    hashes[np.arange(len(words.hash)) + words.row] = words.hash
    return row, hashes


def bounded_slices(batch: pa.RecordBatch):
    for part in slices(batch, "text", SLICE):
        for k in range(0, part.num_rows, SLICE_DOCS):
            yield part.slice(k, SLICE_DOCS)


def unigram_counts(texts: DataFrame) -> DataFrame:
    """``w, c, whole`` over ``texts`` (id, text, held): how often a word occurs in training rows and in all rows."""

    def batch_of(h, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c[0]), pa.array(c[1])], ["w", "c", "whole"])

    def count(batches):
        keys, counts = [], []

        def merged():
            h, c = np.concatenate(keys), np.concatenate(counts, axis=1)
            unique, where = np.unique(h, return_inverse=True)
            return unique, np.stack([np.bincount(where, weights=x, minlength=len(unique)).astype(np.int64) for x in c])

        for whole in batches:
            for batch in bounded_slices(whole):
                row, tokens = tokens_of(batch.column("text"))
                h, where, c = np.unique(tokens, return_inverse=True, return_counts=True)
                held = np.asarray(batch.column("held"))
                keys.append(h)
                counts.append(np.stack((c - np.bincount(where[held[row]], minlength=len(h)), c)))
                if sum(map(len, keys)) > 3_000_000:
                    h, c = merged()
                    if len(h) > 1_500_000:  # mostly new words: pass them on
                        yield batch_of(h, c)
                        h, c = h[:0], c[:, :0]
                    keys, counts = [h], [c]
        if keys:
            h, c = merged()
            for k in range(0, len(h), 200_000):
                yield batch_of(h[k : k + 200_000], c[:, k : k + 200_000])

    return texts.mapInArrow(count, "w bigint, c bigint, whole bigint").groupBy("w").agg(F.sum("c").alias("c"), F.sum("whole").alias("whole"))


class Model:
    """Head words and what all parts need to know; ``whole`` are the counts of the head words in all rows."""

    def __init__(self, n: int, v: int, m: float, head: np.ndarray, counts: np.ndarray, whole: np.ndarray):
        self.n, self.v, self.m = n, v, m
        order = np.argsort(head)
        self.head, self.counts, self.whole = head[order], counts[order], whole[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of a head word, -1 for others."""
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, at, -1)

    def p1(self, c: np.ndarray) -> np.ndarray:
        return self.m * c / max(self.n, 1) + (1 - self.m) / (self.v + 1)

    def p1_deleted(self, c: np.ndarray) -> np.ndarray:
        return self.m * (c - 1) / max(self.n - 1, 1) + (1 - self.m) / (self.v + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of log2."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.uint8)


def group_train_counts(key: np.ndarray, train: np.ndarray) -> np.ndarray:
    """For each token the number of training tokens with its key."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    sums = np.add.reduceat(train[order].astype(np.int64), np.flatnonzero(new))
    out = np.empty(len(key), dtype=np.int64)
    out[order] = sums[np.cumsum(new) - 1]
    return out


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * np.uint64(0x9E3779B97F4A7C15) + mix64(w))


def ratios(model: Model, c_vw, c_v, c_w, train) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, likelihood ratio) of all tokens for scoring, and the histogram of the held-out ratios of training tokens."""
    r = np.where(c_v > 0, c_vw / np.maximum(c_v, 1) / model.p1(c_w), 0.0).astype(np.float32)
    t = np.flatnonzero(train)
    held = np.where(c_v[t] > 1, (c_vw[t] - 1) / np.maximum(c_v[t] - 1, 1) / model.p1_deleted(c_w[t]), 0.0)
    bins = np.where(held > 0, np.clip(((np.log2(np.maximum(held, 1e-9)) + 12) * 10), 0, BINS - 1).astype(np.int64) + 1, 0)
    at = bucket(c_v[t] - 1).astype(np.int64) * (BINS + 1) + bins
    size = BUCKETS * (BINS + 1)
    return bucket(c_v), r, np.stack((np.bincount(at, minlength=size), np.bincount(at, weights=held, minlength=size)))


def _pack(parts: np.ndarray, n_parts: int, kind: int, slice_id: int, x: np.ndarray, y: np.ndarray | None, d: np.ndarray, first: int):
    order = np.argsort(parts.astype(np.uint16) if n_parts < 65536 else parts, kind="stable")
    edge = np.searchsorted(parts[order], np.arange(n_parts + 1))
    x, d = x[order], d[order]
    y = None if y is None else y[order]
    used = np.flatnonzero(np.diff(edge))
    cut_ = lambda a: [b"" if a is None else a[edge[p] : edge[p + 1]].tobytes() for p in used]
    return pa.RecordBatch.from_arrays(
        [pa.array((used + first).astype(np.int32)), pa.array(np.full(len(used), kind, np.int8)), pa.array(np.full(len(used), slice_id, np.int64)), pa.array(cut_(x), pa.binary()), pa.array(cut_(y), pa.binary()), pa.array(cut_(d), pa.binary())],
        ["part", "kind", "slice", "x", "y", "d"],
    )


PAIR, WORD, CONTEXT, FREQUENT = 0, 1, 2, 5
CHUNK = 18  # tokens of frequent pairs are dealt out by 2**18
HELD = np.uint16(1 << 15)


class PairCounts:
    """Training and total counts of pairs, added up over slices."""

    def __init__(self):
        self.pairs, self.counts = np.zeros(0, np.uint32), np.zeros((0, 2), np.int64)

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.pairs, where = np.unique(np.concatenate((self.pairs, pairs)), return_inverse=True)
        both = np.concatenate((self.counts, counts))
        self.counts = np.stack([np.bincount(where, weights=both[:, k], minlength=len(self.pairs)).astype(np.int64) for k in (0, 1)], axis=1)


def _scan(texts: DataFrame, model, n_parts: int, contexts: bool, frequent) -> DataFrame:
    """Packed tokens. ``contexts``: those with a rare context, and counts of the pairs of words that occur ``frequent`` times or more;
    else all others, with ``frequent`` the pairs whose counts are known (broadcast), and a row (kind 3) about each slice's documents."""

    def scan(batches):
        m, task, number = model.value, TaskContext.get().partitionId(), 0
        seen = PairCounts()
        for whole in batches:
            for batch in bounded_slices(whole):
                slice_id, number = (task << 24) + number, number + 1
                row, w = tokens_of(batch.column("text"))
                if not len(row):
                    continue
                first = np.concatenate(([True], row[1:] != row[:-1]))
                v = np.concatenate(([START], w[:-1]))
                v[first] = START
                held = np.asarray(batch.column("held"))
                d = row.astype(np.uint16) | np.where(held[row], HELD, np.uint16(0))
                hv, hw = m.find(v), m.find(w)
                if contexts:
                    often = m.whole >= frequent
                    on = np.flatnonzero((hv >= 0) & (hw >= 0) & often[hv] & often[hw])
                    if len(on):
                        pair, where = np.unique((hv[on].astype(np.uint32) << np.uint32(16)) | hw[on].astype(np.uint32), return_inverse=True)
                        seen.add(pair, np.stack((np.bincount(where, weights=~held[row[on]]), np.bincount(where)), axis=1).astype(np.int64))
                        if len(seen.pairs) > 1_000_000:
                            yield seen_pairs(seen)
                            seen = PairCounts()
                    on = np.flatnonzero(hv < 0)
                    # a head word goes as its number, marked by the top bits of its own field being zero
                    yield _pack((mix64(v[on]) % np.uint64(n_parts)).astype(np.int64), n_parts, CONTEXT, slice_id, v[on], np.where(hw[on] >= 0, hw[on].astype(np.uint64), w[on]), d[on], 0)
                    continue
                on = np.flatnonzero((hv >= 0) & (hw >= 0))
                pair = (hv[on].astype(np.uint32) << np.uint32(16)) | hw[on].astype(np.uint32)
                known = frequent.value[0]
                hot = np.isin(pair, known) if len(known) else np.zeros(len(pair), dtype=bool)
                cold, on = on[~hot], on[hot]
                yield _pack((mix64(pair[~hot].astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64), n_parts, PAIR, slice_id, pair[~hot], None, d[cold], 0)
                if len(on):
                    chunk = np.uint64(slice_id << 8) + (np.arange(len(on)) >> CHUNK).astype(np.uint64)
                    yield _pack((mix64(chunk) % np.uint64(n_parts)).astype(np.int64), n_parts, FREQUENT, slice_id, pair[hot], None, d[on], 0)
                on = np.flatnonzero((hv >= 0) & (hw < 0))
                yield _pack((mix64(w[on]) % np.uint64(n_parts)).astype(np.int64), n_parts, WORD, slice_id, w[on], hv[on].astype(np.uint16), d[on], n_parts)
                on = np.flatnonzero(hw >= 0)
                c = m.counts[hw[on]]
                n_rows = batch.num_rows
                about = [np.bincount(row[on], weights=x, minlength=n_rows) for x in (np.log(m.p1(c)), m.base(c), c > 0)]
                info = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(np.bincount(row, minlength=n_rows)), *map(pa.array, about)], ["id", "held", "n", "lp", "base", "known"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema) as out:
                    out.write_batch(info)
                yield pa.RecordBatch.from_arrays([pa.array([2 * n_parts + slice_id % n_parts], pa.int32()), pa.array([3], pa.int8()), pa.array([slice_id], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], ["part", "kind", "slice", "x", "y", "d"])
        if len(seen.pairs):
            yield seen_pairs(seen)

    def seen_pairs(seen: PairCounts) -> pa.RecordBatch:
        return _pack((mix64(seen.pairs.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64), n_parts, FREQUENT, 0, seen.pairs, None, seen.counts, 0)

    return texts.mapInArrow(scan, _PACK)


_OUT = "kind tinyint, part int, slice bigint, d binary, b binary, r binary, lp binary, base binary, known binary, info binary"
_OUT_NAMES = ["kind", "part", "slice", "d", "b", "r", "lp", "base", "known", "info"]


def _out_row(kind, part, slice_id, **parts):
    return {"kind": kind, "part": part, "slice": slice_id, **{n: b"" for n in _OUT_NAMES[3:]}, **parts}


def _table(rows: list[dict]) -> pa.Table:
    types = [pa.int8(), pa.int32(), pa.int64()] + [pa.binary()] * 7
    return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in zip(_OUT_NAMES, types)})


def _joined(table: pa.Table, kind: int, column: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    own = table.filter(pc.equal(table.column("kind"), kind))
    raw = own.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), dtype=dtype), np.asarray([len(x) // np.dtype(dtype).itemsize for x in raw], dtype=np.int64)


def _slices_of(table: pa.Table, kind: int) -> list[int]:
    return table.filter(pc.equal(table.column("kind"), kind)).column("slice").to_pylist()


#: Kinds of result rows: tokens ready to score, histogram, documents of a slice, tokens that go on to their word's part, frequent pairs.
READY, HISTOGRAM, ABOUT, ON, COUNTED = 0, 1, 2, 3, 4


def _results(model: Model, part: int, slice_ids: np.ndarray, d, c_vw, c_v, c_w, tail_words: bool) -> list[dict]:
    train = (d & HELD) == 0
    b, r, histogram = ratios(model, c_vw, c_v, c_w, train)
    rows = [_out_row(HISTOGRAM, part, 0, b=histogram[0].astype(np.float64).tobytes(), r=histogram[1].tobytes())]
    row = (d & ~HELD).astype(np.int64)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(slice_ids)) + 1, [len(d)])) if len(d) else [0]
    for s, e in zip(edge, edge[1:]):
        extra = {}
        if tail_words:
            c = c_w[s:e]
            lp, base, known = (np.bincount(row[s:e], weights=x) for x in (np.log(model.p1(c)), model.base(c), c > 0))
            extra = {"lp": lp.tobytes(), "base": base.tobytes(), "known": known.astype(np.int32).tobytes()}
        rows.append(_out_row(READY, part, int(slice_ids[s]), d=row[s:e].astype(np.uint16).tobytes(), b=b[s:e].tobytes(), r=r[s:e].tobytes(), **extra))
    return rows


def _context_part(model, frequent: int):
    """Counts of rare contexts: tokens with head words are ready, the others go on with the context's count. And pairs that are frequent."""

    def count(table: pa.Table) -> pa.Table:
        m, part = model.value, table.column("part")[0].as_py()
        v, lengths = _joined(table, CONTEXT, "x", np.uint64)
        y, d = _joined(table, CONTEXT, "y", np.uint64)[0], _joined(table, CONTEXT, "d", np.uint16)[0]
        slice_ids = np.repeat(np.asarray(_slices_of(table, CONTEXT), dtype=np.int64), lengths)
        train = (d & HELD) == 0
        c_v = group_train_counts(v, train)
        head = y < MOST_HEAD + 500
        c_vw = group_train_counts(pair_key(v, y), train)
        h = np.flatnonzero(head)
        rows = _results(m, part, slice_ids[h], d[h], c_vw[h], c_v[h], m.counts[y[h].astype(np.int64)], False)
        t = np.flatnonzero(~head)
        ids = slice_ids[t]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(t)])) if len(t) else [0]
        for s, e in zip(edge, edge[1:]):
            o = t[s:e]
            rows.append(_out_row(ON, part, int(ids[s]), d=d[o].tobytes(), r=y[o].tobytes(), lp=np.minimum(c_v[o], 2**31 - 1).astype(np.int32).tobytes(), base=c_vw[o].astype(np.int32).tobytes()))
        seen = PairCounts()
        seen.add(_joined(table, FREQUENT, "x", np.uint32)[0], _joined(table, FREQUENT, "d", np.int64)[0].reshape(-1, 2))
        o = seen.counts[:, 1] >= frequent
        if o.any():
            rows.append(_out_row(COUNTED, part, 0, d=seen.pairs[o].tobytes(), b=seen.counts[o, 0].tobytes()))
        return _table(rows)

    return count


def _deal_on(n_parts: int):
    def deal(batches):
        for batch in batches:
            for slice_id, d, w, c_v, c_vw in zip(*(batch.column(c).to_pylist() for c in ("slice", "d", "r", "lp", "base"))):
                w, d = np.frombuffer(w, np.uint64), np.frombuffer(d, np.uint16)
                both = np.stack((np.frombuffer(c_v, np.int32), np.frombuffer(c_vw, np.int32)), axis=1)
                yield _pack((mix64(w) % np.uint64(n_parts)).astype(np.int64), n_parts, 4, slice_id, w, both, d, n_parts)

    return deal


def _last_part(model, frequent):
    """Pairs of head words, those with known counts apart, or all tokens of rare words."""

    def count(table: pa.Table) -> pa.Table:
        m, part = model.value, table.column("part")[0].as_py()
        rows = []
        about = table.filter(pc.equal(table.column("kind"), 3))
        rows += [_out_row(ABOUT, part, s, info=x) for s, x in zip(about.column("slice").to_pylist(), about.column("x").to_pylist())]
        pair, lengths = _joined(table, PAIR, "x", np.uint32)
        if len(pair):
            d = _joined(table, PAIR, "d", np.uint16)[0]
            ids = np.repeat(np.asarray(_slices_of(table, PAIR), dtype=np.int64), lengths)
            c_vw = group_train_counts(pair, (d & HELD) == 0)
            rows += _results(m, part, ids, d, c_vw, m.counts[(pair >> np.uint32(16)).astype(np.int64)], m.counts[(pair & np.uint32(0xFFFF)).astype(np.int64)], False)
        pair, lengths = _joined(table, FREQUENT, "x", np.uint32)
        if len(pair):
            d = _joined(table, FREQUENT, "d", np.uint16)[0]
            ids = np.repeat(np.asarray(_slices_of(table, FREQUENT), dtype=np.int64), lengths)
            pairs, counts = frequent.value
            rows += _results(m, part, ids, d, counts[np.searchsorted(pairs, pair)], m.counts[(pair >> np.uint32(16)).astype(np.int64)], m.counts[(pair & np.uint32(0xFFFF)).astype(np.int64)], False)
        w, lengths = _joined(table, WORD, "x", np.uint64)
        w2, lengths2 = _joined(table, 4, "x", np.uint64)
        if len(w) or len(w2):
            hv = _joined(table, WORD, "y", np.uint16)[0].astype(np.int64)
            d1, d2 = _joined(table, WORD, "d", np.uint16)[0], _joined(table, 4, "d", np.uint16)[0]
            known = _joined(table, 4, "y", np.int32)[0].reshape(-1, 2).astype(np.int64)
            d, words = np.concatenate((d1, d2)), np.concatenate((w, w2))
            ids = np.concatenate((np.repeat(np.asarray(_slices_of(table, WORD), dtype=np.int64), lengths), np.repeat(np.asarray(_slices_of(table, 4), dtype=np.int64), lengths2)))
            c_w = group_train_counts(words, (d & HELD) == 0)
            c_vw = np.concatenate((group_train_counts(pair_key(hv.astype(np.uint64), w), (d1 & HELD) == 0), known[:, 1]))
            c_v = np.concatenate((m.counts[hv], known[:, 0]))
            order = np.argsort(ids, kind="stable")
            rows += _results(m, part, ids[order], d[order], c_vw[order], c_v[order], c_w[order], True)
        return _table(rows)

    return count


def learn_unigram_weight(counts: list[tuple[float, float]], n: int, v: int) -> float:
    """EM for m over (count, number of words with it), each token held out in turn."""
    if n < 2:
        return 0.5
    c, words = (np.asarray(x, dtype=np.float64) for x in zip(*counts))
    ml, flat, weight, m = (c - 1) / (n - 1), 1 / (v + 1), c * words, 0.9
    for _ in range(200):
        post = m * ml / (m * ml + (1 - m) * flat)
        m = float(np.clip((weight * post).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    return m


def learn_context_weights(histogram: np.ndarray) -> np.ndarray:
    """EM for k[b] over (buckets, bins, [weight, sum of ratios])."""
    weight, total = histogram[..., 0], histogram[..., 1]
    ratio = np.where(weight > 0, total / np.maximum(weight, 1e-300), 0.0)
    k = np.full(BUCKETS, 0.5)
    for _ in range(200):
        post = k[:, None] * ratio / (k[:, None] * ratio + 1 - k[:, None])
        mass = weight.sum(axis=1)
        k = np.where(mass > 0, np.clip((weight * post).sum(axis=1) / np.maximum(mass, 1), 1e-6, 1 - 1e-6), 0.0)
    k[0] = 0.0  # an unseen context has no estimate of its own
    return k


def score_texts(docs: DataFrame, held: Column, *, id_col: str = "doc_id", text_col: str = "text", most_head: int = MOST_HEAD, tokens_per_part: int = TOKENS_PER_PART) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held`` marks the documents that are not learned from.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    counts = cut(unigram_counts(texts))
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())

    def coarse(name: str) -> Column:
        return F.when(F.col(name) < 4096, F.col(name)).otherwise(4096 + F.floor(F.log2(name) * 64))

    learned = counts.filter("c > 0").groupBy(coarse("c").alias("g")).agg(F.avg("c").alias("c"), F.count(F.lit(1)).alias("words")).collect()  # at most 4096 + 64 * 64 rows
    m = learn_unigram_weight([(r["c"], r["words"]) for r in learned], n, v)
    # the head: all words from a count in all rows on, with the count so high that they are few enough
    shape = counts.groupBy(coarse("whole").alias("g")).agg(F.count(F.lit(1)).alias("words")).collect()  # as few rows
    least, words = None, 0
    for r in sorted(shape, key=lambda r: -r["g"]):
        words += r["words"]
        if words > min(most_head, MOST_HEAD):
            break
        least = r["g"]
    end = F.col("w") == int(END.view(np.int64))
    head = counts.filter(end if least is None else end | (coarse("whole") >= least)).collect()
    starts = next(((r["c"], r["whole"]) for r in head if r["w"] == int(END.view(np.int64))), (0, 0))  # as many starts as ends
    words = np.asarray([r["w"] for r in head], dtype=np.int64).view(np.uint64)
    both = np.asarray([*((r["c"], r["whole"]) for r in head), starts], dtype=np.int64)
    known = Model(n, v, m, np.concatenate((words, [START])), both[:, 0], both[:, 1])
    model = spark.sparkContext.broadcast(known)
    n_parts = max(24, -(-int(counts.agg(F.sum("whole")).first()[0] or 0) // tokens_per_part))
    often = max(2, tokens_per_part // 2)
    by_context = _scan(texts, model, n_parts, True, often).groupBy("part").applyInArrow(_context_part(model, often), _OUT)
    first = work_table(by_context, "contexts", "kind")
    counted = first.filter(F.col("kind") == COUNTED).select("d", "b").collect()  # at most one pair for every ``often`` tokens
    pairs, pair_counts = np.frombuffer(b"".join(r["d"] for r in counted), np.uint32), np.frombuffer(b"".join(r["b"] for r in counted), np.int64)
    order = np.argsort(pairs)
    frequent = spark.sparkContext.broadcast((pairs[order], pair_counts[order]))
    on = first.filter(F.col("kind") == ON).select("slice", "d", "r", "lp", "base").mapInArrow(_deal_on(n_parts), _PACK)
    packed = _scan(texts, model, n_parts, False, frequent).unionByName(on)
    second = work_table(packed.groupBy("part").applyInArrow(_last_part(model, frequent), _OUT), "tokens", "kind")
    results = first.unionByName(second)

    def spread(batches):
        for batch in batches:
            for w, t in zip(batch.column("b").to_pylist(), batch.column("r").to_pylist()):
                w, t = np.frombuffer(w), np.frombuffer(t)
                at = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at]), pa.array(t[at])], ["at", "w", "t"])

    rows = results.filter(F.col("kind") == HISTOGRAM).select("b", "r").mapInArrow(spread, "at int, w double, t double").groupBy("at").agg(F.sum("w").alias("w"), F.sum("t").alias("t")).collect()  # at most BUCKETS * (BINS + 1) rows
    histogram = np.zeros((BUCKETS * (BINS + 1), 2))
    for r in rows:
        histogram[r["at"]] = r["w"], r["t"]
    weights = learn_context_weights(histogram.reshape(BUCKETS, BINS + 1, 2))

    def partial(batches):
        for batch in batches:
            columns = ["slice", "d", "b", "r", "lp", "base", "known"]
            out = {c: [] for c in ("slice", "info", "score", "base", "known")}
            for slice_id, d, b, r, lp, base, count in zip(*(batch.column(c).to_pylist() for c in columns)):
                d, k = np.frombuffer(d, np.uint16), weights[np.frombuffer(b, np.uint8)]
                score = np.bincount(d, weights=np.log(1 - k + k * np.frombuffer(r, np.float32)))
                if lp:
                    score = score + np.frombuffer(lp)
                for c, x in zip(out, (slice_id, b"", score.tobytes(), base, count)):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["slice"], pa.int64()), *[pa.array(out[c], pa.binary()) for c in list(out)[1:]]], list(out))

    n_train = n

    def whole(table: pa.Table) -> pa.Table:
        infos = [x for x in table.column("info").to_pylist() if x]
        info = pa.ipc.open_stream(infos[0]).read_all()
        size = info.num_rows
        score, base, known_ = (np.asarray(info.column(c)).astype(np.float64).copy() for c in ("lp", "base", "known"))
        for s, b, k in zip(*(table.column(c).to_pylist() for c in ("score", "base", "known"))):
            for total, raw, dtype in ((score, s, np.float64), (base, b, np.float64), (known_, k, np.int32)):
                x = np.frombuffer(raw, dtype)
                total[: len(x)] += x
        return pa.table({
            "doc_id": info.column("id"), "held_out": info.column("held"), "n_tokens": pa.array(np.asarray(info.column("n")), pa.int64()), "n_known": pa.array(np.rint(known_).astype(np.int64)),
            "train_tokens": pa.array(np.full(size, n_train, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(score / np.log(10)),
        })

    empty = F.lit(b"")
    parts = results.filter(F.col("kind") == READY).select("slice", "d", "b", "r", "lp", "base", "known").mapInArrow(partial, "slice bigint, info binary, score binary, base binary, known binary")
    about = second.filter(F.col("kind") == ABOUT).select("slice", "info", empty.alias("score"), empty.alias("base"), empty.alias("known"))
    return parts.unionByName(about).groupBy("slice").applyInArrow(whole, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
