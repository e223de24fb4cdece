"""Operator 13: alignment of the tokens of two tokenizers over the same text, by merge-path partitioning.

Tokenizer A is a byte-level BPE and reads a space and the text; tokenizer B is a piece BPE and adds that space itself. Neither has a token that goes on after a space that follows
another character, so each distinct word of a slice is encoded once. The tokens of both cut the same bytes, so a slice of documents gives two sorted lists of byte ends. Their merge is a path through the A x B grid whose length is the number of tokens. It is divided along diagonals: a binary
search on each diagonal finds where the path crosses it, so every piece has the same number of steps and can be merged without the others, wherever documents begin. All pieces of a
slice are merged in lockstep, one numpy operation a step for all of them. At each step the current A and B tokens are linked if their bytes overlap, and a place where both end closes
a group; a group that lies across pieces is stitched by the running number of closed groups over the pieces.

The number of documents that hold a pair of ids linked is counted over all rows: slices add up their pairs first, then a shuffle by pair adds the slices. The counts
go back to the documents in two ways, with the same result for either: the pairs of ids with the highest counts (at most ``head_pairs``, a bounded broadcast) are looked up where the
documents are; every other pair travels by a join. The table of pairs is bounded by the vocabularies, not by the documents.

Defined cases: a text that is null or empty, or whose A or B tokens do not spell a space and the text (B rewrites some characters), has no tokens, zeros and an empty ``groups_sha256``.
Repeated rows are documents of their own. Null and repeated ids are kept. Special tokens' strings inside a text are plain text. Extra columns do not matter. Long texts are
aligned whole, in a slice of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import work_table
from asofkit.llm.text_kernel import slices

TOKENIZERS, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE_STEPS, SLICE_BYTES, HEAD_PAIRS, MOST_HELD = 256, 1 << 19, 1 << 19, 1 << 20
CACHED_WORDS, ID_BITS = 1 << 18, 20
#: Where a space follows what no version of Unicode counts as white space. No token of either kind goes over such an edge, so words can be encoded on their own.
WORD_EDGE = re.compile(r"(?<=[^\s\u180e\u200b\ufeff▁])(?= .)", re.DOTALL)
LOOSE_END = re.compile(r"[\s\u180e\u200b\ufeff▁]\Z")


def _byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load_tokenizers(folder: str, a_file: str, b_file: str):
    """Both encoders, the bytes of every A id and the bytes of every B id."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/{a_file}")
    a.encode_special_tokens = True
    letters = _byte_letters()
    vocabulary = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}
    a_bytes = [bytes(letters[c] for c in t) if (t := vocabulary.get(i, "")) and all(c in letters for c in t) else b"" for i in range(max(vocabulary) + 1)]
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("pieces of B that go on after a space cannot be found word by word")
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return a, b, a_bytes, b_bytes


class WordTable:
    """The words a worker has met, each with its A ids, its B ids and whether both spell it; emptied when it has grown to a bound."""

    def __init__(self, folder: str, a_file: str, b_file: str):
        self.enc_a, self.enc_b, self.a_bytes, self.b_bytes = load_tokenizers(folder, a_file, b_file)
        self.a_long, self.b_long = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.spelled = [np.zeros(1 << 16, np.int64) for _ in "ab"], [np.zeros(1, np.int64) for _ in "ab"], np.zeros(0, bool)

    def look_up(self, words: list[list[str]]) -> np.ndarray:
        """The place of every word; new words are encoded."""
        if len(self.place) > CACHED_WORDS:
            self.clear()
        every, place, new = [w for doc in words for w in doc], self.place, []
        which = np.fromiter(map(place.get, every, repeat(-1)), np.int64, len(every))
        if (which < 0).any():
            missing = np.flatnonzero(which < 0)
            new = list(dict.fromkeys(every[k] for k in missing))
            closed = [w for w in new if not LOOSE_END.search(w)]
            rest = [w for w in new if LOOSE_END.search(w)]
            n = len(place)
            place.update(zip(closed + rest, range(n, n + len(new))))
            which[missing] = [place[every[k]] for k in missing]
            if closed and not self._add_joined(closed):
                rest = closed + rest
            for w in rest:
                self._add([self.enc_a.encode(w, add_special_tokens=False).ids], [self.enc_b.encode(w[1:])], w.encode())
        return which

    def _add_joined(self, words: list[str]) -> bool:
        """Encode words that do not end in white space as one text; False if B does not spell it."""
        raw = [w.encode() for w in words]
        text = "".join(words)
        a = np.array(self.enc_a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.enc_b.encode(text[1:], num_threads=1), np.int64)
        if any(b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw) for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return False
        edge = np.cumsum([len(r) for r in raw])
        for k, (ids, long) in enumerate(((a, self.a_long), (b, self.b_long))):
            ends = np.cumsum(long[ids])
            stop = np.searchsorted(ends, edge)
            if not np.array_equal(ends[stop], edge):
                raise ValueError("a token goes over the edge of a word")
            self._append(k, ids, stop + 1)
        self.spelled = np.append(self.spelled, np.ones(len(words), bool))
        return True

    def _add(self, a: list[list[int]], b: list[list[int]], raw: bytes) -> None:
        for k, ids in enumerate((a[0], b[0])):
            self._append(k, np.array(ids, np.int64), np.array([len(ids)]))
        self.spelled = np.append(self.spelled, b"".join([self.a_bytes[t] for t in a[0]]) == raw == b"".join([self.b_bytes[t] for t in b[0]]))

    def _append(self, k: int, ids: np.ndarray, stop: np.ndarray) -> None:
        used = int(self.start[k][-1])
        while used + len(ids) > len(self.ids[k]):
            self.ids[k] = np.concatenate((self.ids[k], np.zeros_like(self.ids[k])))
        self.ids[k][used : used + len(ids)] = ids
        self.start[k] = np.concatenate((self.start[k], used + stop))

    def gather(self, k: int, which: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The A (0) or B (1) ids of the words one after another, and how many each row has."""
        start = self.start[k]
        long = start[which + 1] - start[which]
        at = np.repeat(start[which] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        return self.ids[k][at], np.bincount(row, weights=long, minlength=rows).astype(np.int64)


@lru_cache(maxsize=2)
def word_table(folder: str, a_file: str, b_file: str) -> WordTable:
    return WordTable(folder, a_file, b_file)


def merge_pieces(a_end: np.ndarray, b_end: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two rising lists of ends which have their last end in common.

    Gives the A and B places of every link in order, and the number of the group of every A and of every B token.
    """
    n, m = len(a_end), len(b_end)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    # diagonal binary searches: how many A ends lie among the first d of the merged ends (an A end before an equal B end)
    diagonal = np.arange(0, n + m, steps)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (low < high).any():
        mid = (low + high) >> 1
        open_ = low < high
        right = open_ & (a_end[np.minimum(mid, n - 1)] <= b_end[np.clip(diagonal - mid - 1, 0, m - 1)])
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    i, j = low.copy(), diagonal - low
    a_start, b_start = np.concatenate(([0], a_end[:-1])), np.concatenate(([0], b_end[:-1]))
    many = len(diagonal)
    link_a, linked = np.zeros((steps, many), np.int64), np.zeros((steps, many), bool)
    link_b, closed = np.zeros((steps, many), np.int64), np.zeros((steps, many), bool)
    for k in range(steps):
        p, q = np.minimum(i, n - 1), np.minimum(j, m - 1)
        there = (i < n) | (j < m)
        linked[k] = (i < n) & (j < m) & (a_start[p] < b_end[q]) & (b_start[q] < a_end[p])
        link_a[k], link_b[k] = p, q
        take_a = (i < n) & ((j >= m) | (a_end[p] <= b_end[q]))
        # an equal B end follows its A end on the path, so a group closes where B's is taken
        closed[k] = there & ~take_a & (i > 0) & (a_end[np.maximum(i - 1, 0)] == b_end[q])
        i, j = i + (there & take_a), j + (there & ~take_a)
    order = linked.T.ravel()
    # stitching: groups closed in earlier pieces number those of a piece; a token's group is the number closed before its end
    close_b = np.sort(link_b.T.ravel()[closed.T.ravel()])
    ends = b_end[close_b]
    return link_a.T.ravel()[order], link_b.T.ravel()[order], np.searchsorted(ends, a_end, side="left"), np.searchsorted(ends, b_end, side="left")


@lru_cache(maxsize=1)
def _decimals(ids: int) -> np.ndarray:
    return np.array([f"{i}{s}".encode() for i in range(ids) for s in ",|;"], dtype=object)


def _group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, most: int) -> np.ndarray:
    """The tokens in the order of the digest, each with its separator: the A ids of a group, then its B ids."""
    last = lambda g: np.concatenate((g[1:] != g[:-1], [True])) if len(g) else np.zeros(0, bool)
    part = np.concatenate((3 * a.astype(np.int64) + last(group_a), 3 * b.astype(np.int64) + 2 * last(group_b)))
    place = np.concatenate((np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left"), np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")))
    out = np.empty(len(part), dtype=np.int64)
    out[place] = part
    return _decimals(most)[out]


def align_slice(texts: list[str | None], folder: str, a_file: str, b_file: str, steps: int = PIECE_STEPS) -> dict[str, np.ndarray | list]:
    """Counts, digests and linked pairs (distinct by document, with how often) of a slice of texts."""
    table = word_table(folder, a_file, b_file)
    rows = len(texts)
    words = [WORD_EDGE.split(" " + t) if t else [] for t in texts]
    row = np.repeat(np.arange(rows), [len(w) for w in words])
    which = table.look_up(words)
    good = np.ones(rows, dtype=bool)
    good[row[~table.spelled[which]]] = False
    for r in np.flatnonzero(~good):  # a word that is not spelled: the whole text decides
        mine, raw = which[row == r], (" " + texts[r]).encode()
        good[r] = all(b"".join([x[t] for t in table.gather(k, mine, mine * 0, 1)[0]]) == raw for k, x in enumerate((table.a_bytes, table.b_bytes)))
    which, row = which[good[row]], row[good[row]]
    (a, n_a), (b, n_b) = (table.gather(k, which, row, rows) for k in (0, 1))
    a_long, b_long = table.a_long, table.b_long
    link_a, link_b, group_a, group_b = merge_pieces(np.cumsum(a_long[a]), np.cumsum(b_long[b]), steps)
    row_a = np.repeat(np.arange(rows), n_a)
    link_row = row_a[link_a] if len(link_a) else np.zeros(0, np.int64)
    edge_a = np.concatenate(([0], np.cumsum(n_a)))
    filled = n_a > 0
    n_groups = np.zeros(rows, np.int64)
    n_groups[filled] = group_a[edge_a[1:][filled] - 1] - group_a[edge_a[:-1][filled]] + 1
    parts = _group_texts(a, b, group_a, group_b, max(len(a_long), len(b_long)))
    edge = np.concatenate(([0], np.cumsum(n_a + n_b)))
    digest = [hashlib.sha256(b"".join(parts[edge[r] : edge[r + 1]])[:-1]).hexdigest() if filled[r] else "" for r in range(rows)]
    # one number orders the links by row and pair
    key = np.sort((link_row << 2 * ID_BITS) | (a[link_a] << ID_BITS) | b[link_b]) if len(link_a) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(link_row, minlength=rows), "groups_sha256": digest,
        "pair": key[first] & ((1 << 2 * ID_BITS) - 1), "pair_row": key[first] >> 2 * ID_BITS, "times": np.diff(np.concatenate((first, [len(key)]))),
    }


def align_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE, steps: int = PIECE_STEPS) -> DataFrame:
    """Per document: its id, a row key (``part, place``), the counts, the digest, and its distinct linked pairs: ``pairs`` (the id of A, shifted by ID_BITS, and that of B; eight bytes) and ``times``."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for x in slices(batch, "text", SLICE_BYTES):
                got = align_slice(x.column("text").to_pylist(), folder, a_file, b_file, steps)
                n = x.num_rows
                edges = np.searchsorted(got["pair_row"], np.arange(n + 1))
                packed = got["pair"].astype("<i8")
                binary = lambda v, width: pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((edges * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(v))]).cast(pa.binary())
                columns = [x.column("id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), *(pa.array(got[c], pa.int64()) for c in counts), pa.array(got["groups_sha256"], pa.string()), binary(packed, 8), binary(got["times"].astype("<i4"), 4)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "place", *counts, "groups_sha256", "pairs", "times"])
                place += n

    schema = f"id {kind}, part int, place bigint, {', '.join(f'{c} bigint' for c in counts)}, groups_sha256 string, pairs binary, times binary"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _sum_by_key(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def pair_counts(aligned: DataFrame, *, most_held: int = MOST_HELD) -> DataFrame:
    """Per linked pair of ids: ``pair, n`` (documents that hold it linked), ``best`` (no other pair of its A id is held by more).

    A task adds up the pairs it reads and gives them out whenever it holds ``most_held`` of them, so it never holds more than twice that many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, held = [], 0
        for batch in batches:
            for raw in batch.column("pairs"):
                waiting.append(np.frombuffer(raw.as_buffer(), "<i8"))
                held += len(waiting[-1])
                if held >= most_held:
                    new = np.concatenate(waiting)
                    key, n = _sum_by_key(np.concatenate((key, new)), np.concatenate((n, np.ones(len(new), np.int64))))
                    waiting, held = [], 0
                    if len(key) >= most_held:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])
                        key, n = key[:0], n[:0]
        new = np.concatenate([*waiting, np.zeros(0, np.int64)])
        key, n = _sum_by_key(np.concatenate((key, new)), np.concatenate((n, np.ones(len(new), np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

    summed = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    same_a = Window.partitionBy(F.shiftright("pair", ID_BITS))  # at most as many rows as B has ids
    return summed.withColumn("best", F.col("n") == F.max("n").over(same_a))


def pair_scores(docs: DataFrame, *, head_pairs: int = HEAD_PAIRS, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    aligned = work_table(align_documents(docs, id_col=id_col, **options), "aligned")
    counts = work_table(pair_counts(aligned), "pair-counts")
    # a threshold on the count, so that at most head_pairs pairs have it: the histogram of counts is added up from the top
    levels = counts.groupBy(F.floor(F.log2("n") * 8).alias("level")).count().collect()
    taken, level = 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        taken += row["count"]
        if taken > head_pairs:
            break
        level = row["level"]
    head = counts.filter(F.floor(F.log2("n") * 8) >= level) if level is not None else counts.limit(0)
    table = head.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def look_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = known.value[0]
        at = np.minimum(np.searchsorted(key, pairs), max(len(key) - 1, 0))
        return at, (key[at] == pairs) if len(key) else np.zeros(len(pairs), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, total = [], []
            for raw, often in zip(batch.column("pairs"), batch.column("times")):
                pairs, times = np.frombuffer(raw.as_buffer(), "<i8"), np.frombuffer(often.as_buffer(), "<i4").astype(np.int64)
                at, found = look_up(pairs)
                best.append(int(times[found] @ known.value[2][at[found]].astype(np.int64)))
                total.append(int(times[found] @ known.value[1][at[found]]))
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(best, pa.int64()), pa.array(total, pa.int64())], [*kept, "head_best", "head_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pairs = np.frombuffer(batch.column("pairs")[k].as_buffer(), "<i8")
                missing = ~look_up(pairs)[1]
                if n := int(missing.sum()):
                    times = np.frombuffer(batch.column("times")[k].as_buffer(), "<i4")[missing]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("part")[k].as_py(), np.int32)), pa.array(np.full(n, batch.column("place")[k].as_py(), np.int64)), pa.array(pairs[missing]), pa.array(times.astype(np.int64))], ["part", "place", "pair", "times"])

    rename = aligned.withColumnRenamed(id_col, "id") if id_col != "id" else aligned
    kind = rename.schema["id"].dataType.simpleString()
    scored = rename.mapInArrow(sums, f"id {kind}, part int, place bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, head_best bigint, head_sum bigint")
    tail = aligned.select("part", "place", "pairs", "times").mapInArrow(rest, "part int, place bigint, pair bigint, times bigint")
    tail = tail.join(counts, "pair").groupBy("part", "place").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("tail_best"), F.sum(F.col("times") * F.col("n")).alias("tail_sum"))
    both = scored.join(tail, ["part", "place"], "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", add("head_best", "tail_best").alias("n_best"), add("head_sum", "tail_sum").alias("count_sum"), "groups_sha256")
