"""Operator 7: document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line ends, and within lines after a word whose hash is 0 modulo 12, so that long
paragraphs fall into pieces that stay the same around an edit. Each piece has a 64-bit digest of its words; a piece that
comes again counts as another piece (digest and ordinal are hashed together). The sketch has cells of (count, xor of
digests, xor of checksums), and each digest goes into three of them.

Two sketches of one size are subtracted cell by cell; what both texts share cancels. Peeling then takes a cell that holds
a single digest, removes that digest from its cells, and goes on until nothing is left; it yields the digests that only
one of the texts has. If peeling gets stuck, the pair is tried again with twice the cells. The likeness of two texts is the number
of shared pieces over the number of all pieces; two texts without pieces are alike (1.0).

The fingerprint is the smallest sketch (18 cells and the number of pieces) in hexadecimal, which settles small differences
by itself (``likeness_of_fingerprints``); ``near_*`` go on with larger sketches of the texts where it gets stuck, and agree
with it where it does not. All texts of a slice are sketched, subtracted and peeled together in numpy.

To meet the next document, texts are dealt into ranges of ids, as many as the cluster has shuffle partitions, whatever the size of the data; the first text of each range is
also sent to the range before. Spark parts the ids alone first (``repartitionByRange``); cut points and first ids are a row for each range, and nothing that grows with the
documents reaches the driver or is broadcast. A range is sorted by Spark and read as a stream, some megabytes at a time.

Defined cases: a null text counts as empty; equal texts have equal fingerprints; repeated ids are ordered by text; null
ids come last in descending order; a single document is its own next one; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import cut
from asofkit.llm.text_kernel import mix64, scan_words

CELLS = 16
HASHES = 3
PIECE = 12


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the pieces of every text, ordered by row; digests of a row differ."""
    words = scan_words(texts)
    h, row = words.hash, words.row
    if not len(h):
        return row, h
    lines = np.concatenate(([0], np.cumsum(words.data == 10)))
    last = (h % np.uint64(PIECE) == 0) | np.concatenate((lines[words.start[1:]] != lines[words.end[:-1]], [True])) | np.concatenate((row[1:] != row[:-1], [True]))
    first = np.concatenate(([True], last[:-1]))
    begin = np.flatnonzero(first)
    ordinal = np.arange(len(h)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(h)]))))
    digest = mix64(np.add.reduceat(mix64(h + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin))
    rows = row[begin]
    order = np.lexsort((digest, rows))
    r, d = rows[order], digest[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (d[1:] != d[:-1])))
    again = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    return r, mix64(d + again.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def checksum(digest: np.ndarray) -> np.ndarray:
    return mix64(digest ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(32)


def cells_of(digest: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in each third-sized part (so that they differ)."""
    part = cells // HASHES
    return np.stack([(mix64(digest + np.uint64(k + 1)) % np.uint64(part)).astype(np.int64) + k * part for k in range(HASHES)], axis=1)


class Sketches:
    """Sketches of many texts side by side: arrays of rows x cells."""

    def __init__(self, rows: int, cells: int):
        self.n, self.cells = rows, cells
        self.count = np.zeros(rows * cells, dtype=np.int64)
        self.key = np.zeros(rows * cells, dtype=np.uint64)
        self.check = np.zeros(rows * cells, dtype=np.uint64)

    def add(self, row: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = (cells_of(digest, self.cells) + (row * self.cells)[:, None]).ravel()
        np.add.at(self.count, at, np.repeat(np.broadcast_to(sign, len(row)), HASHES))
        np.bitwise_xor.at(self.key, at, np.repeat(digest, HASHES))
        np.bitwise_xor.at(self.check, at, np.repeat(checksum(digest), HASHES))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, side) of the recovered digests (side +1 or -1), and which rows came out whole. Empties the sketch."""
        rows, digests, sides = [], [], []
        while True:
            single = np.flatnonzero((np.abs(self.count) == 1) & (checksum(self.key) == self.check))
            if not len(single):
                break
            row, digest, side = single // self.cells, self.key[single], self.count[single]
            home = (cells_of(digest, self.cells) + (row * self.cells)[:, None] == single[:, None]).any(axis=1)
            pairs = np.stack((row[home].astype(np.uint64), digest[home]), axis=1)
            if not len(pairs):
                break
            _, once = np.unique(pairs, axis=0, return_index=True)  # a digest may be alone in several of its cells
            row, digest, side = row[home][once], digest[home][once], side[home][once]
            self.add(row, digest, -side)
            rows.append(row)
            digests.append(digest)
            sides.append(side)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = ~left.reshape(self.n, self.cells).any(axis=1)
        empty = np.zeros(0, np.int64)
        return (np.concatenate(rows) if rows else empty, np.concatenate(digests) if rows else empty.astype(np.uint64), np.concatenate(sides) if rows else empty, whole)

    def text(self, sizes: np.ndarray) -> list[str]:
        count = self.count.reshape(self.n, self.cells)
        key = self.key.reshape(self.n, self.cells)
        check = self.check.reshape(self.n, self.cells).astype(np.uint32)
        return [np.int64(sizes[i]).tobytes().hex() + (count[i] % 65536).astype(np.uint16).tobytes().hex() + key[i].tobytes().hex() + check[i].tobytes().hex() for i in range(self.n)]


def sketch_size(cells: int) -> int:
    return -(-cells // HASHES) * HASHES


def fingerprints(parts: tuple[np.ndarray, np.ndarray], rows: int) -> list[str]:
    s = Sketches(rows, sketch_size(CELLS))
    s.add(*parts)
    return s.text(np.bincount(parts[0], minlength=rows))


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int, cells: int = 64) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """How many pieces only ``a`` has and only ``b`` has, per row, by subtraction and peeling with growing sketches; and the pieces: (row, digest, whether ``a`` has it)."""
    only_a, only_b = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))]
    todo = np.arange(rows)
    while len(todo):
        number = np.full(rows, -1)
        number[todo] = np.arange(len(todo))
        # rows whose texts are long are worked off in portions, which bounds the sketches held at once
        step = max(1, (1 << 21) // cells)
        again = []
        for k in range(0, len(todo), step):
            part = todo[k : k + step]
            sides = []
            for row, digest in (a, b):
                on = (number[row] >= k) & (number[row] < k + len(part))
                s = Sketches(len(part), sketch_size(cells))
                s.add(number[row[on]] - k, digest[on])
                sides.append(s)
            row, digest, side, whole = sides[0].minus(sides[1]).peel()
            sure = whole[row]
            np.add.at(only_a, part[row[(side > 0) & sure]], 1)
            np.add.at(only_b, part[row[(side < 0) & sure]], 1)
            found.append((part[row[sure]], digest[sure], side[sure] > 0))
            again.append(part[~whole])
        todo = np.concatenate(again)
        cells *= 2
    return only_a, only_b, tuple(np.concatenate(x) for x in zip(*found))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    return _alike(a, differences(a, b, rows), rows)


def _alike(a: tuple[np.ndarray, np.ndarray], differing: tuple, rows: int) -> np.ndarray:
    only_a, only_b, _ = differing
    n_a = np.bincount(a[0], minlength=rows)
    common = n_a - only_a
    every = common + only_a + only_b
    return np.where(every > 0, common / np.maximum(every, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def likeness_of_fingerprints(a: str, b: str) -> float | None:
    """The likeness of two texts from their fingerprints alone; None if they differ in too much for the smallest sketch."""
    cells, sides, sizes = sketch_size(CELLS), [], []
    for text in (a, b):
        raw = bytes.fromhex(text)
        sizes.append(int(np.frombuffer(raw[:8], np.int64)[0]))
        s, at = Sketches(1, cells), 8
        s.count = np.frombuffer(raw[at : at + 2 * cells], np.int16).astype(np.int64)
        s.key = np.frombuffer(raw[at + 2 * cells : at + 10 * cells], np.uint64)
        s.check = np.frombuffer(raw[at + 10 * cells :], np.uint32).astype(np.uint64)
        sides.append(s)
    _, _, side, whole = sides[0].minus(sides[1]).peel()
    if not whole[0]:
        return None
    only_a, only_b = int((side > 0).sum()), int((side < 0).sum())
    every = sizes[0] + only_b
    return (sizes[0] - only_a) / every if every else 1.0


def _cut_points(ids: DataFrame, ranges: int) -> list:
    """The least id of every range but the first, ascending: at most ``ranges`` values."""
    parted = ids.filter("doc_id is not null").repartitionByRange(ranges, "doc_id").select("doc_id", F.spark_partition_id().alias("p"))
    least = parted.groupBy("p").agg(F.min("doc_id").alias("least")).collect()
    return sorted(r["least"] for r in least)[1:]


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """``doc_id, text, part, last``: ranges of descending ids; every range also has the first rows of the following one (``last``)."""
    spark = docs.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = cut(source.select("doc_id"))
    cuts = _cut_points(ids, ranges)
    sent = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def part_of(id_: pd.Series) -> pd.Series:  # only the ids go to Python; NULL comes last
        points, known = np.asarray(sent.value, dtype=object if id_.dtype == object else None), id_.notna()
        out = pd.Series(len(points), index=id_.index)
        if len(points) and known.any():
            out[known] = len(points) - np.searchsorted(points, id_[known].to_numpy(), side="right")
        return out.astype("int32")

    placed = ids.select("doc_id", part_of("doc_id").alias("part"))
    heads = placed.groupBy("part").agg(F.max("doc_id").alias("head"), F.lit(1).alias("one"))
    order = Window.orderBy("part")  # a row for each range
    to = F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy("one")))
    heads = cut(heads.select("part", "head", to.alias("to")))
    rows = source.withColumn("part", part_of("doc_id"))
    found = rows.join(F.broadcast(heads.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("last"))
    copies = F.when(F.col("to").isNotNull(), F.array(own, F.struct(F.col("to").alias("part"), F.lit(True).alias("last")))).otherwise(F.array(own))
    return found.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.part", "c.last")


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000, ranges: int | None = None, digests: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    With ``digests`` also ``removed`` and ``added``: the digests of the pieces that only the text and only the edited text have, recovered from the sketches.
    """
    rows = with_next(docs, id_col, text_col, ranges)
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = rows.repartition(F.col("part")).sortWithinPartitions("part", "last", F.col("doc_id").desc_nulls_last(), "text")

    id_type = None

    def work(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        n = len(ids)
        edited = [edited_text(t, f) for t, f in zip(texts, following)]
        own, changed, after = (pieces(pa.array(x, pa.large_string())) for x in (texts, edited, following))
        differing = differences(own, changed, n)
        columns = [
            pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(fingerprints(own, n)), pa.array(fingerprints(changed, n)), pa.array(_alike(own, differing, n)), pa.array(likeness(own, after, n)),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        if digests:
            row, digest, here = differing[2]
            order = np.lexsort((digest.astype(np.int64), row))
            row, digest, here = row[order], digest[order].astype(np.int64), here[order]
            for name, side in (("removed", here), ("added", ~here)):
                edges = np.searchsorted(row[side], np.arange(n + 1))
                columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(digest[side], pa.int64())))
                names.append(name)
        return pa.RecordBatch.from_arrays(columns, names)

    def compare(batches):
        nonlocal id_type
        ids, texts, following, chars, part, held = [], [], [], 0, None, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text, p, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "last"))):
                if p != part:
                    part, held, closed = p, None, False
                if held is not None and not closed:
                    ids.append(held[0])
                    texts.append(held[1])
                    following.append(text)
                    chars += 3 * len(held[1])
                closed = closed or last  # of several rows that begin the next part, the first follows
                held = (doc_id, text)
                if chars > slice_chars:
                    yield work(ids, texts, following)
                    ids, texts, following, chars = [], [], [], 0
        if ids:
            yield work(ids, texts, following)

    out = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + (", removed array<bigint>, added array<bigint>" if digests else "")
    return ordered.select("doc_id", "text", "part", "last").mapInArrow(compare, out)
