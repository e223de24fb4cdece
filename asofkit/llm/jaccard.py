"""Operator 4: exact n-gram Jaccard join by size-banded tiles, hashed bitmap signatures and sorted-array intersection.

A document is the set of its hashed shingles. Documents of equal sets form one class, and only classes are compared.

*Tiles.* Sizes are cut into bands so wide that a linked pair lies in one band or in two neighbouring ones. In a band of
sets up to u shingles, linked sets differ in at most d = floor(2u(1-t)/(1+t)) shingles, so if the shingles are dealt by
hash into m > d slices, m - d slices at least are equal in both. A tile is (band, slice, digest of the slice's shingles):
any linked pair shares a tile that is not empty, and hardly any other pair does.

*Links.* Each class first leaves out the most frequent tiles that it can spare (``shared_tiles``). In every tile the members
are compared with the smallest member only (a star), first by bitmaps: two rows of hashed bits, four or more for each
shingle, bound the overlap from above, because every bit set in one but not in the other stands for at least one shingle
that the other lacks. Pairs that may still reach the threshold get the exact intersection of their sorted arrays.
Verified pairs are joined to components. Tiles whose members still belong to several components are not done: there, but
for the smallest member, which met all others, each member is compared with all members of other components, in blocks
and in the same two steps. No link between components is lost, and pairs inside a component are never made.

*Hashes.* Shingles and classes are known by 64-bit hashes. That two given ones share a hash by chance has a probability of
2**-64; among n classes a wrong pair is to be expected n * n / 2**65 times, which is 3e-6 for ten million different texts.

Defined cases: null texts and texts without words have the empty set and are linked with nothing; texts of fewer words
than a shingle have one shingle, the whole sequence; equal sets are linked; repeated rows are members of one class; null
ids are ignored when the smallest id is taken; empty tables give empty results; extra columns are ignored by
``link_documents`` and kept by ``keep_representatives``.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import cut, work_table
from asofkit.llm.text_kernel import mix64, scan_words, slices, sort_within_rows

LEAST_BITS, MOST_BITS = 512, 1 << 17
TILES_PER_PART = 1_500_000


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, ordered by row, then hash."""
    words = scan_words(texts)
    h, row = words.hash, words.row
    weights = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(n)]
    m = max(len(h) - n + 1, 0)
    value = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        value += h[k : k + m] * weights[k]
    whole = row[:m] == row[n - 1 : n - 1 + m]
    rows, values = row[:m][whole], mix64(value[whole])
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(row, short)
        value = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            on = counts[short] > k
            value[on] += h[first[on] + k] * weights[k]
        rows = np.concatenate((rows, short))
        values = np.concatenate((values, mix64(value + counts[short].astype(np.uint64))))
    order = sort_within_rows(rows, values)
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def band_edges(threshold: Fraction, most: int) -> np.ndarray:
    """Lower edges of the size bands, the last above ``most``; a pair that links never skips a band."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(int(edges[-1] / threshold) + 1)
    return np.asarray(edges, dtype=np.int64)


def slices_of_band(threshold: Fraction, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of slices, most differences d) of each band; no slices (0) where every shingle is a slice of its own.

    With d + 1 slices one is equal. More are dealt, so that more are equal than a set is likely to have empty slices (four
    deviations above the mean): then an equal slice that is not empty exists, and empty ones need no tile. Where the sets
    are too small for that, a slice is one shingle.
    """
    n_slices, most = [], []
    for k, upper in enumerate(edges[1:]):
        d = int(2 * (int(upper) - 1) * (1 - threshold) / (1 + threshold))
        smallest, m = int(edges[max(k - 1, 0)]), d + 1
        while 1.2 * m <= smallest:
            empty = m * math.exp(-smallest / m)
            more = d + 1 + math.ceil(empty + 4 * math.sqrt(empty))
            if more <= m:
                break
            m = more
        n_slices.append(m if 1.2 * m <= smallest else 0)
        most.append(d)
    return np.asarray(n_slices, dtype=np.int64), np.asarray(most, dtype=np.int64)


def tiles_of(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tile, mark) for the own and the next band of every set that has shingles.

    Of m slices of a linked pair at least m - d are equal. A set with fewer than m - d empty slices shares a slice that is
    not empty with each partner, and sends only those; other sets (hardly any) send all, and so meet each other in any case.

    With e empty slices, a set shares m - d - e tiles at least with each partner in that band, and where every shingle is a
    slice, the shingles that it must have in common; so it can spare one tile less than that. ``mark`` holds this number
    (127 at most, as a smaller one is true as well), plus 128 in the next band.
    """
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    edges = band_edges(threshold, int(sizes.max()) * 2)
    n_slices, most = slices_of_band(threshold, edges)
    band = np.searchsorted(edges, np.maximum(sizes, 1), side="right") - 1
    out_row, out_tile, out_mark = [], [], []
    dealt = mix64(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)
    overlap = -(-threshold.numerator * sizes // threshold.denominator)  # shingles shared with any partner
    for step in (0, 1):
        k = band + step
        m = np.where(sizes > 0, n_slices[k], 0)
        sliced = m[rows] > 0
        r, v = rows[sliced], values[sliced]
        edge = np.concatenate(([0], np.cumsum(m)))
        slot = edge[r] + (dealt[sliced] % m[r].astype(np.uint64)).astype(np.int64)
        digest = np.zeros(edge[-1], dtype=np.uint64)
        np.add.at(digest, slot, mix64(v))
        empty = np.bincount(slot, minlength=edge[-1]) == 0
        row = np.repeat(np.arange(len(sizes)), m)
        place = np.arange(edge[-1]) - edge[row]
        tag = lambda at, place: mix64((k[at].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))  # noqa: B023, E731
        shares = np.where(m > 0, m - most[k] - np.bincount(row[empty], minlength=len(sizes)), overlap)
        send = ~empty | (shares <= 0)[row]
        mark = (np.clip(shares - 1, 0, 127) + 128 * step).astype(np.uint8)
        alone = rows[~sliced]
        out_row += [row[send], alone]
        out_tile += [mix64(digest ^ tag(row, place))[send], mix64(mix64(values[~sliced]) ^ tag(alone, np.full(len(alone), -2)))]
        out_mark += [mark[row[send]], mark[alone]]
    return np.concatenate(out_row), np.concatenate(out_tile), np.concatenate(out_mark)


def may_link(size_a: np.ndarray, a: np.ndarray, size_b: np.ndarray, b: np.ndarray, threshold: Fraction) -> np.ndarray:
    """From bitmaps of one width (rows of bytes): can the pair reach the threshold?"""
    x, y = a.view(np.uint64), b.view(np.uint64)
    only_a = np.bitwise_count(x & ~y).sum(axis=1).astype(np.int64)
    only_b = np.bitwise_count(y & ~x).sum(axis=1).astype(np.int64)
    overlap = np.minimum(size_a - only_a, size_b - only_b)
    return overlap * threshold.denominator >= threshold.numerator * (size_a + size_b - overlap)


def bitmaps(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The set size as 8 bytes, then a bitmap of four to eight bits a shingle (a power of two from 512 to 131,072)."""
    width = np.left_shift(1, np.ceil(np.log2(np.clip(4 * sizes, LEAST_BITS, MOST_BITS))).astype(np.int64))
    edge = np.concatenate(([0], np.cumsum(width // 8)))
    bits = np.zeros(edge[-1], dtype=np.uint8)
    place = (mix64(values + np.uint64(0x2545F4914F6CDD1D)) % width[rows].astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(bits, edge[rows] + (place >> 3), (1 << (place & 7)).astype(np.uint8))
    return [int(n).to_bytes(8, "little") + bits[edge[r] : edge[r + 1]].tobytes() for r, n in enumerate(sizes)]


def by_width(maps: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, set sizes, bits) of the bitmaps of each width."""
    length = np.asarray([len(m) for m in maps], dtype=np.int64)
    out = []
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        rows = np.frombuffer(b"".join(maps[i] for i in at), dtype=np.uint8).reshape(len(at), n)
        out.append((at, rows[:, :8].copy().view(np.int64)[:, 0], rows[:, 8:].copy()))
    return out


def fold(bits: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bitmaps brought to a smaller width, as if they had been made with it: bits were dealt modulo a power of two."""
    return np.ascontiguousarray(np.bitwise_or.reduce(bits.reshape(len(bits), -1, n_bytes), axis=1))


def bitmaps_may_link(p: list[bytes], i: np.ndarray, q: list[bytes], j: np.ndarray, threshold: Fraction, step_bytes: int = 1 << 24) -> np.ndarray:
    """For pairs (p[i], q[j]) of bitmaps of any widths: can the pair reach the threshold? Worked off in bounded portions."""
    ok = np.zeros(len(i), dtype=bool)
    spot_p, spot_q = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
    widths_p, widths_q = by_width(p), by_width(q)
    kind_p, kind_q = np.zeros(len(p), np.int64), np.zeros(len(q), np.int64)
    for spot, kind, widths in ((spot_p, kind_p, widths_p), (spot_q, kind_q, widths_q)):
        for k, (at, _, _) in enumerate(widths):
            spot[at], kind[at] = np.arange(len(at)), k
    for kp, (_, size_p, bits_p) in enumerate(widths_p):
        for kq, (_, size_q, bits_q) in enumerate(widths_q):
            pair = np.flatnonzero((kind_p[i] == kp) & (kind_q[j] == kq))
            if not len(pair):
                continue
            n = min(bits_p.shape[1], bits_q.shape[1])
            x, y = fold(bits_p, n), fold(bits_q, n)
            step = max(1, step_bytes // n)
            for k in range(0, len(pair), step):
                part = pair[k : k + step]
                at_p, at_q = spot_p[i[part]], spot_q[j[part]]
                ok[part] = may_link(size_p[at_p], x[at_p], size_q[at_q], y[at_q], threshold)
    return ok


def class_digests(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    digest = np.zeros(len(sizes), dtype=np.uint64)
    np.add.at(digest, rows, mix64(values ^ np.uint64(0xA0761D6478BD642F)))
    return mix64(digest + sizes.astype(np.uint64)).astype(np.int64)


def class_table(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``doc_id, text_key, cls, n_shingles, bitmap``. ``cls`` is a digest of the set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, values = shingle_sets(batch.column("text"), shingle)
                sizes = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
                cls, maps = class_digests(rows, values, sizes), bitmaps(rows, values, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(np.where(sizes > 0, cls, 0), mask=sizes == 0), pa.array(sizes), pa.array(maps, pa.binary())],
                    ["doc_id", "text_key", "cls", "n_shingles", "bitmap"],
                )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    return source.mapInArrow(build, f"doc_id {kind}, text_key bigint, cls bigint, n_shingles bigint, bitmap binary")


def shared_tiles(docs: DataFrame, shingle: int, threshold: Fraction, n_parts: int, text_col: str) -> DataFrame:
    """``tile, cls, least`` for the members of all tiles with several classes; ``least`` is the tile's smallest class.

    Tiles travel once, packed by part: a row holds the tiles and classes of a whole slice of texts for one part.

    Each class leaves out the most frequent tiles that it can spare. Tiles have one order everywhere, by frequency and
    number. If linked sets share r tiles, the first of these in that order is followed by r - 1 more of each set, so it is
    not among the r - 1 last of either: the pair still meets. A passage that many documents share makes frequent tiles.
    """

    def deal(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                rows, values = shingle_sets(batch.column("text"), shingle)
                sizes = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
                cls = class_digests(rows, values, sizes)
                one = np.zeros(batch.num_rows, dtype=bool)  # copies within the slice send their tiles once
                one[np.unique(cls, return_index=True)[1]] = True
                keep = one[rows]
                row, tile, mark = tiles_of(rows[keep], values[keep], np.where(one, sizes, 0), threshold)
                part = (mix64(tile) % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(n_parts + 1))
                tile, member, mark = tile[order], cls[row[order]], mark[order]
                used = np.flatnonzero(np.diff(edge))
                cut_ = lambda a: pa.array([a[edge[p] : edge[p + 1]].tobytes() for p in used], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), cut_(tile), cut_(member), cut_(mark)], ["part", "tiles", "classes", "marks"])

    def meet(table: pa.Table) -> pa.Table:
        tile, cls, mark = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("tiles", np.int64), ("classes", np.int64), ("marks", np.uint8)))
        order = np.lexsort((cls, tile))
        tile, cls, mark = tile[order], cls[order], mark[order]
        new = np.concatenate(([True], (tile[1:] != tile[:-1]) | (cls[1:] != cls[:-1])))  # copies in other slices send the same
        tile, cls, mark = tile[new], cls[new], mark[new]
        begin = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        members = np.repeat(np.diff(np.concatenate((begin, [len(tile)]))), np.diff(np.concatenate((begin, [len(tile)]))))
        several = members > 1
        return pa.table({"tile": tile[several], "cls": cls[several], "mark": mark[several].astype(np.int16), "members": members[several]})

    packs = docs.select(F.col(text_col).alias("text")).mapInArrow(deal, "part int, tiles binary, classes binary, marks binary")
    met = packs.groupBy("part").applyInArrow(meet, "tile bigint, cls bigint, mark smallint, members bigint")
    # a class has no more tiles than its text has words
    place = F.row_number().over(Window.partitionBy("cls", "mark").orderBy(F.col("members").desc(), F.col("tile").desc()))
    kept = cut(met.withColumn("place", place).filter(F.col("place") > F.col("mark").bitwiseAND(F.lit(127).cast("smallint"))).select("tile", "cls"))
    several = kept.groupBy("tile").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).filter("least <> most").select("tile", "least")
    return kept.join(several, "tile")


def _bloom(wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (2**25 bits) of the wanted classes; full bitmaps cost time, never a class."""
    at = F.pmod("cls", F.lit(1 << 25))
    words = wanted.groupBy(F.shiftright(at, 5).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << 20, dtype=np.uint32)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("bits")).astype(np.uint32)
    return out


def set_table(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``cls, shingles`` (sorted 64-bit hashes as bytes) for the classes in ``wanted`` (cls).

    The texts stay where they are: tasks send the sets whose class may be wanted by the bitmap, and a join settles it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def build(batches):
        bits = sent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, values = shingle_sets(batch.column("text"), shingle)
                sizes = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
                cls = class_digests(rows, values, sizes)
                at = cls % (1 << 25)
                may = (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1
                one = np.zeros(batch.num_rows, dtype=bool)
                one[np.unique(cls, return_index=True)[1]] = True  # copies within the slice go once
                edge = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                use = np.flatnonzero((may > 0) & one & (sizes > 0))
                yield pa.RecordBatch.from_arrays([pa.array(cls[use]), pa.array([values[edge[r] : edge[r + 1]].tobytes() for r in use], pa.binary())], ["cls", "shingles"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(build, "cls bigint, shingles binary")
    return found.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def _bitmap_filter(pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) whose bitmaps let them reach the threshold."""
    maps = classes.select("cls", "bitmap")
    both = pairs.join(maps.withColumnsRenamed({"cls": "a", "bitmap": "map_a"}), "a").join(maps.withColumnsRenamed({"cls": "b", "bitmap": "map_b"}), "b")

    def check(batches):
        for batch in batches:
            every = np.arange(batch.num_rows)
            ok = bitmaps_may_link(batch.column("map_a").to_pylist(), every, batch.column("map_b").to_pylist(), every, threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "map_a", "map_b").mapInArrow(check, "a bigint, b bigint")


def _exact(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) that reach the threshold, by intersection of their sorted arrays."""
    sets = work_table(sets, "arrays")
    both = pairs.join(sets.withColumnsRenamed({"cls": "a", "shingles": "set_a"}), "a").join(sets.withColumnsRenamed({"cls": "b", "shingles": "set_b"}), "b")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common * threshold.denominator >= threshold.numerator * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(check, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``cls, component`` (smallest member) of every node of the links, by alternating large and small stars.

    Each round hangs neighbours under the smallest node they know; the links stay about as many, and long chains
    shorten by halves. Rounds end when no link changes. A node of many links is only ever grouped by a running minimum.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = e.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    state = None
    while True:
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("component")).distinct())


def _tile_pairs(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """Which members of one block share a tile with which of another, from their lists of tiles."""
    tiles, member = (np.concatenate((np.concatenate(p), np.concatenate(q))), np.concatenate((np.repeat(np.arange(len(p)), [len(t) for t in p]), len(p) + np.repeat(np.arange(len(q)), [len(t) for t in q]))))
    order = np.argsort(tiles, kind="stable")  # members of p stay before those of q
    tiles, member = tiles[order], member[order]
    begin = np.flatnonzero(np.concatenate(([True], tiles[1:] != tiles[:-1])))
    end = np.concatenate((begin[1:], [len(tiles)]))
    met = np.zeros((len(p), len(q)), dtype=bool)
    for a, b in zip(begin, end):
        m = member[a:b]
        k = np.searchsorted(m, len(p))
        if 0 < k < len(m):
            met[np.ix_(m[:k], m[k:] - len(p))] = True
    return met


def meeting_pairs(p: list[np.ndarray], q: list[np.ndarray], label_p: np.ndarray, label_q: np.ndarray, cls_p: np.ndarray, cls_q: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of members of two blocks that share a tile and have different labels.

    Where both are the same block, each pair comes once, told by the classes and not by the places: the two copies of a
    block are collected apart from each other, so their members may stand in different orders.
    """
    met = _tile_pairs(p, q) & (label_p[:, None] != label_q[None, :])
    return np.nonzero(met & (cls_p[:, None] < cls_q[None, :]) if same else met)


def joining_links(i: np.ndarray, j: np.ndarray, label_p: np.ndarray, label_q: np.ndarray, p: pa.Array, q: pa.Array, threshold: Fraction) -> list[int]:
    """Places of pairs (i, j) that reach the threshold, by intersection of sorted arrays, and join two components that no earlier one joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        u, v = root(int(label_p[a])), root(int(label_q[b]))
        if u != v:
            x, y = (np.frombuffer(s[n].as_py(), dtype=np.uint64) for s, n in ((p, a), (q, b)))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common * threshold.denominator >= threshold.numerator * (len(x) + len(y) - common):
                parent[max(u, v)] = min(u, v)
                out.append(k)
    return out


def _late_links(shared: DataFrame, labels: DataFrame, classes: DataFrame, sets_of, threshold: Fraction, block_bytes: int = 1 << 19) -> DataFrame:
    """Links (a, b) that join different components in one tile; ``sets_of`` gives the sorted arrays of the classes asked for.

    The smallest class of each tile is left out, as its pairs are done; so tiles of two classes do not come back. Only
    tiles with several components count. Tiles with the same smallest class have mostly the same members, so they are
    worked off together: a member carries its bitmap once and the numbers of its tiles. The members are dealt by hash into
    blocks of bounded bytes, those of the largest component apart from the others, and blocks meet blocks. Pairs of one
    tile are marked, compared by bitmaps and then exactly inside a task. Of the links between two components one is given
    out, as the others change nothing, so the rows that are made are fewer than the members of the blocks. Many members are
    many blocks and many tasks.
    """
    named = shared.filter("cls <> least").join(labels, "cls", "left").select("tile", "least", "cls", F.coalesce("component", "cls").alias("label"))
    several = named.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("tile")
    # a class has no more tiles than its text has words
    members = cut(named.join(several, "tile", "left_semi").groupBy("least", "cls", "label").agg(F.collect_list("tile").alias("tiles")))
    largest = members.groupBy("least", "label").count().groupBy("least").agg(F.max(F.struct("count", "label")).alias("m")).select("least", F.col("m.label").alias("largest"))
    sets = work_table(sets_of(cut(members.select("cls").distinct())), "late-arrays")
    rows = members.join(largest, "least").join(classes.select("cls", "bitmap"), "cls").join(sets, "cls").withColumn("inside", F.col("label") == F.col("largest"))
    size = F.length("bitmap") + F.length("shingles") + 8 * F.size("tiles") + 32
    blocks_of = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, size)), F.lit(0)) / block_bytes)
    counts = rows.groupBy("least").agg(blocks_of(~F.col("inside")).alias("n_out"), blocks_of(F.col("inside")).alias("n_in"), (F.sum(size) <= block_bytes).alias("small"))
    counts = cut(counts.select("least", F.when(F.col("small"), 1).otherwise(F.col("n_out")).alias("n_out"), F.when(F.col("small"), 0).otherwise(F.col("n_in")).alias("n_in")))
    dealt = lambda n: F.pmod(F.xxhash64("cls"), n)
    block = F.when(F.col("inside") & (F.col("n_in") > 0), F.col("n_out") + dealt(F.greatest("n_in", F.lit(1)))).otherwise(dealt("n_out"))
    blocks = rows.join(counts, "least").groupBy("least", block.alias("block")).agg(F.collect_list(F.struct("cls", "label", "bitmap", "tiles", "shingles")).alias("m"))
    each = counts.select("least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1)).alias("i"), (F.col("n_out") + F.col("n_in") - 1).alias("top")).select("least", "i", F.explode(F.sequence("i", "top")).alias("j"))
    side = lambda at, m: blocks.select("least", F.col("block").alias(at), F.col("m").alias(m))
    met = each.join(side("i", "p"), ["least", "i"]).join(side("j", "q"), ["least", "j"]).select("p", "q", (F.col("i") == F.col("j")).alias("same"))

    def meet(batches):
        column = lambda m, f: np.asarray(m.field(f).to_numpy(zero_copy_only=False))
        for batch in batches:
            for p, q, same in zip(batch.column("p"), batch.column("q"), batch.column("same").to_pylist()):
                p, q = p.values, q.values
                label_p, label_q, cls_p, cls_q = column(p, "label"), column(q, "label"), column(p, "cls"), column(q, "cls")
                i, j = meeting_pairs(list(column(p, "tiles")), list(column(q, "tiles")), label_p, label_q, cls_p, cls_q, same)
                ok = bitmaps_may_link(p.field("bitmap").to_pylist(), i, q.field("bitmap").to_pylist(), j, threshold)
                linked = joining_links(i[ok], j[ok], label_p, label_q, p.field("shingles"), q.field("shingles"), threshold)
                a, b = cls_p[i[ok][linked]], cls_q[j[ok][linked]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return met.mapInArrow(meet, "a bigint, b bigint").distinct()


def link_classes(docs: DataFrame, shingle: int, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, text_key, cls, n_shingles; one row per linked class: cls, component)."""
    threshold = Fraction(str(threshold))
    rows = work_table(class_table(docs, shingle, id_col, text_col), "sets")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    tiles = total * 4.4 * (1 - threshold) / (1 + threshold)  # about as many: two bands of d + 1 slices for each set
    shared = cut(shared_tiles(docs, shingle, threshold, max(24, math.ceil(tiles / TILES_PER_PART)), text_col))
    candidates = shared.select("cls").distinct()
    maps = cut(rows.join(candidates, "cls", "left_semi").groupBy("cls").agg(F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap")))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        return cut(_exact(pairs, set_table(docs, cut(_classes_of(pairs)), shingle, text_col), threshold))

    first = shared.filter("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct()
    links = verified(_bitmap_filter(first, maps, threshold))
    labels = components(links)
    late = cut(_late_links(shared, labels, maps, lambda wanted: set_table(docs, wanted, shingle, text_col), threshold))
    if late.limit(1).count():
        labels = components(links.unionByName(late))
    return rows.select("doc_id", "text_key", "cls", "n_shingles"), labels


def link_documents(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id reachable by links, itself included)."""
    rows, labels = link_classes(docs, shingle, threshold, id_col, text_col)
    named = rows.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.filter("cls is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id (then text key), with all its columns.

    Documents without words are linked with nothing and all stay.
    """
    rows, labels = link_classes(docs, shingle, threshold, id_col, text_col)
    named = rows.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls")).filter("cls is not null")
    kept = cut(named.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("m")).select(F.col("m.doc_id").alias("__id"), F.col("m.text_key").alias("__key")))
    empty = cut(rows.filter("cls is null").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    keyed = docs.withColumn("__text_key", F.xxhash64(F.col(text_col)))

    def matching(which: DataFrame) -> DataFrame:
        return keyed.join(which, keyed[id_col].eqNullSafe(which["__id"]) & (keyed["__text_key"] == which["__key"]), "left_semi")

    out = matching(kept.unionByName(empty))
    repeated = rows.filter("cls is not null").groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    if repeated:  # rows equal in id and text: one of them stays
        out = matching(empty).unionByName(matching(kept).dropDuplicates([id_col, "__text_key"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
