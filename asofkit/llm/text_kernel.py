"""Vectorised word scanning over Arrow string columns, used inside Arrow tasks.

Texts are handled as one flat byte buffer: A-Z is lower-cased by a table, word edges come from a byte mask,
and every word gets a 64-bit hash. Bytes of 0x80 and above always belong to words, so the byte view
and the character view of the separators agree in UTF-8. A null text has no bytes and therefore no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of the space-separated kind: everything but space and \x09-\x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of letters and digits: 0-9, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LANE_KEY, _LANE_STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def hash_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (lengths of 1 and more).

    A span is read in lanes of eight bytes, the last filled up with zeros; each lane is mixed with its number, and the mixed lanes
    are summed. Lanes of different value or place mix to unrelated numbers, so there is no family of texts that collide;
    two given spans share a hash by chance only, once in 2**64.
    """
    lanes = (length + 7) >> 3
    edge = np.cumsum(lanes) - lanes
    place = np.arange(int(lanes.sum())) - np.repeat(edge, lanes)
    at = np.repeat(start, lanes) + 8 * place
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    every = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes that begin at each byte
    over = np.clip(at + 8 - np.repeat(start + length, lanes), 0, 7).astype(np.uint64)
    value = every[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (over << np.uint64(3)))
    mixed = mix64((value ^ _LANE_KEY) + mix64(place.astype(np.uint64) * _LANE_STEP))
    return mix64(np.add.reduceat(mixed, edge) + length.astype(np.uint64))


@dataclass
class Words:
    """The words of a slice of texts: for each word its row, byte edges within the slice, and hash."""

    rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about ``most`` text bytes; a longer text comes alone, whole."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and their offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def scan_words(texts: pa.Array, is_word: np.ndarray = SPACED, *, lower: bool = True) -> Words:
    data, offsets = flat(texts)
    data = _LOWER[data] if lower else data
    n = len(data)
    inside = is_word[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True  # a text begins here; empty texts share the place of the next one
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    length = end - start
    row = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return Words(len(offsets) - 1, row, start, end, np.zeros(0, np.uint64), data, offsets)
    return Words(len(offsets) - 1, row, start, end, hash_spans(data, start, length), data, offsets)


def chars_before(data: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte place (length n + 1)."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def sort_within_rows(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by (row, key); rows number at most a slice's texts."""
    order = np.argsort(key)
    small = row[order].astype(np.uint16) if (len(row) == 0 or int(row.max()) < 65536) else row[order]
    return order[np.argsort(small, kind="stable")]
