"""Operator 6: sharding by a Feistel permutation with cycle walking, in DataFrame operations only.

Rows get global numbers 0..n-1 in the order of a hash of their id: rows are counted per hash prefix, the counts are
added up to offsets, and each prefix is numbered by itself. An alternating Feistel network over the smallest power of
two that holds n permutes the numbers; a number that lands at n or above walks on through the permutation until it
falls below n. Shard and slot of a row are then ``number mod shards`` and ``number div shards``, which anyone can
compute from the row number, the row count and the key alone. Shard sizes differ by one row at most (law ``rows``).

Defined cases: a null text has no bytes (size 1) and a null checksum; a null id is numbered with the hash of the empty
string; rows with the same id are ordered by text checksum and size, and rows equal in all of these are
interchangeable; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import cut

ROUND_KEYS = (40503, 10007, 31337, 27449, 52711, 61843)
PRIME = 2147483647
ROWS_PER_PREFIX = 250_000
WALKS = 128


def _round(half: Column, key: Column) -> Column:
    """A keyed mixing of a half; all values stay below 2**62, so no engine overflows."""
    x = (half % PRIME * 1103515 + key * 7919 + 12345) % PRIME
    x = (x * (x % 65521 + key)) % PRIME
    return (x * 48271 + F.shiftright(x, 15)) % PRIME


def feistel(number: Column, bits: int, keys=ROUND_KEYS) -> Column:
    """Permute 0..2**bits-1. Halves need not be equal: each round changes one half by a function of the other."""
    low = bits // 2
    high_mask, low_mask = F.lit((1 << (bits - low)) - 1), F.lit((1 << low) - 1)

    def turn(h: Column, k: Column) -> Column:
        first = F.struct(h["l"].bitwiseXOR(_round(h["r"], k["key"]).bitwiseAND(high_mask)).alias("l"), h["r"].alias("r"))
        second = F.struct(h["l"].alias("l"), h["r"].bitwiseXOR(_round(h["l"], k["key"]).bitwiseAND(low_mask)).alias("r"))
        return F.when(k["left"], first).otherwise(second)

    halves = F.struct(F.shiftright(number, low).cast("long").alias("l"), number.bitwiseAND(low_mask).cast("long").alias("r"))
    rounds = F.array(*[F.struct(F.lit(key).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, key in enumerate(keys)])
    return F.aggregate(rounds, halves, turn, lambda h: F.shiftleft(h["l"], low).bitwiseOR(h["r"]))


def permute(number: Column, n: int, keys=ROUND_KEYS) -> Column:
    """The place of row ``number`` of ``n`` rows. Each walk leaves with a chance above one half; WALKS walks are allowed."""
    bits = max(2, math.ceil(math.log2(max(n, 2))))
    size = F.lit(n).cast("long")
    walked = F.aggregate(
        F.array(*[F.lit(i) for i in range(WALKS)]), feistel(number, bits, keys), lambda at, _: F.when(at < size, at).otherwise(feistel(at, bits, keys))
    )
    return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Add ``row_number`` 0..n-1 in the order of ``order``, whose first column is a hexadecimal hash.

    Only hash prefixes (one for every few hundred thousand rows) pass through one task; rows are numbered in parallel.
    """
    digits = max(2, math.ceil(math.log(max(n / ROWS_PER_PREFIX, 1), 16)))
    rows = rows.withColumn("prefix", F.substring(order[0], 1, digits))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("prefix").count().select("prefix", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = rows.withColumn("in_prefix", F.row_number().over(Window.partitionBy("prefix").orderBy(*order)))
    return local.join(offsets, "prefix").withColumn("row_number", F.col("offset") + F.col("in_prefix") - 1).drop("prefix", "in_prefix", "offset")


def shard_rows(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", keys=ROUND_KEYS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard``."""
    text = F.col(text_col)
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("id_hash"),
    ))
    n = rows.count()
    place = permute(F.col("row_number"), n, keys)
    numbered = number_rows(rows, ["id_hash", "doc_id", "text_crc32", "size"], n).withColumn("place", place)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
