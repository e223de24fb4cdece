"""Content digests of tables and audits of event chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table_digest(df: DataFrame, keys: list[str], columns: list[str], prefix: int = 3) -> DataFrame:
    """``keys, digest, n``: a digest of the rows that does not depend on their order or place.

    Row hashes are digested in sorted runs by their first ``prefix`` hexadecimal digits (a run is one group; take more
    digits for larger tables), then the few run digests in order. NULL is told from an empty string.
    """
    text = F.concat_ws(chr(31), *[F.coalesce(F.col(c).cast("string"), F.lit(chr(0))) for c in columns])
    h = df.select(*keys, F.sha2(text, 256).alias("h"))
    runs = h.groupBy(*keys, F.substring("h", 1, prefix).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda r: r["d"]), "")
    return runs.groupBy(*keys).agg(F.sha2(ordered, 256).alias("digest"), F.sum("n").alias("n"))


def chained(df: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """``key, order, body, previous, event_hash`` of each key's events: every hash is that of the previous hash and the body.

    A chain depends on its whole past, so the events of a key (one ledger) are folded in order.
    """
    start = F.from_json(F.lit("[]"), "array<struct<o:bigint,body:string,previous:string,event_hash:string>>")
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(body).alias("body")))).alias("rows"))

    def add(chain, r):
        previous = F.coalesce(F.try_element_at(chain, F.lit(-1))["event_hash"], F.lit(""))
        return F.concat(chain, F.array(F.struct(r["o"].alias("o"), r["body"].alias("body"), previous.alias("previous"), F.sha2(F.concat(previous, F.lit("|"), r["body"]), 256).alias("event_hash"))))

    return rows.select(key, F.inline(F.aggregate("rows", start, add))).withColumnRenamed("o", order)


def audit_chain(ledger: DataFrame, key: str, order: str, idempotency: str) -> DataFrame:
    """The ledger with a ``reason`` for every event that breaks the chain: gap, wrong previous hash, wrong own hash, repeated key."""
    w = W.partitionBy(key).orderBy(order)
    own = F.sha2(F.concat("previous", F.lit("|"), "body"), 256)
    reason = (
        F.when(F.col(order) != F.coalesce(F.lag(order).over(w) + 1, F.lit(0)), "sequence gap").when(F.col("previous") != F.coalesce(F.lag("event_hash").over(w), F.lit("")), "previous hash")
        .when(F.col("event_hash") != own, "event hash").when(F.count(F.lit(1)).over(W.partitionBy(key, idempotency)) > 1, "repeated key")
    )
    return ledger.withColumn("reason", reason)
