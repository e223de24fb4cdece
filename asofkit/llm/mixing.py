"""Operator 1: mix sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document starts with the copy count ``target / size`` of its source. Its whole part is fixed; its fraction is a
probability. Fractions are paired: a random transfer of words moves mass from one document of a pair to the other
until one of them is a whole number, so each pair keeps its expected words exactly and every document keeps its
expected copies. Blocks of documents are folded this way side by side, each block leaves at most one fraction, and
those residuals are folded again, level by level, until each source has one residual, which is rounded to the
nearer whole number. A source therefore misses its target by at most half of one document.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, ordered last; a source
without words has target 0; repeated rows are separate documents; an empty table gives an empty result. Extra columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import WORD_PATTERN, cut, uniform

WEIGHTS = (3.0, 1.0, 2.0)
FAN = 32


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: ``source, source_size, n_docs, target``.

    Weights go to the sources in code-point order (null last), repeating. The targets are the water level:
    ``min(most * source_size, weight * level)``, with the level such that they add up to ``share`` of all sizes; this is
    what resharing the excess by weight until no source is above its limit comes to.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # one row per source from here on, so the windows without partitions see the list of sources only
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    everything = Window.orderBy("fills", "rank")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    onward = everything.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        weighted.withColumn("fills", most * F.col("source_size") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("total", share * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
        # the first source, by the level at which it fills, that stays below its limit sets the level
        .withColumn("water", F.coalesce(F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", "rank", "level"))).over(whole)["level"], F.lit(float("inf"))))
    )
    return level.select("source", "rank", "source_size", "n_docs", F.least(most * F.col("source_size"), F.col("weight") * F.col("water")).alias("target"))


def _pivot(a: Column, b: Column, seed: int) -> Column:
    """Two documents after one random transfer of words between them; at least one fraction is then 0 or 1."""
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that a can gain from b
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    rises = uniform(F.lit(seed), a["key"], b["key"], a["doc_id"], b["doc_id"]) * (up + down) < down
    pa = F.when(rises, F.when((1 - a["p"]) * a["size"] <= up, 1.0).otherwise(a["p"] + up / a["size"])).otherwise(
        F.when(a["p"] * a["size"] <= down, 0.0).otherwise(a["p"] - down / a["size"])
    )
    pb = F.when(rises, F.when(b["p"] * b["size"] <= up, 0.0).otherwise(b["p"] - up / b["size"])).otherwise(
        F.when((1 - b["p"]) * b["size"] <= down, 1.0).otherwise(b["p"] + down / b["size"])
    )
    return F.array(_with_p(a, pa), _with_p(b, pb))


_FIELDS = ("neg_size", "key", "doc_id", "size", "base", "source_size", "target")


def _with_p(e: Column, p: Column) -> Column:
    return F.struct(*[e[f].alias(f) for f in _FIELDS], p.alias("p"))


def _open(e: Column) -> Column:
    return (e["p"] > 0.0) & (e["p"] < 1.0)


def _fold(items: Column, element: str, seed: int) -> Column:
    """Fold a block: ``done`` has the settled documents, ``left`` at most one document with a fraction."""

    def step(acc: Column, x: Column) -> Column:
        pair = F.when(F.size(acc["left"]) == 0, F.array(_with_p(x, x["p"]))).otherwise(_pivot(F.get(acc["left"], F.lit(0)), x, seed))
        settled = F.transform(
            F.array(pair),
            lambda pr: F.struct(F.concat(acc["done"], F.filter(pr, lambda e: ~_open(e))).alias("done"), F.filter(pr, _open).alias("left")),
        )
        return F.get(settled, F.lit(0))

    empty = F.from_json(F.lit('{"done": [], "left": []}'), f"done array<{element}>, left array<{element}>")
    return F.aggregate(items, empty, step)


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = 1.5, most: float = 2.0, fan: int = FAN, seed: int = 20,
) -> DataFrame:
    """One row per document: ``doc_id, key, size, source_size, target, copies, taken``.

    ``key`` is a hash of the text; (doc_id, key) tells which row of the input is meant.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("key")))
    targets = cut(source_targets(sized, weights, share, most))
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = sized.join(targets, sized["source"].eqNullSafe(targets["source"]), "left").drop("source")
    rows = known.withColumn("base", F.floor(factor).cast("long")).withColumn("p", factor - F.floor(factor))
    n_blocks = F.ceil(F.col("n_docs") / fan).cast("long")
    element = F.struct((-F.col("size")).alias("neg_size"), "key", "doc_id", "size", "base", "source_size", "target", "p")
    level = rows.select(F.col("rank"), n_blocks.alias("blocks"), element.alias("e"))
    whole = level.filter((F.col("e.size") == 0) | ~_open(F.col("e")))
    settled = [whole.select("e")]
    level = level.filter((F.col("e.size") > 0) & _open(F.col("e")))
    kind = level.select("e").schema["e"].dataType.simpleString()
    for _ in range(max(1, math.ceil(math.log(max(most_docs, 2), fan) + 1e-9))):
        block = F.pmod(F.xxhash64(F.lit(seed), F.col("e.key"), F.col("e.doc_id")), F.col("blocks"))
        blocks = level.groupBy("rank", "blocks", block.alias("block")).agg(F.array_sort(F.collect_list("e")).alias("items"))
        folded = cut(blocks.select("rank", "blocks", _fold(F.col("items"), kind, seed).alias("f")))
        settled.append(folded.select(F.explode("f.done").alias("e")))
        level = folded.select("rank", F.ceil(F.col("blocks") / fan).cast("long").alias("blocks"), F.explode("f.left").alias("e"))
    last = level.select(_with_p(F.col("e"), F.when(F.col("e.p") >= 0.5, 1.0).otherwise(0.0)).alias("e"))
    every = last
    for part in settled:
        every = every.unionByName(part)
    copies = (F.col("e.base") + F.when(F.col("e.size") > 0, F.round("e.p").cast("long")).otherwise(0)).cast("long")
    return every.select("e.doc_id", "e.key", "e.size", "e.source_size", "e.target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def take_mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Rows that are equal in id and text are drawn one by one and share their draws.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    drawn = mix_sources(docs, **options).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    drawn = cut(drawn.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("copies").alias("__copies"), F.col("rows").alias("__rows")))
    keyed = docs.withColumn("__text_key", F.xxhash64(F.col(text_col)))
    joined = keyed.join(drawn, keyed[id_col].eqNullSafe(drawn["__id"]) & (keyed["__text_key"] == drawn["__key"]))

    def repeated(df: DataFrame) -> DataFrame:
        return df.filter("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[docs[c] for c in docs.columns])

    if drawn.filter("__rows > 1").limit(1).count() == 0:
        return repeated(joined)
    same = joined.filter("__rows > 1").dropDuplicates([id_col, "__text_key"])
    return repeated(joined.filter("__rows = 1")).unionByName(repeated(same))
