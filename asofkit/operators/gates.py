"""Pass/fail gates on periodic outcomes and on ledgers of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators.resampling import block_ids, cluster_bootstrap


def without_best(x: str) -> Column:
    """Mean of a group without its single largest value; NULL for a group of one."""
    return F.try_divide(F.sum(x) - F.max(x), F.count(x) - 1)


def stage_gates(
    outcomes: DataFrame, keys: list[str], order: str, base: str, elevated: str, position: str, *, min_periods: int, min_share: float, block: int = 4, resamples: int = 2000, seed: str = "stage", alpha: float = 0.05, traded: bool = True
) -> DataFrame:
    """One row per key: the gate values and PASSED, FAILED or UNTESTABLE.

    Too few periods, or too few periods in the rarer of long and not long, make a stage UNTESTABLE, never FAILED. Halves
    are split at n div 2, the lower bound resamples blocks of consecutive periods. What is not ``traded`` has no cost, so its mean at double cost is NULL and no gate.
    """
    w = W.partitionBy(*keys)
    rows = outcomes.withColumn("__r", F.row_number().over(w.orderBy(order))).withColumn("__half", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 2)))
    first = F.col("__r") <= F.col("__half")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.avg(base).alias("mean"), F.avg(elevated).alias("elevated_mean"), without_best(base).alias("without_best"),
        F.avg(F.when(first, F.col(base))).alias("first_half"), F.avg(F.when(~first, F.col(base))).alias("second_half"), F.avg((F.col(position) == 1).cast("double")).alias("long_share"),
    )
    bound = cluster_bootstrap(block_ids(outcomes, keys, order, block), keys, "block", base, resamples=resamples, seed=seed, alpha=alpha)
    out = stats.join(bound, keys)
    if not traded:
        out = out.withColumn("elevated_mean", F.lit(None).cast("double"))
    positive = F.lit(True)
    for c in ("mean", *(["elevated_mean"] if traded else []), "without_best", "first_half", "second_half", "lower_bound"):
        positive = positive & F.coalesce(F.col(c) > 0, F.lit(False))
    testable = (F.col("periods") >= min_periods) & (F.least("long_share", 1 - F.col("long_share")) >= min_share)
    return out.withColumn("verdict", F.when(~testable, "UNTESTABLE").when(positive, "PASSED").otherwise("FAILED"))


def failure_histogram(trials: DataFrame, gates: list[str]) -> DataFrame:
    """``gate, trials, failed_share, label`` over trials with one boolean column per gate."""
    long = trials.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("ok")) for g in gates])).alias("e")).select("e.*")
    share = long.groupBy("gate").agg(F.count(F.lit(1)).alias("trials"), F.avg((~F.col("ok")).cast("double")).alias("failed_share"))
    return share.withColumn("label", F.when(F.col("failed_share") >= 0.8, "dominant").when(F.col("failed_share") >= 0.5, "common").otherwise("rare"))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds; a check that is NULL holds, as what is unknown is not valid. NULL: none."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in checks])
