"""Gated scores of candidates: gates as columns, a penalty for each that fails, and a score that cannot reach the target unless all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators.gates import without_best


def order_statistic_bound(means: DataFrame, keys: list[str], order: str, x: str, *, resamples: int = 1000, seed: str, alpha: float = 0.05) -> DataFrame:
    """``keys, lower_bound``: of the sorted means of resamples of the rows, the one at place ``alpha * resamples``; NULL under two rows."""
    w = W.partitionBy(*keys)
    rows = means.select(*keys, order, x).withColumns({"idx": F.row_number().over(w.orderBy(order)) - 1, "k": F.count(F.lit(1)).over(w)})
    draws = rows.filter("k > 1").select(*keys, "k", F.col("idx").alias("slot")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("r").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.withColumn("idx", F.pmod(number, "k").cast("int")).select(*keys, "r", "idx")
    m = drawn.join(rows.select(*keys, "idx", x), [*keys, "idx"]).groupBy(*keys, "r").agg(F.avg(x).alias("m"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("m"))
    return m.withColumn("place", place).filter(F.col("place") == int(alpha * resamples) + 1).select(*keys, F.col("m").alias("lower_bound"))


def halves(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``first_half``: is the row in the first max(1, n div 2) rows of its key?"""
    w = W.partitionBy(*keys)
    return df.withColumn("first_half", F.row_number().over(w.orderBy(order)) <= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 2)))


def series_statistics(series: DataFrame, keys: list[str], order: str, x: str, hard: str, periods: float) -> DataFrame:
    """Per key of a net series: periods, mean, the mean at higher cost, without the best, of both halves, and the annual Sharpe ratio."""
    g = halves(series, keys, order).groupBy(*keys)
    sharpe = F.coalesce(F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))) * periods**0.5, F.lit(0.0))
    return g.agg(
        F.count(F.lit(1)).alias("periods"), F.avg(x).alias("mean"), F.avg(hard).alias("hard_mean"), without_best(x).alias("without_best"),
        F.avg(F.when(F.col("first_half"), F.col(x))).alias("first"), F.avg(F.when(~F.col("first_half"), F.col(x))).alias("second"), sharpe.alias("sharpe"),
    )


def score(df: DataFrame, gates: dict[str, Column], major: set[str], target: float) -> DataFrame:
    """Adds the gates, ``gate_penalty`` (10 for a major gate, 1 for others), ``status`` and ``score``."""
    known = {name: F.coalesce(c, F.lit(False)) for name, c in gates.items()}
    df = df.withColumns(known)
    penalty = F.lit(0.0)
    for name in gates:
        penalty = penalty + F.when(F.col(name), 0.0).otherwise(10.0 if name in major else 1.0)
    df = df.withColumn("gate_penalty", penalty)
    passed = F.col("gate_penalty") == 0
    return df.withColumns({"status": F.when(passed, "passed").otherwise("rejected"), "score": F.when(passed, F.col("sharpe")).otherwise(F.least("sharpe", F.lit(target - 0.000001)) - F.col("gate_penalty"))})


def common_gates(least_periods: int) -> dict[str, Column]:
    return {
        "positive_net_mean": F.col("mean") > 0, "positive_both_halves": (F.col("periods") >= least_periods) & (F.col("first") > 0) & (F.col("second") > 0),
        "survives_without_best": F.col("without_best") > 0, "survives_double_cost": F.col("hard_mean") > 0,
    }


def weekly_options_score(trades: DataFrame, keys: list[str], *, week: str, net: str, cost: float, least_trades: int, least_weeks: int, target: float, seed: str, resamples: int = 1000) -> DataFrame:
    """Seven gates over the weekly means of a ledger of net results in widths."""
    weekly = trades.groupBy(*keys, week).agg(F.avg(net).alias("net"), F.count(net).alias("n")).withColumn("hard", F.col("net") - cost)
    stats = series_statistics(weekly, keys, week, "net", "hard", 52.0).join(weekly.groupBy(*keys).agg(F.sum("n").alias("trades")), keys)
    stats = stats.join(order_statistic_bound(weekly, keys, week, "net", resamples=resamples, seed=seed), keys, "left")
    gates = {"minimum_trades": F.col("trades") >= least_trades, "minimum_weeks": F.col("periods") >= least_weeks} | common_gates(4) | {"weekly_bootstrap_positive": F.col("lower_bound") > 0}
    return score(stats, gates, {"minimum_trades", "minimum_weeks"}, target)


def portfolio_score(trades: DataFrame, keys: list[str], *, day: str, symbol: str, net: str, cost: float, least_trades: int, least_sessions: int, least_symbols: int, most_concentration: float, target: float) -> DataFrame:
    """Nine gates over the equal-weight daily portfolio of a universe's trades."""
    daily = trades.groupBy(*keys, day).agg(F.avg(net).alias("net")).withColumn("hard", F.col("net") - cost)
    by_symbol = trades.groupBy(*keys, symbol).agg(F.count(net).alias("n"), F.avg(net).alias("m")).groupBy(*keys).agg(
        F.sum("n").alias("trades"), F.sum((F.col("n") >= 5).cast("int")).alias("active_symbols"), (F.max("n") / F.sum("n")).alias("concentration"), F.avg((F.col("m") > 0).cast("double")).alias("positive_symbols"))
    stats = series_statistics(daily, keys, day, "net", "hard", 252.0).join(by_symbol, keys)
    gates = {
        "minimum_trades": F.col("trades") >= least_trades, "minimum_sessions": F.col("periods") >= least_sessions, "symbol_breadth": F.col("active_symbols") >= least_symbols,
        "symbol_concentration": F.col("concentration") <= most_concentration,
    } | common_gates(4) | {"positive_symbol_fraction": F.col("positive_symbols") >= 0.4}
    return score(stats, gates, {"minimum_trades", "minimum_sessions", "symbol_breadth"}, target)


