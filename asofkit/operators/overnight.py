"""Structures bought in the evening and closed at the settlement, in the morning, or at the settlement of the next session.

A session is one row with its bars, so a candidate's signal sees no more than its view lets it. Volatility is what remained of earlier complete sessions, so it is known
before the session begins. All candidates and exits are evaluated in one job: a session becomes one row for each, with a reason where there is no trade.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.functions import scalars as fn
from asofkit.operators import scores, structures
from asofkit.operators.calendar import iso_week
from asofkit.operators.ledgers import price_at

SETTLEMENT, MORNING, NEXT = "settlement", "morning", "next_session"
#: The floors of each split, and the score that a candidate is meant to reach.
LEAST_TRADES = {"discovery": 60, "validation": 40, "holdout": 25}
LEAST_WEEKS = {"discovery": 24, "validation": 16, "holdout": 8}
TARGET = 1.0
GATES = ("minimum_trades", "minimum_weeks", "positive_net_mean", "positive_both_halves", "survives_without_best", "survives_double_cost", "weekly_bootstrap_positive")


@dataclass(frozen=True)
class Clock:
    """Minutes of a session: the latest first bar of a complete one, the start of the day session, the bar of the settlement, and the earliest entry."""

    latest_first: int
    morning: int
    settlement: int
    floor: int


class View:
    """What a signal may read of a session at its entry minute; all else is NULL."""

    def __init__(self, entry: int):
        self.entry = entry
        self.evening_open, self.prior_close, self.prior_high, self.prior_low = F.col("evening_open"), F.col("prior_close"), F.col("prior_high"), F.col("prior_low")
        self.day_of_week = F.weekday("session")

    def price_at(self, minute: int) -> Column:
        return price_at(minute) if minute <= self.entry else F.lit(None).cast("double")

    def from_evening_open(self, minute: int) -> Column:
        return (F.try_divide(self.price_at(minute), self.evening_open) - 1) * 100

    def from_prior_close(self, minute: int) -> Column:
        return (F.try_divide(self.price_at(minute), self.prior_close) - 1) * 100

    def first_touch(self, offset: float, after: int) -> Column:
        """First minute after ``after``, up to the entry, that touches the evening open plus ``offset``."""
        touched = lambda b: b["high"] >= self.evening_open + offset if offset >= 0 else b["low"] <= self.evening_open + offset
        return F.get(F.filter("bars", lambda b: (b["minute"] > after) & (b["minute"] <= self.entry) & touched(b)), F.lit(0))["minute"]


@dataclass(frozen=True)
class Candidate:
    label: str
    entry: int
    helper: str
    width: float
    offset: float
    signal: Callable[[View], Column]


def sessions(bars: DataFrame, clock: Clock, minutes: Sequence[int], *, window: int = 20, decay: float | None = None, keys: tuple[str, str] = ("symbol", "session")) -> DataFrame:
    """One row per session: ``bars``, ``evening_open, complete, settlement``, the close and the high and low of the day session before, and of the session behind ``next_settlement``
    (NULL if it is not complete). ``var_<minute>`` is the mean variance that remained from that minute in the ``window`` latest complete sessions before this one.

    With ``decay`` the latest of them weighs 1 and each older one ``decay`` times as much. NULL until there are ``window`` of them.
    """
    g = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("minute", "open", "high", "low", "close"))).alias("bars"))
    settled = F.get(F.filter("bars", lambda b: b["minute"] == clock.settlement), F.lit(0))["close"]
    first = F.get("bars", F.lit(0))
    g = g.withColumns({"evening_open": first["open"], "settlement": settled}).withColumn("complete", (first["minute"] <= clock.latest_first) & F.col("settlement").isNotNull())
    day = F.filter("bars", lambda b: b["minute"].between(clock.morning, clock.settlement))
    steps = F.zip_with(F.slice("bars", 1, F.size("bars") - 1), F.slice("bars", 2, F.size("bars")), lambda a, b: F.struct(a["minute"].alias("since"), F.when((a["close"] > 0) & (b["close"] > 0), F.ln(b["close"] / a["close"])).otherwise(0.0).alias("lr")))
    g = g.withColumns({"day_high": F.array_max(F.transform(day, lambda b: b["high"])), "day_low": F.array_min(F.transform(day, lambda b: b["low"])), "steps": steps})
    remains = lambda m: F.aggregate(F.filter("steps", lambda s: s["since"] >= m), F.lit(0.0), lambda t, s: t + s["lr"] * s["lr"])
    g = g.withColumns({f"var_{m}": remains(m) for m in minutes}).drop("steps")
    tail = W.partitionBy(keys[0], "complete").orderBy(keys[1]).rowsBetween(-window + 1, 0)
    weights = F.array(*[F.lit((1.0 if decay is None else decay) ** age) for age in range(window - 1, -1, -1)])

    def mean(x: str) -> Column:
        total = F.aggregate(F.zip_with(F.collect_list(x).over(tail), weights, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.col("complete") & (F.count(x).over(tail) == window), total / F.aggregate(weights, F.lit(0.0), lambda s, k: s + k))

    g = g.withColumns({f"var_{m}": mean(f"var_{m}") for m in minutes})
    order = W.partitionBy(keys[0]).orderBy(keys[1])
    before = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    known = {f"var_{m}": before(f"var_{m}") for m in minutes} | {"prior_close": before("settlement"), "prior_high": before("day_high"), "prior_low": before("day_low")}
    behind = F.lead(F.when(F.col("complete"), F.col("settlement"))).over(order)
    return g.withColumns(known | {"next_settlement": behind}).drop("day_high", "day_low")


def trades(days: DataFrame, candidates: Sequence[Candidate], exits: Sequence[str], clock: Clock, *, cost: float, premium: float, keep: Sequence[str]) -> DataFrame:
    """One row per session, candidate and exit: ``keep, label, exit, selected, debit, width, net`` and ``skip``, the reason why there is no trade.

    ``net`` is in parts of the width, after ``cost`` of it. A candidate's structure must be a vertical of the index; another is an error.
    """
    sigma2 = lambda minute: F.col(f"var_{minute}")

    def row(c: Candidate) -> Column:
        entry = price_at(c.entry)
        legs = structures.index_vertical(c.helper, entry, F.lit(c.width), F.lit(c.offset))
        return F.struct(F.lit(c.label).alias("label"), F.coalesce(c.signal(View(c.entry)), F.lit(False)).alias("selected"), F.lit(c.width).cast("double").alias("width"), entry.alias("entry"), legs.alias("legs"), sigma2(c.entry).alias("entry_var"))

    x = days.withColumn("c", F.explode(F.array(*[row(c) for c in candidates]))).withColumn("exit", F.explode(F.array(*[F.lit(e) for e in exits])))
    x = x.withColumns({"morning_price": price_at(clock.morning), "morning_var": sigma2(clock.morning), "floor_var": sigma2(clock.floor)})
    x = x.select(*keep, "complete", "settlement", "next_settlement", "morning_price", "morning_var", "floor_var", "exit", "c.*")
    bad = structures.refusal(F.col("legs"))
    x = x.withColumn("legs", F.when(F.col("entry").isNull() | bad.isNull(), F.col("legs")).otherwise(F.raise_error(F.concat(F.lit("no index vertical: "), F.coalesce(bad, F.lit(""))))))
    # the next session adds a whole one, taken from its start as it is known now
    later = F.when(F.col("exit") == NEXT, F.col("floor_var")).otherwise(0.0)
    x = x.withColumns({"entry_vol": F.sqrt(F.col("entry_var") + later) * premium, "morning_vol": F.sqrt("morning_var") * premium})

    def model(x: DataFrame, name: str, spot: str, vol: str) -> DataFrame:
        for k in (0, 1):
            leg = F.get("legs", F.lit(k))
            x = fn.with_option_price(x, f"{name}{k}", leg["cp"], spot, leg["strike"], vol)
        return x.withColumn(name, sum((F.get("legs", F.lit(k))["qty"] * F.col(f"{name}{k}") for k in (0, 1)), F.lit(0.0))).drop(f"{name}0", f"{name}1")

    x = model(model(x, "debit", "entry", "entry_vol"), "morning_value", "morning_price", "morning_vol")
    settled = structures.settle(F.col("legs"), F.when(F.col("exit") == NEXT, F.col("next_settlement")).otherwise(F.col("settlement")))
    x = x.withColumn("value", F.when(F.col("exit") == MORNING, F.col("morning_value")).otherwise(settled))
    inside = F.coalesce(F.abs("debit") < F.col("width"), F.lit(False))
    skip = (
        F.when(~F.col("complete"), "incomplete_session").when(F.col("entry_var").isNull(), "vol_warmup").when((F.col("exit") == NEXT) & F.col("next_settlement").isNull(), "no_next_session")
        .when(F.col("entry").isNull(), "missing_entry_bar").when(~inside, "degenerate_entry").when((F.col("exit") == MORNING) & F.col("morning_price").isNull(), "missing_morning_bar")
    )
    traded = lambda c: F.when(F.col("skip").isNull(), c)
    net = (F.col("value") - F.col("debit") - cost * F.col("width")) / F.col("width")
    return x.withColumn("skip", skip).select(*keep, "label", "exit", "selected", "width", traded(F.col("debit")).alias("debit"), traded(net).alias("net"), "skip")


def evaluate(rows: DataFrame, keys: Sequence[str], *, cost: float, seed: str, day: str = "session", resamples: int = 1000) -> DataFrame:
    """One row per key (``split`` among them): trades, means, the control over all eligible sessions, skips by reason, seven gates and the score.

    A key without a selected trade fails every gate and has no means. The mean at double cost takes the cost once more.
    """
    keys = list(keys)
    chosen = F.col("selected") & F.col("skip").isNull()
    reasons = rows.filter("skip is not null").groupBy(*keys, "skip").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "skip", F.col("n").cast("string")))), ",").alias("skipped"))
    whole = rows.groupBy(*keys).agg(
        F.count_if(F.col("skip").isNull()).alias("eligible_sessions"), F.count_if(chosen).alias("signal_trades"), F.avg(F.when(chosen, F.col("net"))).alias("net_mean"), F.avg("net").alias("control_mean"),
        F.avg(F.when(chosen, F.col("debit") / F.col("width"))).alias("mean_debit"),
    )
    floor = lambda by: F.coalesce(*[F.when(F.col("split") == s, n) for s, n in by.items()])
    taken = rows.filter(chosen).select(*keys, iso_week(day).alias("week"), "net")
    scored = scores.weekly_options_score(taken, keys, week="week", net="net", cost=cost, least_trades=floor(LEAST_TRADES), least_weeks=floor(LEAST_WEEKS), target=TARGET, seed=seed, resamples=resamples)
    scored = scored.select(*keys, F.col("periods").alias("signal_weeks"), F.col("mean").alias("weekly_mean"), "lower_bound", "sharpe", *GATES, "gate_penalty", "status", "score")
    out = whole.join(scored, keys, "left").join(reasons, keys, "left")
    worst = 10.0 * 2 + len(GATES) - 2
    none = {g: F.coalesce(g, F.lit(False)) for g in GATES} | {
        "signal_weeks": F.coalesce("signal_weeks", F.lit(0).cast("long")), "sharpe": F.coalesce("sharpe", F.lit(0.0)), "gate_penalty": F.coalesce("gate_penalty", F.lit(worst)), "status": F.coalesce("status", F.lit("rejected")),
        "score": F.coalesce("score", F.lit(-worst)), "skipped": F.coalesce("skipped", F.lit("")),
    }
    return out.withColumns(none)
