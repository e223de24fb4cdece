"""The daily snapshot of a universe: every feature of a symbol's own history, ranks across the session, and the payoffs of the next session.

Bars cross the cluster twice. Everything that looks along a symbol (windows, then the recursions in Arrow over the same partitions) follows one shuffle by symbol;
ranks and the benchmark follow one by session. Ranks sort one long table of the ranked features; the row itself travels with the first of them.

A row exists where ``WARMUP`` earlier bars and a next bar do. A number that cannot be had (a flat range, no volume) is the neutral value of its feature, so a feature
is never NULL. The next session's date is used (is it a day of events?), its bar only in the payoffs. Bars must be one a symbol and session: a repeated one is an error
of the job. A session without the benchmark's row has NULL relative payoffs, or the payoff itself with ``closed_zero`` (its market was closed, so it did not move).
Ties of a rank go by symbol; a universe of one has ranks of 0.5. Other columns of the bars are ignored. An empty table gives an empty snapshot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators import channels as ch
from asofkit.operators import indicators as ind
from asofkit.operators import windows as win
from asofkit.sources import files

# fixed values: the warm-up in sessions, the features that are ranked, the share of sessions up to the end of each stage
WARMUP = 61
RANKED = ("ret_1d", "ret_5d", "ret_20d", "rv_20d", "vol_ratio_5_20", "dist_high_20", "range_pos", "dist_ma_20")
STAGES = {"discovery": 0.6, "validation": 0.8, "holdout": 1.0}
LEAST_SESSIONS = 15

#: Neutral values other than 0.
NEUTRAL = {"range_pos": 0.5, "vol_ratio_5_20": 1.0, "rv_ratio_5_20": 1.0, "bb_pctb": 0.5, "rsv_20": 0.5, "gain_share_20": 0.5, "rsi_2": 50.0, "rsi_14": 50.0}
RECURSIVE = ("rsi_2", "rsi_14", "macd_hist", "adx_14", "chan_bars", "chan_slope", "chan_pearson", "chan_z", "chan_breakout")
PAYOFFS = ("next_open_to_close", "next_close_to_close")


def _along(w) -> dict:
    """Features by name, over a series with ``ret``, ``no`` and ``streak``."""
    frame, share = w.rowsBetween(-19, 0), F.try_divide
    c, o, h, low = (F.col(x) for x in ("close", "open", "high", "low"))
    ma = {n: F.avg("close").over(w.rowsBetween(-n + 1, 0)) for n in (5, 20, 60)}
    volume = {n: F.avg("volume").over(w.rowsBetween(-n + 1, 0)) for n in (5, 20)}
    vol = {n: win.realized_vol("ret", n, w) for n in (5, 20, 60)}
    pct_b, bandwidth = win.bollinger("close", 20, 2.0, w)
    gains, moves = F.sum(F.greatest("ret", F.lit(0.0))).over(frame), F.sum(F.abs("ret")).over(frame)
    lines = {n: win.trend("close", "no", n, w) for n in (20, 60)}
    return {
        **{f"ret_{k}d": share(c, F.lag("close", k).over(w)) - 1 for k in (1, 5, 10, 20, 60)}, "gap_open": share(o, F.lag("close").over(w)) - 1, "oc_ret": share(c, o) - 1,
        "range_pos": share(c - low, h - low), "k_body": share(c - o, h - low), "k_upper": share(h - F.greatest(o, c), h - low), "k_lower": share(F.least(o, c) - low, h - low),
        **{f"rv_{n}d": v for n, v in vol.items()}, "rv_ratio_5_20": share(vol[5], vol[20]),
        **{f"dist_ma_{n}": share(c, m) - 1 for n, m in ma.items()}, "ma_5_20_spread": share(ma[5], ma[20]) - 1,
        "dist_high_20": share(c, F.max("close").over(frame)) - 1, "dist_low_20": share(c, F.min("close").over(frame)) - 1, "rsv_20": win.range_position("close", "high", "low", 20, w),
        "high_recency_20": win.extreme_recency("high", 20, w, True), "low_recency_20": win.extreme_recency("low", 20, w, False),
        **{f"trend_{x}_{n}": v for n, line in lines.items() for x, v in zip(("slope", "r2"), line)}, "bb_pctb": pct_b, "bb_bandwidth": bandwidth,
        "up_frac_20": F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).over(frame), "gain_share_20": share(gains, moves), "streak": F.col("streak").cast("double"), "ret_skew_20": win.skew("ret", 20, w),
        "vol_ratio_5_20": share(volume[5], volume[20]), "vol_cv_20": share(F.stddev_samp("volume").over(frame), volume[20]), "corr_ret_vol_20": win.correlation("ret", "volume", 19, w),
        "day_of_week": F.weekday("session").cast("double"),
    }


def _recursions(table: pa.Table) -> pa.Table:
    """The history of one symbol with the features that depend on all of it."""
    table = table.sort_by("no")
    close, high, low = (table[c].to_numpy() for c in ("close", "high", "low"))
    fast, slow, signal = ind.ema(close, 12), ind.ema(close, 26), np.full(len(close), np.nan)
    if len(close) >= 26:
        signal[25:] = ind.ema((fast - slow)[25:], 9)
    swings = (table[c].fill_null(-1).to_numpy().astype(int) for c in ("swing_high", "swing_low"))
    with np.errstate(divide="ignore", invalid="ignore"):
        found = [ind.rsi(close, 2), ind.rsi(close, 14), (fast - slow - signal) / close, ind.adx(high, low, close, 14), *ch.channel(close, *swings).T]
    for name, x in zip(RECURSIVE, found):
        table = table.append_column(name, pa.array(np.ascontiguousarray(x)))
    return table.drop_columns(["close", "high", "low", "no", "swing_high", "swing_low"])


def daily_snapshot(bars: DataFrame, event_days: DataFrame, *, benchmark: str | None = None, closed_zero: bool = False, warmup: int = WARMUP, decimals: int = 8) -> DataFrame:
    """``session, symbol``, the features, ``xs_rank_<feature>`` of ``RANKED``, the payoffs and, with a benchmark, ``<payoff>_rel``.

    ``bars``: ``symbol, session, open, high, low, close, volume`` (no NULL but in the volume, which counts as 0). ``event_days``: ``day``, goes to all tasks, at most one row a calendar day.
    """
    w = win.series()
    numbers = {c: F.col(c).cast("double") for c in ("open", "high", "low", "close")} | {"volume": F.coalesce(F.col("volume").cast("double"), F.lit(0.0))}
    b = bars.select("symbol", "session", *[x.alias(c) for c, x in numbers.items()])
    repeated = F.lag("session").over(w) == F.col("session")
    refuse = F.raise_error(F.concat(F.lit("more than one bar of "), "symbol", F.lit(" in one session"))).cast("int")
    b = b.withColumns({
        "no": F.when(repeated, refuse).otherwise(F.row_number().over(w)), "ret": F.try_divide("close", F.lag("close").over(w)) - 1,
        "next_session": F.lead("session").over(w), "next_open": F.lead("open").over(w), "next_close": F.lead("close").over(w),
    })
    b = ch.confirmed_swings(win.signed_streak(b, "ret", w, ("symbol",)), key="symbol", order="session").drop("at")
    days = event_days.select(F.to_date("day").alias("day")).filter("day is not null").distinct()
    today, then = (F.broadcast(days.select(F.col("day").alias(at), F.lit(1.0).alias(name))) for at, name in (("session", "event_today"), ("next_session", "event_next_session")))
    b = b.join(today, "session", "left").join(then, "next_session", "left")
    usable = (F.col("no") > warmup) & (F.col("close") != 0) & (F.col("high") >= F.col("low")) & (F.col("next_open") != 0) & (F.col("next_close") != 0)
    along = _along(w)
    own = {**along, "event_today": F.col("event_today"), "event_next_session": F.col("event_next_session"), "next_open_to_close": F.try_divide("next_close", "next_open") - 1, "next_close_to_close": F.try_divide("next_close", "close") - 1}
    b = b.select("symbol", "session", "no", "close", "high", "low", "swing_high", "swing_low", usable.alias("usable"), *[x.cast("double").alias(name) for name, x in own.items()])
    features = [*along, "event_today", "event_next_session", *RECURSIVE]
    kinds = dict(b.dtypes)
    carried = ["symbol", "session", "usable", *own]
    x = b.groupBy("symbol").applyInArrow(_recursions, ", ".join([f"{c} {kinds[c]}" for c in carried] + [f"{c} double" for c in RECURSIVE])).filter("usable")

    def finite(c: str):
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, NEUTRAL.get(c, 0.0)).otherwise(F.round(c, decimals)).alias(c)

    x = x.select("session", "symbol", *[finite(c) for c in (*features, *PAYOFFS)]).repartition("session")
    long = x.select("session", "symbol", F.struct(*features, *PAYOFFS).alias("row"), F.posexplode(F.array(*RANKED)).alias("i", "x")).withColumn("row", F.when(F.col("i") == 0, F.col("row")))
    field = W.partitionBy("session", "i")
    place, n = F.row_number().over(field.orderBy("x", "symbol")), F.count(F.lit(1)).over(field)
    rank = F.when(n < 2, 0.5).otherwise(F.round((place - 1) / (n - 1), decimals))
    wide = long.withColumn("rank", rank).groupBy("session", "symbol").agg(F.first("row", ignorenulls=True).alias("row"), *[F.max(F.when(F.col("i") == k, F.col("rank"))).alias(f"xs_rank_{c}") for k, c in enumerate(RANKED)])
    out = wide.select("session", "symbol", "row.*", *[f"xs_rank_{c}" for c in RANKED])
    if benchmark is None:
        return out
    base = {c: F.max(F.when(F.col("symbol") == benchmark, F.col(c))).over(W.partitionBy("session")) for c in PAYOFFS}
    return out.withColumns({f"{c}_rel": F.round(F.col(c) - (F.coalesce(x, F.lit(0.0)) if closed_zero else x), decimals) for c, x in base.items()})


def suggested_splits(sessions: DataFrame) -> DataFrame:
    """``stage, first, last`` of the stages over the distinct sessions, and ``sessions`` in each; an error below ``LEAST_SESSIONS``. The array holds one date a session."""
    days = sessions.agg(F.array_sort(F.collect_set("session")).alias("d")).withColumn("n", F.size("d"))
    ends = [F.floor(F.col("n") * upto).cast("int") for upto in STAGES.values()]
    begins = [F.lit(0), *ends[:-1]]
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.element_at("d", a + 1).alias("first"), F.element_at("d", z).alias("last"), (z - a).alias("sessions")) for s, a, z in zip(STAGES, begins, ends)])
    short = F.raise_error(F.concat(F.lit("too few sessions: "), F.col("n").cast("string"))).cast("boolean")
    return days.filter(F.when(F.col("n") < LEAST_SESSIONS, short).otherwise(True)).select(F.explode(stages).alias("s")).select("s.*")


def prepare_universe(
    bars: DataFrame, event_days: DataFrame, path: str, symbols: list[str], *, benchmark: str | None = None, closed_zero: bool = False, decimals: int = 8,
) -> DataFrame:
    """Write the snapshot of ``symbols`` and the benchmark once, with its manifest, and return the manifest.

    A symbol without bars, or a benchmark without any row, is refused. The manifest tells ``rows, first, last, digest``, the universe, ``benchmark_sessions`` and the digest of the days of events;
    the suggested splits lie next to it.
    """
    wanted = sorted({*symbols, *([benchmark] if benchmark else [])})
    chosen = bars.filter(F.col("symbol").isin(wanted))
    there = {r["symbol"] for r in chosen.select("symbol").distinct().collect()}  # at most the list that was asked for
    if missing := [s for s in wanted if s not in there]:
        raise ValueError(f"no bars for {', '.join(missing)}: a part of a universe is refused")
    snapshot = daily_snapshot(chosen, event_days, benchmark=benchmark, closed_zero=closed_zero, decimals=decimals)
    told = files.write_with_manifest(snapshot, path, "session")
    rows = read_universe(bars.sparkSession, path)
    sessions = rows.filter(F.col("symbol") == benchmark).count() if benchmark else 0
    if benchmark and not sessions:
        raise ValueError(f"the benchmark {benchmark} has no row after the warm-up")
    suggested_splits(rows).write.mode("errorifexists").parquet(f"{path}/splits")
    about = told.withColumns({
        "symbols": F.array(*[F.lit(s) for s in symbols]), "benchmark": F.lit(benchmark).cast("string"), "benchmark_sessions": F.lit(sessions).cast("bigint"), "warmup": F.lit(WARMUP),
        "events_digest": F.lit(files.content_digest(event_days.select(F.to_date("day").cast("string").alias("day")).distinct())),
    })
    about.write.mode("errorifexists").parquet(f"{path}/about")
    return bars.sparkSession.read.schema(about.schema).parquet(f"{path}/about")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")
