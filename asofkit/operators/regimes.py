"""Regimes of a series: fitted chains, their choice and labels, the forward filter, switching, the position book, risk limits, and the walk forward with refits.

Fits are grouped maps over (series, number of states, restart), a task each; the passes of EM run over pieces of the history side by side, not row by row. What follows a fit works on
blocks of rows: a block goes through filter, switching, book and limits as arrays, and what the next block needs is a handful of values. The batch form has one
block, the streaming form (``asofkit.streaming.jobs``) one per batch, with the values kept in between, so both give the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.functions.scalars import kelly

# fixed values
STATE_MULTIPLIER = {"CALM_UP": 1.0, "CHOP": 0.5, "CHOP2": 0.5, "STRESS": 0.25, "CRASH": 0.0}
STATE_CAP = {"CALM_UP": 0.75, "CHOP": 0.40, "CHOP2": 0.40, "STRESS": 0.20, "CRASH": 0.0}
THRESHOLD, HOLD, UNCERTAIN, EARLY_CUT, MOST_STALE = 0.70, 3, 0.15, 0.25, 2
LEAST_SHARE, LEAST_DURATION, SIMPLER = 0.02, 3.0, 0.02
CALIBRATION_ROWS, BINS, MOST_ERROR, FLOOR_SIZE, QUARTER = 200, 10, 0.05, 0.10, 0.25
ARMS = ("hmm", "hmm_fixed", "trend_only", "buy_hold")
GATES = {"sharpe": 1.5, "max_drawdown": 0.15, "hit_rate": 0.55, "t_stat": 2.0}
STRESSED = ("STRESS", "CRASH")
EM_STEPS, EM_TOLERANCE, REFIT_DAYS, DRIFT_SIGMA, DRIFT_ROW = 300, 1e-4, 30, 1.0, 0.30
STOP_VOLS, MOST_POSITION, DAY_LOSS, MOST_DRAWDOWN, RISK_STALE, APPROVAL = 2.0, 0.75, 0.05, 0.20, 3, 10_000.0


def regime_features(bars: DataFrame, *, key: str = "symbol", order: str = "session", n: int = 20) -> DataFrame:
    """``ret, rvol, span, volume_ratio, trend`` of a bar, from it and earlier ones; NULL until defined.

    ``trend`` is the gap of exponential means over 20 and 100 rows, in deviations of a day's return.
    """
    w = W.partitionBy(key).orderBy(order)
    last, before = w.rowsBetween(1 - n, 0), w.rowsBetween(-n, -1)
    full = lambda c, of, f: F.when(F.count(of).over(f) == n, c)
    x = bars.withColumn("ret", F.ln(F.try_divide("close", F.lag("close").over(w))))
    x = x.withColumns({
        "rvol": full(F.stddev_pop("ret").over(last), "ret", last), "span": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "volume_ratio": full(F.try_divide(F.col("volume"), F.avg("volume").over(before)), "volume", before),
    })

    def gaps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        fast, slow = (pdf["close"].ewm(span=k, adjust=False).mean() for k in (20, 100))
        return pdf.assign(gap=(fast - slow) / pdf["close"]).drop(columns="close")

    kinds = dict(bars.dtypes)
    gap = bars.select(key, order, "close").groupBy(key).applyInPandas(gaps, f"{key} {kinds[key]}, {order} {kinds[order]}, gap double")
    return x.join(gap, [key, order]).withColumn("trend", F.try_divide("gap", "rvol")).select(key, order, "close", "ret", "rvol", "span", "volume_ratio", "trend")


def _densities(x: np.ndarray, means: np.ndarray, covars: np.ndarray) -> np.ndarray:
    """Log densities of rows x (n, d) under normals (..., k, d): shape (..., k, n)."""
    root = np.linalg.cholesky(covars)
    z = np.linalg.solve(root, np.swapaxes(x - means[..., None, :], -1, -2))
    return -0.5 * (z**2).sum(axis=-2) - np.log(np.diagonal(root, axis1=-2, axis2=-1)).sum(axis=-1)[..., None] - 0.5 * x.shape[1] * math.log(2 * math.pi)


def _carried(first: np.ndarray, trans: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """``first @ (trans * b[:, 0]) @ ... @ (trans * b[:, t])`` for every t (k, n), each scaled to a sum of 1, and the sum of the logarithms of the scales.

    The steps are cut into about as many pieces as a piece is long. All pieces multiply out side by side, which tells what enters each, and then run side by side from there.
    The pieces lie along the last axis, so a step is one product with ``trans`` and one pass over rows that lie together; no matrix per row is held.
    """
    k, n = b.shape
    long = int(math.sqrt(n)) + 1
    pieces = -(-n // long)
    # the last piece is filled up with rows that are cut off again
    sides = np.concatenate((b, np.ones((k, pieces * long - n))), axis=1).reshape(k, pieces, long).transpose(2, 0, 1).copy()
    through = np.repeat(np.eye(k)[:, :, None], pieces, axis=2)  # to, from, piece
    for step in sides:
        through = (trans.T @ through.reshape(k, -1)).reshape(k, k, pieces) * step[:, None, :]
        through /= np.maximum(through.max(axis=0).max(axis=0), 1e-300)
    at = np.empty((k, pieces))
    at[:, 0] = first
    for c in range(1, pieces):
        v = through[:, :, c - 1] @ at[:, c - 1]
        at[:, c] = v / max(v.sum(), 1e-300)
    totals = np.empty((long, pieces))
    for j, step in enumerate(sides):
        at = (trans.T @ at) * step
        totals[j] = np.maximum(at.sum(axis=0), 1e-300)
        at = sides[j] = at / totals[j]
    return sides.transpose(1, 2, 0).reshape(k, -1)[:, :n], float(np.log(totals.T.reshape(-1)[:n]).sum())


def expectation(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(state probabilities of the rows given all rows, expected transitions, log-likelihood)."""
    log_b = _densities(x, m["means"], m["covars"])
    top = log_b.max(axis=0)
    b, trans = np.exp(log_b - top), m["trans"]
    first = m["start"] * b[:, 0]
    begin = max(first.sum(), 1e-300)
    if len(x) == 1:
        return (first / begin)[None, :], np.zeros_like(trans), float(np.log(begin) + top[0])
    ahead, logs = _carried(first / begin, trans, b[:, 1:])
    alpha = np.concatenate(((first / begin)[:, None], ahead), axis=1)
    # from the end: what a row and all after it say of its state
    last = b[:, -1] / max(b[:, -1].sum(), 1e-300)
    behind = last[:, None] if len(x) == 2 else np.concatenate((_carried(last, trans.T, b[:, -2:0:-1])[0][:, ::-1], last[:, None]), axis=1)
    gamma = alpha.copy()
    gamma[:, :-1] *= trans @ behind
    total = np.maximum(gamma.sum(axis=0), 1e-300)
    pairs = trans * ((alpha[:, :-1] / total[:-1]) @ behind.T)
    return (gamma / total).T, pairs, float(math.log(begin) + logs + top.sum())


def cold_start(x: np.ndarray, k: int, seed: int) -> dict:
    """A first guess: means at even ranks of the first feature, moved by a seeded draw."""
    rng = np.random.default_rng([seed, k])
    spread = np.cov(x.T).reshape(x.shape[1], x.shape[1]) + 1e-9 * np.eye(x.shape[1])
    place = np.argsort(x[:, 0], kind="stable")[((np.arange(k) + 0.5) / k * len(x)).astype(int)]
    means = x[place] + rng.normal(0, 0.3, (k, x.shape[1])) * np.sqrt(np.diag(spread))
    return {"start": np.full(k, 1 / k), "trans": np.where(np.eye(k) > 0, 0.9, 0.1 / max(k - 1, 1)), "means": means, "covars": np.broadcast_to(spread, (k, *spread.shape)).copy()}


def fit_chain(x: np.ndarray, m: dict, steps: int = EM_STEPS, tolerance: float = EM_TOLERANCE) -> dict:
    """EM from a start (cold, or an earlier model) until the log-likelihood gains less than the tolerance; states in order of their first mean."""
    spread = np.cov(x.T).reshape(x.shape[1], x.shape[1]) + 1e-9 * np.eye(x.shape[1])
    floor = 1e-3 * np.diag(np.diag(spread)) + 1e-12 * np.eye(x.shape[1])
    before = -math.inf
    for _ in range(steps):
        gamma, pairs, likelihood = expectation(m, x)
        if likelihood - before < tolerance:
            break
        before, weight = likelihood, gamma.sum(axis=0) + 1e-12
        means = gamma.T @ x / weight[:, None]
        off = [x - mean for mean in means]
        covars = np.stack([(gamma[:, i, None] * o).T @ o for i, o in enumerate(off)]) / weight[:, None, None] + floor
        m = {"start": gamma[0], "trans": (pairs + 1e-12) / (pairs + 1e-12).sum(axis=1, keepdims=True), "means": means, "covars": covars}
    order = np.argsort(m["means"][:, 0], kind="stable")
    return {"start": m["start"][order], "trans": m["trans"][order][:, order], "means": m["means"][order], "covars": m["covars"][order], "log_likelihood": expectation(m, x)[2]}


def fit_chains(x: np.ndarray, k: int, restarts: int, seed: int = 7, warm: dict | None = None) -> dict:
    """The likeliest of several fits: of ``restarts`` cold ones and, where there is an earlier model, one that goes on from it."""
    starts = [cold_start(x, k, seed + r) for r in range(restarts)] + ([warm] if warm is not None else [])
    return max((fit_chain(x, m) for m in starts), key=lambda m: m["log_likelihood"])


def state_statistics(m: dict, x: np.ndarray, probs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of rows, mean and deviation of the first feature) of each state over the rows that the filter gives it; a state without rows keeps its fitted values."""
    of = (filter_rows(m, x)[0] if probs is None else probs).argmax(axis=1)
    k = len(m["start"])
    rows = [x[of == i, 0] for i in range(k)]
    return np.array([len(r) for r in rows]) / len(x), np.array([r.mean() if len(r) else m["means"][i, 0] for i, r in enumerate(rows)]), np.array([r.std() if len(r) else m["covars"][i, 0, 0] ** 0.5 for i, r in enumerate(rows)])


def label_states(mean: Column, vol: Column) -> Column:
    """Names of states from their mean returns and deviations.

    With four states and more the lowest mean is CRASH if it is negative and wilder than the median; of the others the wildest is STRESS, the highest mean of what is
    left CALM_UP, and the rest are CHOP, CHOP2 and so on from the calmest.
    """
    k = F.size(mean)
    ids = F.sequence(F.lit(0), k - 1)
    at = lambda a, i: F.get(a, i)
    ordered = F.array_sort(vol)
    median = (at(ordered, F.floor((k - 1) / 2).cast("int")) + at(ordered, F.floor(k / 2).cast("int"))) / 2
    lowest = F.array_min(F.transform(ids, lambda i: F.struct(at(mean, i).alias("m"), i.alias("i"))))["i"]
    crash = F.when((k >= 4) & (at(mean, lowest) < 0) & (at(vol, lowest) > median), lowest).otherwise(-1)
    best = lambda of, keep: -F.array_max(F.transform(F.filter(ids, keep), lambda i: F.struct(at(of, i).alias("v"), (-i).alias("n"))))["n"]
    stress = best(vol, lambda i: i != crash)
    up = best(mean, lambda i: (i != crash) & (i != stress))
    rest = F.array_sort(F.transform(F.filter(ids, lambda i: (i != crash) & (i != stress) & (i != up)), lambda i: F.struct(at(vol, i).alias("v"), i.alias("i"))))
    chop = lambda i: F.array_position(rest["i"], i)
    return F.transform(ids, lambda i: F.when(i == crash, "CRASH").when(i == stress, "STRESS").when(i == up, "CALM_UP").when(chop(i) == 1, "CHOP").otherwise(F.concat(F.lit("CHOP"), chop(i).cast("string"))))


def filter_rows(model: dict, x: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(forward probabilities of each row, log-likelihood); ``prior`` is the last row of the past, never a smoothed one."""
    log_b = _densities(x, model["means"], model["covars"]).T
    top = log_b.max(axis=1)
    out, trans = np.exp(log_b - top[:, None]), model["trans"]
    sums = np.empty(len(out))
    ahead = model["start"] if prior is None else prior @ trans
    for t, row in enumerate(out):
        joint = ahead * row
        total = sums[t] = joint.sum()
        at = out[t] = joint / (total + 1e-300) if total > 0 else ahead
        ahead = at @ trans
    return out, float((np.log(sums + 1e-300) + top).sum())


MODEL = "start array<double>, trans array<double>, means array<double>, covars array<double>"
STATISTICS = "shares array<double>, state_means array<double>, state_vols array<double>"


def _unpack(row, d: int) -> dict:
    k = len(row["start"])
    m = {"start": np.asarray(row["start"], float), "trans": np.asarray(row["trans"], float).reshape(k, k), "means": np.asarray(row["means"], float).reshape(k, d), "covars": np.asarray(row["covars"], float).reshape(k, d, d)}
    return m | {c: row[c] for c in ("labels", "state_means", "state_vols") if c in row}


def _fit_rows(features: DataFrame, x: list[str], *, key: str, order: str, grid: list[tuple[int, int]], most_tasks: int) -> tuple[DataFrame, DataFrame]:
    """(the history of every series once for each (k, seed) of ``grid``, numbered by ``__fit`` and with a partition of its own for each number; the numbers ``__series`` of the series).

    Hashes of so few large groups would lay several in one task, and small partitions would be joined. Beyond ``most_tasks`` fits, the partitions hold equally many.
    """
    rows = features.select(key, order, *x).dropna()
    names = rows.select(key).distinct()
    numbered = names.withColumn("__series", F.row_number().over(W.orderBy(key)) - 1)  # one row per series
    tasks = max(min(names.count() * len(grid), most_tasks), 1)
    fits = F.sequence(F.col("__series") * len(grid), (F.col("__series") + 1) * len(grid) - 1)
    return rows.join(F.broadcast(numbered), key).select(order, *x, F.explode(fits).alias("__fit")).repartitionById(tasks, "__fit"), numbered


def fit_grid(features: DataFrame, x: list[str], *, key: str, order: str, states: tuple[int, ...] = (2, 3, 4, 5), restarts: int = 8, tail: float = 0.2, most_tasks: int = 10_000) -> DataFrame:
    """One row per (series, k): the likeliest model on the head of the history, BIC, its likelihood per row on the tail, whether it is admissible, and the names of its states.

    A state must hold a share of the rows and last a number of rows, by the fitted transitions. Every restart is a task of its own. The series are counted first, so ``features`` is best a table.
    """
    grid = [(k, r) for k in states for r in range(restarts)]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        series, place = divmod(int(pdf["__fit"].iloc[0]), len(grid))
        (k, seed), v = grid[place], pdf[x].to_numpy(dtype=float)
        head = len(v) - int(len(v) * tail)
        if head < 10 * k:
            return pd.DataFrame()
        m = fit_chain(v[:head], cold_start(v[:head], k, 7 + seed))
        probs, _ = filter_rows(m, v[:head])
        share, mean, vol = state_statistics(m, v[:head], probs)
        duration = 1 / np.maximum(1 - np.diag(m["trans"]), 1e-12)
        ok = bool((share >= LEAST_SHARE).all() and (duration >= LEAST_DURATION).all())
        outside = filter_rows(m, v[head:], probs[-1])[1] / max(len(v) - head, 1)
        free = k - 1 + k * (k - 1) + k * len(x) + k * len(x) * (len(x) + 1) / 2
        one = {"__series": series, "k": k, "seed": seed, "n": head, "log_likelihood": m["log_likelihood"], "bic": -2 * m["log_likelihood"] + free * math.log(head), "outside": outside, "admissible": ok}
        return pd.DataFrame([one | {c: np.ravel(m[c]).tolist() for c in ("start", "trans", "means", "covars")} | {"shares": share.tolist(), "state_means": mean.tolist(), "state_vols": vol.tolist()}])

    rows, numbered = _fit_rows(features, x, key=key, order=order, grid=grid, most_tasks=most_tasks)
    fits = rows.groupBy("__fit").applyInPandas(each, f"__series int, k int, seed int, n bigint, log_likelihood double, bic double, outside double, admissible boolean, {MODEL}, {STATISTICS}")
    columns = [c for c in fits.columns if c not in ("__series", "k", "seed")]
    best = fits.groupBy("__series", "k").agg(F.max_by(F.struct(*columns), F.struct("log_likelihood", -F.col("seed"))).alias("m"))
    return best.join(numbered, "__series").select(key, "k", "m.*").withColumn("labels", label_states(F.col("state_means"), F.col("state_vols")))


def choose(grid: DataFrame, key: str) -> DataFrame:
    """One model per series: the best outside the fit among the admissible (among all if none is), or the simplest within 2 % of it."""
    w = W.partitionBy(key)
    pool = grid.withColumn("__any", F.max("admissible").over(w)).filter(F.col("admissible") | ~F.col("__any"))
    best = F.max("outside").over(w)
    return pool.withColumn("__best", best).filter(F.col("outside") >= F.col("__best") - SIMPLER * F.abs("__best")).groupBy(key).agg(F.min_by(F.struct(*grid.drop(key).columns), "k").alias("m")).select(key, "m.*")


def with_models(features: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """Each row with the model of its series (a row per series, so it is joined, not collected)."""
    return features.join(models.select(key, F.struct("start", "trans", "means", "covars", "labels", "state_means", "state_vols").alias("model")), key)


# --- walks ---------------------------------------------------------------------------------------------------------


def new_walk() -> dict:
    """What is known before the first row of a key: of the filter, of the switching, of the book, of the limits."""
    return {
        "row": None, "active": None, "leader": "", "led": 0, "since": 1 << 40, "position": 0.0, "stop": 0.0, "waits": False,
        "close": None, "allowed": 0.0, "equity": 1.0, "high": 1.0, "day": None, "day_growth": 1.0, "lost": False, "killed": False,
    }


def _first(flags: np.ndarray, default: int) -> int:
    """The place of the first flag that is set."""
    return int(flags.argmax()) if flags.any() else default


def active_states(s: dict, probs: np.ndarray, names: np.ndarray, stale: np.ndarray, cooldown: int) -> np.ndarray:
    """The active state of every row of a block; ``s`` is carried on.

    The rows are cut into runs in which one state leads above the threshold. Within a run the takeover is a matter of arithmetic: the first row by which
    the leader has led ``HOLD`` rows and the cooldown since the last takeover is over. Rows of stale data are no part of any run.
    """
    live = np.flatnonzero(stale <= MOST_STALE)
    best = probs[live].argmax(axis=1)
    p, top = probs[live, best], names[best]
    leader = np.where(p > THRESHOLD, top, "")
    ends = np.append(np.flatnonzero(leader[1:] != leader[:-1]) + 1, len(live)) if len(live) else np.zeros(0, int)
    out, at = np.empty(len(live), dtype=object), 0
    while at < len(live):
        if s["active"] is None:
            stop = at + _first(p[at:] >= THRESHOLD, len(live) - at)
            out[at:stop] = None
            if stop < len(live):
                s.update(active=str(top[stop]), leader="", led=0, since=0)
                out[stop] = s["active"]
            at = stop + 1
            continue
        stop, name = int(ends[np.searchsorted(ends, at, side="right")]), str(leader[at])
        challenged = name not in ("", s["active"])
        led = s["led"] if challenged and name == s["leader"] else 0
        takeover = at + max(HOLD - led - 1, cooldown - s["since"], 0) if challenged else stop
        held = min(takeover, stop)
        out[at:held] = s["active"]
        s.update(leader=name if challenged else "", led=led + held - at if challenged else 0, since=s["since"] + held - at)
        if held < stop:
            s.update(active=name, leader="", led=0, since=0)
            out[held] = name
            held += 1
        at = held
    # a row of stale data keeps the state of the last live one before it
    return pd.Series(out, index=live, dtype=object).reindex(np.arange(len(probs)), method="ffill").to_numpy() if len(live) else np.full(len(probs), None, dtype=object)


def switching(s: dict, probs: np.ndarray, ahead: np.ndarray, labels: tuple[str, ...], cooldown: int, stale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(active state, size that it allows): 0 without a state, with stale data or with a close second; a half before a likely turn to stress; else 1."""
    names, before = np.array(labels, dtype=object), s["active"]
    active = active_states(s, probs, names, stale, cooldown)
    active = np.where(pd.isna(active), before, active)  # rows of stale data before the first live one
    two = np.sort(probs, axis=1)[:, -2:]
    close_second = two[:, 1] - two[:, 0] < UNCERTAIN if probs.shape[1] > 1 else np.zeros(len(probs), bool)
    turn = ((names[None, :] != active[:, None]) & np.isin(names, STRESSED)[None, :]) * ahead
    size = np.where(turn.sum(axis=1) > EARLY_CUT, 0.5, 1.0)
    return active, np.where(pd.isna(active) | (stale > MOST_STALE) | close_second, 0.0, size)


def hold_positions(s: dict, close: np.ndarray, rvol: np.ndarray, target: np.ndarray, rising: np.ndarray, crash: np.ndarray, may_enter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(position, action) of every row of a block; ``s`` is carried on.

    Time is cut into spells: flat until there is a target, held until the stop is hit or the target is gone, and after a stop waiting for a row without a rising
    trend. The stop of a spell lies two deviations below its first close.
    """
    n, at = len(close), 0
    position, action = np.zeros(n), np.full(n, "hold", dtype=object)
    enter = target > 0 if may_enter is None else (target > 0) & may_enter
    while at < n:
        if s["waits"]:
            off = at + _first(~rising[at:], n)
            s["waits"], at = off >= n, min(off + 1, n)
        elif s["position"] == 0:
            at += _first(enter[at:], n)
            if at < n:
                position[at], action[at] = target[at], "enter"
                s.update(position=float(target[at]), stop=float(close[at] * (1 - STOP_VOLS * max(rvol[at], 1e-6))))
                at += 1
        else:
            hit = close[at:] <= s["stop"]
            end = at + _first(hit | (target[at:] == 0), n - at)
            position[at:end] = target[at:end]
            action[at:end][np.diff(target[at:end], prepend=s["position"]) != 0] = "resize"
            if end > at:
                s["position"] = float(target[end - 1])
            if end < n:
                action[end] = "stop" if hit[end - at] else "crash" if crash[end] else "exit"
                s.update(position=0.0, waits=bool(hit[end - at]))
            at = end + 1
    return position, action


def limit_exposure(s: dict, day: np.ndarray, close: np.ndarray, wanted: np.ndarray, cap: np.ndarray, stale: np.ndarray, capital: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(allowed position, what decided, equity) of every row of a block; ``s`` is carried on.

    Until a loss limit is reached the path is the one without it, so each limit is a first-true flag over running values: the growth within the
    day, which blocks the rest of the day, and then the fall from the running maximum of the equity so far, which flattens for good.
    """
    n = len(close)
    free = np.where(stale > RISK_STALE, 0.0, np.clip(np.minimum(wanted, cap), 0, MOST_POSITION))
    moves = close / np.concatenate(([s["close"] if s["close"] is not None else close[0]], close[:-1])) - 1
    before = lambda a: np.concatenate(([s["allowed"]], a[:-1]))
    new_day = day != np.concatenate(([s["day"]], day[:-1]))
    first = np.maximum.accumulate(np.where(new_day, np.arange(n), -1))
    path = np.cumprod(1 + before(free) * moves)
    growth = np.where(first >= 0, path / path[np.maximum(first, 0)], s["day_growth"] * path)
    over = 1 - growth >= DAY_LOSS
    group = np.cumsum(new_day)
    lost = np.zeros(n, bool)
    if over.any() or s["lost"]:
        lost = pd.Series(over).groupby(group).cummax().to_numpy() | ((group == 0) & s["lost"])
    held = np.where(lost, 0.0, free)
    equity = np.cumprod(np.concatenate(([s["equity"]], 1 + before(held) * moves)))[1:]
    fall = 1 - equity / np.maximum.accumulate(np.maximum(equity, s["high"]))
    killed = np.maximum.accumulate(fall >= MOST_DRAWDOWN) | s["killed"]
    allowed = np.where(killed, 0.0, held)
    equity = np.cumprod(np.concatenate(([s["equity"]], 1 + before(allowed) * moves)))[1:]
    why = np.select([killed, lost, stale > RISK_STALE, (allowed > 0) & (allowed * capital > APPROVAL), allowed < wanted], ["kill", "flat_day", "stale", "approval", "cap"], "ok")
    s.update(close=float(close[-1]), allowed=float(allowed[-1]), equity=float(equity[-1]), high=float(max(s["high"], equity.max())), day=str(day[-1]), day_growth=float(growth[-1]), lost=bool(lost[-1]), killed=bool(killed[-1]))
    return allowed, why, equity


def _look_up(table: dict[str, float], active: np.ndarray) -> np.ndarray:
    return np.array([table.get(a, 0.0) for a in active])


WALKED = "probabilities array<double>, active string, size double, action string, position double, verdict string, equity double"


def walk(s: dict, rows: pd.DataFrame, model: dict, x: list[str], order: str, *, cooldown: int, capital: float) -> list[tuple]:
    """Walk a block of rows on from ``s``, which is changed; one tuple of WALKED per row. Equity earns the held position's return."""
    stale, close, trend = (rows[c].to_numpy(dtype=float) for c in ("stale", "close", "trend"))
    probs, _ = filter_rows(model, rows[x].to_numpy(dtype=float), None if s["row"] is None else np.asarray(s["row"]))
    s["row"] = probs[-1].tolist()
    active, size = switching(s, probs, probs @ model["trans"], tuple(model["labels"]), cooldown, stale)
    target = np.where(trend > 0, _look_up(STATE_MULTIPLIER, active) * size, 0.0)
    position, action = hold_positions(s, close, rows["rvol"].to_numpy(dtype=float), target, trend > 0, active == "CRASH")
    allowed, why, equity = limit_exposure(s, rows[order].astype(str).str[:10].to_numpy(), close, position, _look_up(STATE_CAP, active), stale, capital)
    return list(zip(probs.tolist(), active.tolist(), size.tolist(), action.tolist(), allowed.tolist(), why.tolist(), equity.tolist()))


def walk_history(features: DataFrame, models: DataFrame, x: list[str], *, key: str, order: str, cooldown: int = 3, capital: float = 10_000.0) -> DataFrame:
    """Filter, switching, book and limits over whole histories: rows with ``close, rvol, trend, stale``, and a model per series, which meets its history once and not on every row."""
    kinds, names = dict(features.dtypes), [c.split()[0] for c in WALKED.split(", ")]

    def each(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(model):
            return pd.DataFrame()
        pdf = pdf.sort_values(order)
        done = walk(new_walk(), pdf, _unpack(model.iloc[0], len(x)), x, order, cooldown=cooldown, capital=capital)
        return pd.DataFrame(done, columns=names).assign(**{key: pdf[key].to_numpy(), order: pdf[order].to_numpy()})[[key, order, *names]]

    return features.groupBy(key).cogroup(models.groupBy(key)).applyInPandas(each, f"{key} {kinds[key]}, {order} {kinds[order]}, {WALKED}")


def staleness(order: str, w, days: int = 1) -> Column:
    """Periods missing before a row (0 for one that follows the last at once or after a weekend)."""
    return F.greatest(F.coalesce(F.datediff(order, F.lag(order).over(w)), F.lit(days)) - 3, F.lit(0))


def state_report(walked: DataFrame, returns: DataFrame, *, key: str, order: str, ret: str = "ret") -> DataFrame:
    """Per series and active state: rows, share, mean and deviation of returns, mean run, and switches into it."""
    w = W.partitionBy(key).orderBy(order)
    x = walked.join(returns.select(key, order, ret), [key, order]).filter("active is not null")
    x = x.withColumn("enters", F.when(F.lag("active").over(w) == F.col("active"), 0).otherwise(1))
    g = x.groupBy(key, "active").agg(F.count(F.lit(1)).alias("rows"), F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("vol"), F.sum("enters").alias("runs"))
    return g.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy(key))).withColumn("mean_run", F.col("rows") / F.col("runs"))


def calibration_rows(walked: DataFrame, *, key: str, order: str, window: int = 200) -> DataFrame:
    """Was the likeliest state of a row still the likeliest one row later? With its share over the trailing rows that are resolved."""
    w = W.partitionBy(key).orderBy(order)
    top = F.array_position("probabilities", F.array_max("probabilities"))
    x = walked.withColumns({"top": top, "p": F.array_max("probabilities")})
    x = x.withColumn("stayed", F.when(F.lead("top").over(w).isNotNull(), (F.lead("top").over(w) == F.col("top")).cast("int")))
    past = w.rowsBetween(-window, -1)  # a row is resolved by the one after it
    return x.select(key, order, "p", "stayed", F.avg("stayed").over(past).alias("trailing"), F.count("stayed").over(past).alias("resolved"))


def match_states(previous: np.ndarray, current: np.ndarray) -> list[int]:
    """For each current state (mean, vol) in turn the nearest previous one not yet taken, in deviations of the previous ones; -1 if none is left."""
    gaps = np.linalg.norm((current[:, None, :] - previous[None, :, :]) / (previous.std(axis=0) + 1e-12), axis=2)
    out = []
    for row in gaps:
        out.append(int(row.argmin()) if np.isfinite(row).any() else -1)
        gaps[:, out[-1]] = np.inf if out[-1] >= 0 else gaps[:, out[-1]]
    return out


def drift(first: dict, now: dict, to: list[int]) -> tuple[bool, float, float]:
    """(all states matched, largest move of a mean or deviation in mean deviations, largest move of a row of transitions) of a refit; ``to`` are the matches."""
    s, t = (np.stack((m["state_means"], m["state_vols"]), axis=1) for m in (first, now))
    known = [i for i, j in enumerate(to) if j >= 0]
    moved = max((float(np.abs(t[i] - s[to[i]]).max()) for i in known), default=math.inf) / (float(s[:, 1].mean()) or 1e-9)
    whole = len(known) == len(to)
    shift = max(float(np.abs(now["trans"][i] - first["trans"][to[i]][to]).sum()) for i in range(len(to))) if whole else math.inf
    return whole, moved, shift


def refit_drift(first: DataFrame, current: DataFrame, *, key: str, d: int, sigma: float = DRIFT_SIGMA, row_l1: float = DRIFT_ROW) -> DataFrame:
    """``key, k, matched, moved, row_shift, drifted``: did a refit's states move by a deviation, or a row of its transitions by 0.30?"""

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        old, new = _unpack(a.iloc[0], d), _unpack(b.iloc[0], d)
        pair = lambda m: np.stack((m["state_means"], m["state_vols"]), axis=1)
        known, moved, shift = drift(old, new, match_states(pair(old), pair(new)))
        return pd.DataFrame([{key: a[key].iloc[0], "k": len(old["start"]), "matched": known, "moved": moved, "row_shift": shift, "drifted": not known or moved > sigma or shift > row_l1}])

    kind = dict(first.dtypes)[key]
    return first.groupBy(key, "k").cogroup(current.groupBy(key, "k")).applyInPandas(each, f"{key} {kind}, k int, matched boolean, moved double, row_shift double, drifted boolean")


# --- walk forward --------------------------------------------------------------------------------------------------


TRACK = "active string, size double, p double, top int, entropy double, frozen boolean, refit boolean, close double, rvol double, trend double, next_return double"


def regime_track(features: DataFrame, x: list[str], *, key: str, order: str, begin: float = 0.8, refit: int = REFIT_DAYS, cooldown: int = 3, fit=fit_chains) -> DataFrame:
    """Per series and row after the first ``begin`` of its history (all but the last row): the active state, its size, the filter's best state, and whether refits have drifted.

    ``features`` are rows of ``with_models``: the model was fitted on the first part. Every ``refit`` rows the chain is fitted anew on all rows before, from where the last fit ended and
    from one cold start; its states take the names of the nearest first ones, and the active state is carried over. Rows of one block see nothing after their own time.
    """
    kinds, names = dict(features.dtypes), [c.split()[0] for c in TRACK.split(", ")]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v, n = pdf[x].to_numpy(dtype=float), len(pdf)
        first = _unpack(pdf["model"].iloc[0], len(x))
        start, model, labels, frozen, s, parts = int(n * begin), first, tuple(first["labels"]), False, new_walk(), []
        for t in range(start, n - 1, refit):
            if t > start:
                model = fit(v[:t], len(first["start"]), 1, warm=model)
                _, mean, vol = state_statistics(model, v[:t])
                model = model | {"state_means": mean, "state_vols": vol}
                pair = lambda m: np.stack((m["state_means"], m["state_vols"]), axis=1)
                to = match_states(pair(first), pair(model))
                labels = tuple(first["labels"][j] if j >= 0 else "UNMATCHED" for j in to)
                known, moved, shift = drift(first, model, to)
                frozen = not known or moved > DRIFT_SIGMA or shift > DRIFT_ROW
            stop = min(t + refit, n - 1)
            past = filter_rows(model, v[:t])[0][-1]
            probs, _ = filter_rows(model, v[t:stop], past)
            active, size = switching(s, probs, probs @ model["trans"], labels, cooldown, np.zeros(stop - t))
            # the best state by its first number, so that it means the same after a refit
            place = {name: i for i, name in enumerate(first["labels"])}
            top = [place.get(labels[i], -1) for i in probs.argmax(axis=1)]
            h = -(probs * np.log(np.maximum(probs, 1e-300))).sum(axis=1) / max(math.log(probs.shape[1]), 1e-9)
            block = pdf.iloc[t:stop]
            parts.append(pd.DataFrame({
                key: block[key].to_numpy(), order: block[order].to_numpy(), "active": active, "size": size, "p": probs.max(axis=1), "top": top, "entropy": h, "frozen": frozen, "refit": (np.arange(t, stop) == t) & (t > start),
                "close": block["close"].to_numpy(), "rvol": block["rvol"].to_numpy(), "trend": block["trend"].to_numpy(), "next_return": pdf["close"].to_numpy()[t + 1 : stop + 1] / block["close"].to_numpy() - 1,
            }))
        return pd.concat(parts)[[key, order, *names]] if parts else pd.DataFrame()

    return features.groupBy(key).applyInPandas(each, f"{key} {kinds[key]}, {order} {kinds[order]}, {TRACK}")


def calibrated(track: DataFrame, *, key: str, order: str) -> DataFrame:
    """Adds ``calibrated``: over the last 200 rows whose outcome is known, did the best state stay with the probability it was given, to a calibration error of 0.05?"""
    w = W.partitionBy(key).orderBy(order)
    told, stayed = F.lag("p").over(w), (F.lag("top").over(w) == F.col("top")).cast("double")
    x = track.withColumns({"told": told, "stayed": stayed})
    x = x.withColumn("bin", F.least(F.floor(F.col("told") * BINS), F.lit(BINS - 1)))
    last = w.rowsBetween(1 - CALIBRATION_ROWS, 0)
    error = sum((F.abs(F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("told") - F.col("stayed"))).over(last), F.lit(0.0))) for b in range(BINS)), F.lit(0.0))
    return x.withColumn("calibrated", (F.count("told").over(last) >= CALIBRATION_ROWS) & (F.try_divide(error, F.count("told").over(last)) <= MOST_ERROR)).drop("told", "stayed", "bin")


def base_odds(features: DataFrame, *, key: str, order: str, begin: float = 0.8) -> DataFrame:
    """Per series ``p, b``: the share of winning round trips of the trend rule on the first part, and mean gain over mean loss; 0.5 and 1 below ten trips."""
    kinds = dict(features.dtypes)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf = pdf.iloc[: int(len(pdf) * begin)]
        close, rising = pdf["close"].to_numpy(dtype=float), pdf["trend"].to_numpy(dtype=float) > 0
        _, action = hold_positions(new_walk(), close, pdf["rvol"].to_numpy(dtype=float), rising.astype(float), rising, np.zeros(len(pdf), bool))
        into, out = close[action == "enter"], close[np.isin(action, ("stop", "exit"))]
        trips = out / into[: len(out)] - 1
        won, lost = trips[trips > 0], -trips[trips <= 0]
        p, b = (len(won) / len(trips), won.mean() / lost.mean() if len(won) and len(lost) and lost.mean() > 0 else 1.0) if len(trips) >= 10 else (0.5, 1.0)
        return pd.DataFrame([{key: pdf[key].iloc[0] if len(pdf) else None, "kelly_p": p, "kelly_b": b}]) if len(pdf) else pd.DataFrame()

    return features.groupBy(key).applyInPandas(each, f"{key} {kinds[key]}, kelly_p double, kelly_b double")


def arm_rows(track: DataFrame, odds: DataFrame, *, key: str, order: str, cost: float, capital: float = 10_000.0) -> DataFrame:
    """Per series, arm and row: ``position, action, verdict, pnl, costs, entered``. One group per (series, arm).

    ``hmm`` sizes the trend rule by state, switching and a quarter of Kelly's fraction (a floor where the filter is not calibrated); ``hmm_fixed`` leaves Kelly out, ``trend_only`` the
    states, and ``buy_hold`` holds. The arms with states do not enter while refits have drifted.
    """
    x = calibrated(track, key=key, order=order).join(odds, key)
    bet = F.least(QUARTER * kelly("kelly_p", "kelly_b"), F.lit(1.0))
    sized = F.when(F.col("calibrated"), bet * F.col("p") * (1 - F.col("entropy"))).otherwise(F.least(bet, F.lit(FLOOR_SIZE)))
    x = x.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    x = x.withColumn("cap", F.when(F.col("arm") == "hmm", F.col("size") * sized).when(F.col("arm") == "hmm_fixed", F.col("size")).otherwise(1.0)).withColumn("state", F.when(F.col("arm").isin("hmm", "hmm_fixed"), F.col("active")).otherwise("CALM_UP"))
    kinds = dict(track.dtypes)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        arm, close, rising = pdf["arm"].iloc[0], pdf["close"].to_numpy(dtype=float), pdf["trend"].to_numpy(dtype=float) > 0
        if arm == "buy_hold":
            position, action, why = np.ones(len(pdf)), np.full(len(pdf), "hold", dtype=object), np.full(len(pdf), "ok", dtype=object)
        else:
            state, s = pdf["state"].to_numpy(dtype=object), new_walk()
            target = np.where(rising, _look_up(STATE_MULTIPLIER, state) * pdf["cap"].to_numpy(dtype=float), 0.0)
            position, action = hold_positions(s, close, pdf["rvol"].to_numpy(dtype=float), target, rising, state == "CRASH", None if arm == "trend_only" else ~pdf["frozen"].to_numpy(dtype=bool))
            position, why, _ = limit_exposure(s, pdf[order].astype(str).str[:10].to_numpy(), close, position, _look_up(STATE_CAP, state), np.zeros(len(pdf)), capital)
        costs = cost * np.abs(np.diff(position, prepend=0.0))
        return pd.DataFrame({key: pdf[key], "arm": arm, order: pdf[order], "active": pdf["active"], "position": position, "action": action, "verdict": why, "pnl": position * pdf["next_return"] - costs, "costs": costs, "close": close})

    return x.groupBy(key, "arm").applyInPandas(each, f"{key} {kinds[key]}, arm string, {order} {kinds[order]}, active string, position double, action string, verdict string, pnl double, costs double, close double")


def arm_metrics(rows: DataFrame, *, key: str, order: str, per_year: float, cost: float) -> DataFrame:
    """Per series and arm: returns, Sharpe ratio, t statistic, drawdown, round trips and hit rate, costs, time in the market, and the six gates."""
    w = W.partitionBy(key, "arm").orderBy(order)
    x = rows.withColumn("equity", F.exp(F.sum(F.ln(F.greatest(1 + F.col("pnl"), F.lit(1e-6)))).over(w.rowsBetween(W.unboundedPreceding, 0))))
    x = x.withColumns({"high": F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)), "held": F.coalesce(F.lag("position").over(w), F.lit(0.0))})
    enters, leaves = (F.col("held") == 0) & (F.col("position") > 0), (F.col("held") > 0) & (F.col("position") == 0)
    x = x.withColumn("entry", F.last(F.when(enters, F.col("close")), ignorenulls=True).over(w)).withColumn("trip", F.when(leaves & (F.col("arm") != "buy_hold"), F.col("close") / F.col("entry") - 1 - 2 * cost))
    ratio, n = F.coalesce(F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")), F.lit(0.0)), F.count(F.lit(1))
    g = x.groupBy(key, "arm").agg(
        n.alias("rows"), (F.max_by("equity", order) - 1).alias("total_return"), (F.pow(F.max_by("equity", order), F.lit(per_year) / n) - 1).alias("annual_return"), (ratio * per_year**0.5).alias("sharpe"), (ratio * F.sqrt(n)).alias("t_stat"),
        F.max(1 - F.col("equity") / F.greatest(F.col("high"), F.lit(1.0))).alias("max_drawdown"), F.count("trip").alias("trips"), F.avg((F.col("trip") > 0).cast("double")).alias("hit_rate"), F.sum("costs").alias("costs"), F.avg((F.col("position") > 0).cast("double")).alias("in_market"),
    )
    other = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("total_return"))).over(W.partitionBy(key))
    g = g.withColumns({"of_hold": other("buy_hold"), "of_trend": other("trend_only")})
    gates = [F.col("sharpe") > GATES["sharpe"], F.col("max_drawdown") < GATES["max_drawdown"], F.coalesce(F.col("hit_rate") > GATES["hit_rate"], F.lit(False)), F.col("t_stat") > GATES["t_stat"], F.col("total_return") > F.col("of_hold"), F.col("total_return") > F.col("of_trend")]
    named = dict(zip(("sharpe_ok", "drawdown_ok", "hit_rate_ok", "t_stat_ok", "beats_hold", "beats_trend"), gates))
    out = g.withColumns({name: F.when(F.col("arm").isin("hmm", "hmm_fixed"), ok) for name, ok in named.items()}).drop("of_hold", "of_trend")
    return out.withColumn("passed", F.when(F.col("arm").isin("hmm", "hmm_fixed"), F.forall(F.array(*named), lambda ok: ok)))
