"""Regimes: fits that find planted chains, labels from statistics, literal walks, and blocks of any size."""

import inspect
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.operators import regimes
from asofkit.plans.regimes import ml1_ml2_regime_models

NAMES = ("STRESS", "CHOP", "CALM_UP")


def test_regime_grid_has_two_to_five_states_and_eight_restarts(spark):
    options = inspect.signature(regimes.fit_grid).parameters
    assert options["restarts"].default == 8 and options["states"].default == (2, 3, 4, 5)
    models = ml1_ml2_regime_models(spark, "/root/testdata/sf0.001").collect()
    assert {r["k"] for r in models} == {2, 3, 4, 5}
    assert all(abs(sum(r["start"]) - 1) < 1e-6 and r["means"][0] <= r["means"][2] and len(set(r["labels"])) == r["k"] for r in models)
    assert len({r["symbol"] for r in models if r["chosen"]}) == sum(r["chosen"] for r in models) == 5


@pytest.mark.parametrize("means, vols, labels", [
    ([-1.0, 1.0], [3.0, 1.0], ["STRESS", "CALM_UP"]), ([-1.0, 1.0], [1.0, 3.0], ["CALM_UP", "STRESS"]), ([0.0, 0.0], [1.0, 1.0], ["STRESS", "CALM_UP"]),
    ([-2.0, 0.1, 1.0], [1.0, 1.5, 3.0], ["CHOP", "CALM_UP", "STRESS"]), ([-2.0, 0.1, 1.0], [5.0, 1.5, 3.0], ["STRESS", "CHOP", "CALM_UP"]),
    ([-2.0, -0.1, 0.1, 1.0], [4.0, 3.0, 1.0, 2.0], ["CRASH", "STRESS", "CHOP", "CALM_UP"]), ([-2.0, -0.1, 0.1, 1.0], [1.0, 3.0, 2.0, 4.0], ["CHOP", "CHOP2", "CALM_UP", "STRESS"]),
    ([0.2, 0.3, 0.4, 1.0], [9.0, 3.0, 1.0, 2.0], ["STRESS", "CHOP2", "CHOP", "CALM_UP"]), ([-2.0, -1.0, 0.0, 0.1, 1.0], [5.0, 4.0, 2.0, 3.0, 1.0], ["CRASH", "STRESS", "CHOP", "CHOP2", "CALM_UP"]),
])
def test_labels_come_from_statistics(spark, means, vols, labels):
    df = spark.createDataFrame([(means, vols)], "m array<double>, v array<double>")
    assert df.select(regimes.label_states(F.col("m"), F.col("v")).alias("l")).first()["l"] == labels


def planted(n=1200, seed=1):
    rng = np.random.default_rng(seed)
    state = np.zeros(n, int)
    for t in range(1, n):
        state[t] = state[t - 1] if rng.random() < 0.97 else 1 - state[t - 1]
    return state, np.stack((np.where(state == 1, 0.02, -0.01) + rng.normal(0, 1, n) * np.where(state == 1, 0.004, 0.02), np.where(state == 1, 0.1, 0.4) + rng.normal(0, 0.03, n)), axis=1)


def test_fit_finds_planted_states_and_a_warm_start_goes_on():
    state, x = planted()
    m = regimes.fit_chains(x, 2, 3)
    assert abs(m["trans"][0, 0] - 0.97) < 0.02 and abs(m["trans"][1, 1] - 0.97) < 0.02
    probs, ll = regimes.filter_rows(m, x)
    assert (probs.argmax(axis=1) == state).mean() > 0.97
    again, ll2 = regimes.filter_rows(m, x[300:], probs[299])
    assert np.allclose(again, probs[300:]) and abs(regimes.filter_rows(m, x[:300])[1] + ll2 - ll) < 1e-6
    assert abs(m["log_likelihood"] - ll) < 1e-6 * abs(ll)
    warm = regimes.fit_chain(x, m, steps=3)
    assert warm["log_likelihood"] >= m["log_likelihood"] - 1e-6
    assert regimes.match_states(m["means"], m["means"][::-1]) == [1, 0] and regimes.match_states(m["means"][:1], m["means"]) == [0, -1]


def test_expectation_equals_a_sum_over_all_paths():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 1))
    m = {"start": np.array([0.3, 0.7]), "trans": np.array([[0.8, 0.2], [0.4, 0.6]]), "means": np.array([[-1.0], [1.0]]), "covars": np.ones((2, 1, 1))}
    density = lambda t, s: math.exp(-0.5 * (x[t, 0] - m["means"][s, 0]) ** 2) / math.sqrt(2 * math.pi)
    paths = {p: m["start"][p[0]] * math.prod(density(t, s) for t, s in enumerate(p)) * math.prod(m["trans"][a, b] for a, b in zip(p, p[1:])) for p in np.ndindex(*[2] * 6)}
    total = sum(paths.values())
    gamma, pairs, likelihood = regimes.expectation(m, x)
    assert likelihood == pytest.approx(math.log(total))
    assert np.allclose(gamma, [[sum(w for p, w in paths.items() if p[t] == s) / total for s in (0, 1)] for t in range(6)])
    assert np.allclose(pairs, [[sum(w * sum((a, b) == (i, j) for a, b in zip(p, p[1:])) for p, w in paths.items()) / total for j in (0, 1)] for i in (0, 1)])


def switched(rows, cooldown=4, stale=None, s=None):
    p = np.array(rows, dtype=float)
    return [list(a) for a in regimes.switching(s if s is not None else regimes.new_walk(), p, p, NAMES, cooldown, np.zeros(len(p)) if stale is None else np.array(stale))]


def test_switching_needs_hold_and_cooldown_and_goes_flat():
    calm, chop, stress = (0.0, 0.2, 0.8), (0.1, 0.8, 0.1), (0.9, 0.1, 0.0)
    active, size = switched([(0.1, 0.3, 0.6), calm, *[chop] * 5, (0.45, 0.5, 0.05), (0.3, 0.6, 0.1)])
    assert active == [None, *["CALM_UP"] * 5, *["CHOP"] * 3]  # held for three rows, but the cooldown of four ends later
    assert size == [0, 1, 1, 1, 1, 1, 1, 0, 0.5]
    assert switched([calm, *[chop] * 3, calm], cooldown=0)[0] == ["CALM_UP", "CALM_UP", "CALM_UP", "CHOP", "CHOP"]
    assert switched([calm, chop, chop, (0.3, 0.6, 0.1), chop, chop, chop], cooldown=0)[0] == ["CALM_UP"] * 6 + ["CHOP"]  # below the threshold the count begins anew
    active, size = switched([calm, chop, stress, chop, chop, chop], cooldown=0, stale=[0, 0, 3, 0, 0, 0])
    assert active == ["CALM_UP"] * 4 + ["CHOP"] * 2 and size[2] == 0  # stale data is flat and leaves the count alone
    assert switched([(0.35, 0.35, 0.3)] * 3) == [[None] * 3, [0, 0, 0]]


def held(close, target, rising=None, crash=None, s=None, **o):
    n = len(close)
    a = lambda x, d: np.array([d] * n if x is None else x)
    p, w = regimes.hold_positions(s if s is not None else regimes.new_walk(), np.array(close, float), np.full(n, 0.02), np.array(target, float), a(rising, True), a(crash, False), **o)
    return p.tolist(), w.tolist()


def test_book_stops_and_waits_for_the_trend_to_be_off():
    p, w = held([100, 99, 95, 97, 97, 97], [1, 0.5, 1, 1, 0, 1], [True, True, True, True, False, True])
    assert p == [1, 0.5, 0, 0, 0, 1] and w == ["enter", "resize", "stop", "hold", "hold", "enter"]
    assert held([100, 101, 102], [1, 0, 1]) == ([1, 0, 1], ["enter", "exit", "enter"])  # a target that is gone is no stop
    assert held([100, 101, 90], [1, 0, 1], crash=[False, True, False])[1] == ["enter", "crash", "enter"]
    assert held([100, 90, 100, 100], [1, 0, 1, 1], [True, False, True, True])[0] == [1, 0, 0, 0]  # the stop was hit when the trend was off: another such row is needed
    assert held([100, 101, 102], [1, 1, 1], may_enter=np.array([False, True, False]))[0] == [0, 1, 1]


def limited(day, close, wanted, cap=1.0, stale=0, capital=10_000.0, s=None):
    n = len(close)
    return [list(x) for x in regimes.limit_exposure(s if s is not None else regimes.new_walk(), np.array(day, dtype=object), np.array(close, float), np.array(wanted, float), np.full(n, cap), np.full(n, float(stale)), capital)]


def test_limits_cap_block_the_day_and_kill_for_good():
    assert limited(["a"], [100], [1.0])[:2] == [[0.75], ["cap"]] and limited(["a"], [100], [0.5], capital=1e6)[1] == ["approval"]
    assert limited(["a"], [100], [0.5], stale=4)[:2] == [[0.0], ["stale"]] and limited(["a"], [100], [0.5], cap=0.2)[0] == [0.2]
    allowed, why, equity = limited(["a", "a", "a", "b"], [100, 85, 100, 100], [0.5] * 4)
    assert why == ["ok", "flat_day", "flat_day", "ok"] and allowed == [0.5, 0, 0, 0.5] and equity == pytest.approx([1, 0.925, 0.925, 0.925])
    allowed, why, equity = limited(["a", "b", "c", "d"], [100, 59, 90, 90], [0.5] * 4)
    assert why == ["ok", "kill", "kill", "kill"] and equity == pytest.approx([1, 0.795, 0.795, 0.795])
    assert limited(["a", "b"], [100, 90], [0.75] * 2)[1] == ["ok", "ok"]  # a loss over night is none of the new day


def test_blocks_of_any_size_give_the_same_walk():
    rng = np.random.default_rng(4)
    for case in range(40):
        n = 120
        probs = rng.dirichlet((0.15, 0.15, 0.15), n).repeat(3, axis=0)[:n]
        stale, close, trend = rng.choice([0, 0, 0, 3, 4], n), 100 * np.exp(np.cumsum(rng.normal(0, 0.04, n))), np.repeat(rng.normal(size=n), 5)[:n]
        day = np.array([f"{t // 4:03d}" for t in range(n)], dtype=object)

        def run(edges):
            s, out = regimes.new_walk(), []
            for a, b in zip(edges, edges[1:]):
                active, size = regimes.switching(s, probs[a:b], probs[a:b], NAMES, 3, stale[a:b])
                target = np.where(trend[a:b] > 0, regimes._look_up(regimes.STATE_MULTIPLIER, active) * size, 0)
                position, action = regimes.hold_positions(s, close[a:b], np.full(b - a, 0.01), target, trend[a:b] > 0, active == "CRASH")
                allowed, why, equity = regimes.limit_exposure(s, day[a:b], close[a:b], position, regimes._look_up(regimes.STATE_CAP, active), stale[a:b], 1e4)
                out.append(pd.DataFrame({"a": active, "s": size, "p": position, "w": action, "l": allowed, "y": why, "e": equity}))
            return pd.concat(out, ignore_index=True)

        whole, cut = run([0, n]), run([0, *sorted(set(rng.integers(1, n, 12).tolist())), n])
        assert whole.drop(columns="e").astype(str).equals(cut.drop(columns="e").astype(str)) and np.allclose(whole["e"], cut["e"]), case


def test_walk_forward_refits_match_labels_and_freezes_on_drift(spark):
    _, x = planted(400)
    x[350:] += 0.3  # what the chain has not seen
    rows = [("S", t, float(100 * math.exp(x[: t + 1, 0].sum() * 0.01)), float(x[t, 0]), float(abs(x[t, 1])), float(math.sin(t / 7))) for t in range(400)]
    df = spark.createDataFrame(rows, "symbol string, t int, close double, ret double, rvol double, trend double")
    m = regimes.fit_chains(x[:300], 2, 2)
    _, mean, vol = regimes.state_statistics(m, x[:300])
    model = [("S", m["start"].tolist(), np.ravel(m["trans"]).tolist(), np.ravel(m["means"]).tolist(), np.ravel(m["covars"]).tolist(), ["STRESS", "CALM_UP"], mean.tolist(), vol.tolist())]
    models = spark.createDataFrame(model, f"symbol string, {regimes.MODEL}, labels array<string>, state_means array<double>, state_vols array<double>")
    run = lambda df: [r.asDict() for r in regimes.regime_track(regimes.with_models(df, models, "symbol"), ["ret", "rvol"], key="symbol", order="t", begin=0.75).orderBy("t").collect()]
    track = run(df)
    assert [r["t"] for r in track] == list(range(300, 399)) and [r["t"] for r in track if r["refit"]] == [330, 360, 390]
    assert not any(r["frozen"] for r in track if r["t"] < 360) and all(r["frozen"] for r in track if r["t"] >= 390)
    assert {r["active"] for r in track if r["t"] < 350} <= {None, "STRESS", "CALM_UP"}
    early = run(df.withColumn("ret", F.when(F.col("t") > 345, 0.0).otherwise(F.col("ret"))))  # what comes later changes nothing before
    assert [{k: r[k] for k in ("active", "p", "size", "frozen")} for r in track if r["t"] <= 345] == [{k: r[k] for k in ("active", "p", "size", "frozen")} for r in early if r["t"] <= 345]
    frame = spark.createDataFrame(pd.DataFrame(track)[["symbol", "t", "active", "size", "p", "top", "entropy", "frozen", "refit", "close", "rvol", "trend", "next_return"]], f"symbol string, t int, {regimes.TRACK}")
    odds = regimes.base_odds(df, key="symbol", order="t", begin=0.75)
    arms = regimes.arm_rows(frame, odds, key="symbol", order="t", cost=0.001)
    rows = arms.collect()
    assert len(rows) == 4 * 99 and {r["arm"] for r in rows} == set(regimes.ARMS)
    assert all(r["action"] != "enter" for r in rows if r["arm"] in ("hmm", "hmm_fixed") and r["t"] >= 390)
    hold = sorted((r["t"], r["pnl"]) for r in rows if r["arm"] == "buy_hold")
    metrics = {r["arm"]: r for r in regimes.arm_metrics(arms, key="symbol", order="t", per_year=252.0, cost=0.001).collect()}
    assert metrics["buy_hold"]["total_return"] == pytest.approx(math.prod(1 + p for _, p in hold) - 1) and metrics["buy_hold"]["passed"] is None
    pnl = np.array([p for _, p in hold])
    assert metrics["buy_hold"]["sharpe"] == pytest.approx(pnl.mean() / pnl.std(ddof=1) * 252**0.5) and metrics["hmm"]["passed"] in (True, False)


def test_every_fit_has_a_partition_of_its_own(spark, monkeypatch):
    def marked(x, m):
        from pyspark import TaskContext

        return m | {"log_likelihood": float(TaskContext.get().partitionId())}

    monkeypatch.setattr(regimes, "fit_chain", marked)
    rows = [(s, t, math.sin(t * (i + 1)), math.cos(t)) for i, s in enumerate(("a", "b", "c")) for t in range(80)]
    df = spark.createDataFrame(rows, "symbol string, t int, ret double, rvol double")
    grid = lambda **o: regimes.fit_grid(df, ["ret", "rvol"], key="symbol", order="t", **o).collect()
    fits = grid(restarts=1)
    assert len(fits) == 12 and len({r["log_likelihood"] for r in fits}) == 12
    assert {r["log_likelihood"] for r in grid(restarts=1, most_tasks=6)} == set(range(6))  # more fits than tasks are spread evenly
    assert sorted(r["log_likelihood"] for r in grid(states=(2,), restarts=4)) == [3, 7, 11]  # the likeliest restart is the last one of its series


def test_expectation_holds_no_matrix_per_row():
    import tracemalloc

    n, k = 50_000, 5
    x = np.random.default_rng(0).normal(size=(n, 2))
    m = regimes.cold_start(x, k, 1)
    tracemalloc.start()
    regimes.expectation(m, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * n * k * k * 8


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 997])
def test_expectation_equals_the_recursions_row_by_row(n):
    _, x = planted(1200)
    x, m = x[:n], regimes.fit_chains(x, 3, 1)
    alpha, likelihood = regimes.filter_rows(m, x)
    b = np.exp(regimes._densities(x, m["means"], m["covars"])).T
    beta, pairs = np.ones((n, 3)), np.zeros((3, 3))
    for t in range(n - 2, -1, -1):
        joint = alpha[t][:, None] * m["trans"] * b[t + 1] * beta[t + 1]
        pairs += joint / joint.sum()
        beta[t] = m["trans"] @ (b[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    gamma, got, total = regimes.expectation(m, x)
    both = alpha * beta
    assert np.allclose(gamma, both / both.sum(axis=1, keepdims=True)) and np.allclose(got, pairs) and total == pytest.approx(likelihood)


def test_a_model_meets_its_history_once(spark):
    _, x = planted(200)
    m = regimes.fit_chains(x, 2, 1)
    close, session = 100 * np.exp(np.cumsum(x[:, 0])), pd.date_range("2024-01-01", periods=200).date
    one = pd.DataFrame({"session": session, "close": close, "ret": x[:, 0], "rvol": np.abs(x[:, 1]), "trend": np.sin(np.arange(200) / 7), "stale": 0})
    df = spark.createDataFrame(pd.concat([one.assign(symbol=s) for s in ("a", "b")]))
    model = ("a", m["start"].tolist(), np.ravel(m["trans"]).tolist(), np.ravel(m["means"]).tolist(), np.ravel(m["covars"]).tolist(), ["STRESS", "CALM_UP"])
    models = spark.createDataFrame([model], f"symbol string, {regimes.MODEL}, labels array<string>")
    got = regimes.walk_history(df, models, ["ret", "rvol"], key="symbol", order="session").orderBy("session").collect()
    want = regimes.walk(regimes.new_walk(), one, regimes._unpack(models.first().asDict(), 2), ["ret", "rvol"], "session", cooldown=3, capital=10_000.0)
    assert [tuple(r)[1:] for r in got] == list(zip(session, *zip(*want))) and {r["symbol"] for r in got} == {"a"}  # no model, no walk
