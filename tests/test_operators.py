"""Literal cases, causality and admission rules of the research operators."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.functions import scalars as fn
from asofkit.operators import calendar as cal
from asofkit.operators import rules, vintages
from asofkit.operators import windows as win
from asofkit.operators.asof import asof
from asofkit.plans import admission
from asofkit.sources.tables import daily_bars


def test_calendar_matches_the_published_schedule(spark):
    assert cal.sessions(spark, "2025-01-01", "2025-12-31").count() == 250
    closed = {str(r[0]) for r in cal.holidays(spark, 2026, 2027).collect()}
    assert {"2026-04-03", "2026-07-03", "2026-11-26", "2027-03-26", "2027-12-24"} <= closed
    assert "2027-12-31" not in closed
    with pytest.raises(ValueError):
        cal.holidays(spark, 2021, 2022)


def test_normal_distribution_is_close(spark):
    xs = [x / 10 for x in range(-60, 61)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", fn.norm_cdf("x").alias("p")).collect()
    assert max(abs(r["p"] - 0.5 * (1 + math.erf(r["x"] / 2**0.5))) for r in got) < 1e-7


LESS = {"op": "lt", "observation": {"obs": "return_from_open", "minute": 600}, "value": 1}
MORE = {"op": "gte", "observation": {"obs": "return_from_open", "minute": 600}, "value": 1}
FEATURE = {"op": "gt", "observation": {"obs": "feature", "family": "portfolio_signal", "metric": "m"}, "value": 0}
TOUCH = {"op": "observed", "observation": {"obs": "first_touch_before_entry", "after_minute": 590, "open_offset": 2}}


def _document(signal, **changes):
    return json.dumps({"schema_version": 3, "entry_minute": 630, "signal": signal, "structure": {"helper": "call_debit_spread", "width": 5, "otm_offset": 0}} | changes)


def _judge(spark, documents):
    """The verdicts in the order of the documents."""
    rows = rules.judge_proposals(spark.createDataFrame(list(enumerate(documents)), "attempt int, document string").coalesce(1)).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["attempt"])]


def _not(x):
    return {"op": "not", "arg": x}


def test_unknown_observation_is_false_and_not_stays_above_it(spark):
    df = spark.createDataFrame([(None,), (1.0,), (-1.0,)], "x double")
    run = lambda rule: [r[0] for r in df.select(rules.compile_rule(rule, lambda o: F.col("x"))).collect()]
    assert run(_not(LESS)) == [True, True, False]
    assert run(MORE) == [False, True, False]
    a, b, c, d = _judge(spark, [_document(x) for x in (_not(LESS), MORE, _not(_not(LESS)), LESS)])
    assert a["ok"] and b["ok"] and a["rule_hash"] != b["rule_hash"] and c["rule_hash"] == d["rule_hash"]


def test_rules_of_one_meaning_share_a_hash(spark):
    same = [{"op": "and", "args": [LESS, TOUCH]}, _not({"op": "or", "args": [_not(TOUCH), _not(LESS)]}), {"op": "and", "args": [TOUCH, LESS | {"value": 1.0}]}]
    nested = [{"op": "and", "args": [{"op": "and", "args": [LESS, TOUCH]}, FEATURE]}, {"op": "and", "args": [FEATURE, LESS, TOUCH]}]
    got = _judge(spark, [_document(x) for x in (*same, FEATURE, *nested)])
    a = got[0]
    assert a["ok"] and len({g["rule_hash"] for g in got[:3]}) == 1 and got[4]["canonical"] == got[5]["canonical"] != a["canonical"]
    assert (a["minutes"], a["thresholds"], a["bucket"], a["helper"], a["width"], a["otm_offset"]) == ([590, 600], [2.0, 1.0], 630, "call_debit_spread", 5.0, 0.0)
    assert a["family"] == "and/observed/lt:first_touch_before_entry+return_from_open" and got[3]["reads"] == ["portfolio_signal.m"]
    assert a["canonical"] == json.dumps(json.loads(a["canonical"]), sort_keys=True, separators=(",", ":"))
    assert [g["duplicate_of"] for g in got] == [None, 0, 0, None, None, 4]


def test_equal_documents_are_judged_once_and_point_to_the_first_attempt(spark, monkeypatch):
    seen, nodes = [], rules.signal_nodes
    monkeypatch.setattr(rules, "signal_nodes", lambda p: (seen.append(p.count()), nodes(p))[1])
    got = _judge(spark, [_document(LESS), None, _document(_not(_not(LESS))), "{", _document(MORE)] * 20)
    assert seen == [5]
    assert [g["duplicate_of"] for g in got] == [None, None, 0, None, None, *[0, None, 0, None, 4] * 19]
    assert [g["reason"] for g in got] == [None, "malformed", None, "malformed", None] * 20 and len({g["canonical"] for g in got}) == 3


def _broadcast_unmeasured(df):
    """The tables that the plan broadcasts by an estimate alone, as no shuffle lies between the file and the driver."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line) or "Exchange" in below:
                    break
                found += [below] if "FileScan" in below else []
    return found


def test_proposals_are_not_broadcast_by_the_size_of_their_keys(spark, tmp_path):
    spark.range(400).write.parquet(str(tmp_path / "keys"))
    head, tail = _document(LESS | {"value": 77}).split("77")
    proposals = spark.read.parquet(str(tmp_path / "keys")).select(F.col("id").alias("attempt"), F.concat(F.lit(head), (F.col("id") % 40).cast("string"), F.lit(tail)).alias("document"))
    judged = rules.judge_proposals(proposals)
    assert not _broadcast_unmeasured(judged)
    got = {r["attempt"]: (r["ok"], r["duplicate_of"]) for r in judged.collect()}
    assert got == {k: (True, k % 40 if k >= 40 else None) for k in range(400)}
    assert "Broadcast" not in judged._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ev21_batch_admission", "prj12_join20_feature_reads", "prj9_prj10_prj11_proposals", "join18_near_duplicates"])
def test_queries_on_proposals_broadcast_no_table_by_an_estimate(spark, name):
    assert not _broadcast_unmeasured(admission.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_the_admission_reads_written_verdicts(spark):
    admitted = admission.ev21_batch_admission(spark, "/root/testdata/sf0.001")
    assert "variant" not in admitted._jdf.queryExecution().optimizedPlan().toString()
    assert admitted.filter("decision = 'admitted'").count() == 3


REFUSED = [
    ({"op": "and", "args": [LESS, LESS]}, {}, "repeated condition"), (LESS, {"schema_version": 99}, "unsupported version"), (LESS, {"schema_version": 3.0}, "unsupported version"), (LESS, {"entry_minute": -605}, "entry_minute"),
    (LESS, {"entry_minute": 632}, "entry_minute"), (_not(FEATURE), {}, "feature under not"), (_not(_not(FEATURE)), {}, "feature under not"), (LESS | {"value": True}, {}, "value"),
    (LESS | {"value": 1e9}, {}, "value"), (LESS | {"value": "1"}, {}, "value"), (LESS | {"more": 1}, {}, "unexpected"), ({"op": "lt", "observation": TOUCH["observation"], "value": 1}, {}, "first touch"),
    ({"op": "observed", "observation": LESS["observation"]}, {}, "first touch"), ({"op": "lt", "observation": {"obs": "return_from_open", "minute": 640}, "value": 1}, {}, "minute"),
    ({"op": "lt", "observation": {"obs": "return_from_open", "minute": 600.0}, "value": 1}, {}, "minute"), ({"op": "lt", "observation": {"obs": "return_between", "start_minute": 600, "end_minute": 600}, "value": 1}, {}, "start is not before end"),
    ({"op": "lt", "observation": {"obs": "tea_leaves"}, "value": 1}, {}, "unknown observation"), ({"op": "xor", "args": [LESS, TOUCH]}, {}, "unknown operator"),
    ({"op": "lt", "observation": FEATURE["observation"] | {"metric": "Bad Name"}, "value": 1}, {}, "bad metric"), ({"op": "lt", "observation": FEATURE["observation"] | {"family": "tarot"}, "value": 1}, {}, "feature family"),
    ({"op": "and", "args": [LESS]}, {}, "two to eight"), ({"op": "or", "args": [LESS | {"value": k} for k in range(9)]}, {}, "two to eight"), (LESS, {"structure": {"helper": "naked_call", "width": 5, "otm_offset": 0}}, "unknown structure"),
    ({"op": "or", "args": [{"op": "and", "args": [LESS | {"value": k}, MORE | {"value": k}]} for k in range(5)]}, {}, "too many conditions"), (LESS, {"structure": {"helper": "call_debit_spread", "width": 5, "otm_offset": 21}}, "otm_offset"),
    (LESS, {"structure": {"helper": "call_debit_spread", "width": 0, "otm_offset": 0}}, "width"), (LESS, {"structure": None}, "structure"), (None, {}, "malformed"), (LESS, {"extra": 1}, "document"),
    (_not(_not(_not(_not(_not(_not(LESS)))))), {}, "too deep"), ({"op": "and", "args": [LESS, None]}, {}, "malformed"), ({"op": 3}, {}, "malformed"),
]


def test_what_is_not_admissible_is_refused(spark):
    plain = ["not json", None, "[1]", "3", "{}", '{"a":1,"a":2}']
    got = _judge(spark, [*[_document(signal, **changes) for signal, changes, _ in REFUSED], *plain])
    for (signal, changes, reason), g in zip(REFUSED, got):
        assert not g["ok"] and reason in g["reason"] and g["canonical"] is None and g["rule_hash"] is None, (signal, changes, g)
    assert not any(g["ok"] for g in got[len(REFUSED) :])


def test_canonical_rules_mean_what_was_proposed(spark):
    """Random trees against their canonical form, on every combination of answers of their leaves."""
    rng = np.random.default_rng(11)
    leaves = [LESS, LESS | {"value": -2.5}, TOUCH, MORE | {"value": 7}]

    def tree(depth):
        kind = rng.choice(["leaf", "not", "and", "or"]) if depth < 5 else "leaf"
        if kind == "leaf":
            return leaves[rng.integers(len(leaves))]
        return _not(tree(depth + 1)) if kind == "not" else {"op": str(kind), "args": [tree(depth + 1) for _ in range(2)]}

    def answer(t, known):
        if "observation" in t:
            return known[json.dumps(t | ({"value": float(t["value"])} if "value" in t else {}), sort_keys=True)]
        if t["op"] == "not":
            return not answer(t["arg"], known)
        return (all if t["op"] == "and" else any)([answer(a, known) for a in t["args"]])

    trees = [tree(1) for _ in range(150)]
    keys = [json.dumps(x | ({"value": float(x["value"])} if "value" in x else {}), sort_keys=True) for x in leaves]
    good = 0
    for t, g in zip(trees, _judge(spark, [_document(t) for t in trees])):
        if not g["ok"]:
            assert g["reason"] in ("repeated condition", "too many conditions"), g["reason"]
            continue
        good += 1
        canonical = json.loads(g["canonical"])["signal"]
        for bits in range(16):
            known = {k: bool(bits >> i & 1) for i, k in enumerate(keys)}
            assert answer(t, known) == answer(canonical, known)
        assert "not" not in [n["op"] for n in _junctions(canonical) if "observation" not in n.get("arg", {"observation": 1})]
    assert good > 50


def _junctions(t):
    below = t.get("args") or ([t["arg"]] if "arg" in t else [])
    return [t, *[n for b in below for n in _junctions(b)]]


def test_asof_is_strict_tolerant_and_ties_by_key(spark):
    t = lambda m: dt.datetime(2024, 1, 2, 10, m)
    left = spark.createDataFrame([("a", t(10)), ("a", t(40)), ("b", t(10))], "k string, at timestamp")
    right = spark.createDataFrame([("a", t(10), 1), ("a", t(5), 2), ("a", t(5), 3)], "k string, ts timestamp, v int")
    run = lambda **o: {(r["k"], r["at"].minute): r["v"] for r in asof(left, right, keys=["k"], left_ts="at", right_ts="ts", values=["v"], tie=["v"], **o).collect()}
    assert run() == {("a", 10): 1, ("a", 40): 1, ("b", 10): None}
    assert run(strict=True) == {("a", 10): 3, ("a", 40): 1, ("b", 10): None}
    assert run(tolerance_seconds=900) == {("a", 10): 1, ("a", 40): None, ("b", 10): None}


def test_asof_ties_sort_by_number_and_tolerance_counts_parts_of_a_second(spark):
    t = lambda s, us=0: dt.datetime(2024, 1, 2, 10, 0, s, us)
    left = spark.createDataFrame([("a", t(10)), ("b", t(20, 900_000)), ("c", t(20, 100_000))], "k string, at timestamp")
    right = spark.createDataFrame([("a", t(5), 9), ("a", t(5), 10), ("b", t(10, 100_000), 1), ("c", t(10, 100_000), 2)], "k string, ts timestamp, v int")
    out = asof(left, right, keys=["k"], left_ts="at", right_ts="ts", values=["v"], tie=["v"], tolerance_seconds=10)
    assert {r["k"]: r["v"] for r in out.collect()} == {"a": 10, "b": None, "c": 2}


def test_features_do_not_see_the_future(spark):
    bars = daily_bars(spark, "/root/testdata/sf0.001")

    def features(df):
        w = win.series()
        df = df.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)
        return df.select("symbol", "session", F.round(win.realized_vol("ret", 5, w), 9).alias("v"), F.round(win.past_zscore("ret", 10, w), 9).alias("z"), F.round(win.correlation("ret", "volume", 5, w), 9).alias("c"))

    cut = bars.agg(F.percentile_approx(F.unix_date("session"), 0.5)).first()[0]
    past = F.unix_date("session") <= cut
    whole = {tuple(r) for r in features(bars).filter(past).collect()}
    assert whole == {tuple(r) for r in features(bars.filter(past)).collect()}
    assert whole == {tuple(r) for r in features(bars.repartition(7, "volume")).filter(past).collect()}


def test_vintages_keep_changes_and_list_confirmations(spark):
    d = dt.date
    rows = [("x", d(2024, 3, 31), d(2024, 5, 1), "a", 10.0), ("x", d(2024, 3, 31), d(2024, 8, 1), "b", 10.0), ("x", d(2024, 3, 31), d(2024, 9, 1), "c", 11.0)]
    got = vintages.vintages(spark.createDataFrame(rows, "symbol string, end date, filed date, accession string, value double")).orderBy("vintage").collect()
    assert [(r["vintage"], r["value"], r["accession"], r["confirmed_by"]) for r in got] == [(1, 10.0, "a", ["b"]), (2, 11.0, "c", [])]


def test_quarters_from_year_to_date_do_not_bridge_gaps(spark):
    d, s = dt.date, dt.date(2024, 1, 1)
    rows = [("x", s, d(2024, 3, 31), 10.0), ("x", s, d(2024, 6, 30), 22.0), ("x", s, d(2024, 12, 31), 56.0)]
    got = {r["end"].month: (r["method"], r["value"]) for r in vintages.discrete_quarters(spark.createDataFrame(rows, "symbol string, start date, end date, value double")).collect()}
    assert got == {3: ("direct", 10.0), 6: ("ytd_diff", 12.0), 12: (None, None)}


def test_streamed_walk_equals_the_batch_walk(spark):
    from asofkit.plans.regimes import str5_str8_streamed_walk, str5_str8_walk

    batch = {(r["symbol"], r["session"]): tuple(r) for r in str5_str8_walk(spark, "/root/testdata/sf0.001").collect()}
    stream = {(r["symbol"], r["session"]): tuple(r) for r in str5_str8_streamed_walk(spark, "/root/testdata/sf0.001").collect()}
    assert batch and batch.keys() == stream.keys() and all(batch[k] == stream[k] for k in batch)


def test_wilder_adx_of_a_straight_rise_is_100_and_of_no_move_0():
    from asofkit.operators.indicators import adx

    x = np.arange(1.0, 60)
    assert np.isnan(adx(x + 0.5, x - 0.5, x, 14)[:27]).all() and adx(x + 0.5, x - 0.5, x, 14)[-1] == pytest.approx(100)
    flat = np.full(40, 5.0)
    assert adx(flat, flat, flat, 14)[-1] == 0
