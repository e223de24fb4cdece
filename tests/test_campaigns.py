"""Campaigns: captures against literal and brute-force values, and a stage machine that opens nothing it need not."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from asofkit.operators import campaigns as cp

MONDAY = date(2020, 1, 6)
RULES = cp.StageRules({"discovery": 8, "validation": 6, "holdout": 6}, 0.2, 2, False, {"validation": ["other"]}, resamples=50)


def week(i):
    return MONDAY + timedelta(days=7 * i)


def staged(spark, plan):
    """Captures of campaigns: name -> stage -> list of captures; positions alternate."""
    rows, first = [], {"discovery": 0, "validation": 20, "holdout": 40}
    for name, stages in plan.items():
        for stage, values in stages.items():
            rows += [(name, week(first[stage] + i), stage, 1 if i % 2 else -1, float(v), float(v) - 0.5) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "name string, week date, stage string, position int, base double, elevated double")


def run(spark, tmp_path, plan, rules=RULES, spec="s", folder="run", checks=None, before=None):
    captures = staged(spark, plan)
    checks = checks if checks is not None else captures.select("name", "week", F.lit("other").alias("check"), F.col("base").alias("value"))
    entrants = spark.createDataFrame([(n,) for n in plan], "name string")
    out = cp.run_stages(spark, str(tmp_path / folder), str(tmp_path / "receipts"), captures, checks, entrants, keys=["name"], rules=rules, spec=spec)
    return {(r["name"], r["stage"]): r for r in out.collect()}


GOOD = {"discovery": [1, 2] * 4, "validation": [1, 2] * 3, "holdout": [1, 2] * 3}


def test_each_stage_is_opened_for_those_that_passed_only(spark, tmp_path):
    got = run(spark, tmp_path, {"good": GOOD, "late": GOOD | {"validation": [1, -2] * 3}, "early": GOOD | {"discovery": [-1, -2] * 4}, "short": GOOD | {"discovery": [1] * 7}, "none": {}})
    assert {k: r["verdict"] for k, r in got.items()} == {
        ("good", "discovery"): "PASSED", ("good", "validation"): "PASSED", ("good", "holdout"): "PASSED", ("late", "discovery"): "PASSED", ("late", "validation"): "FAILED",
        ("early", "discovery"): "FAILED", ("short", "discovery"): "UNTESTABLE", ("none", "discovery"): "UNTESTABLE",
    }
    assert {n: r["campaign_verdict"] for (n, _), r in got.items()} == {"good": "PASSED", "late": "FAILED", "early": "FAILED", "short": "UNTESTABLE", "none": "UNTESTABLE"}
    assert got["good", "discovery"]["double_cost"] == "NOT_APPLICABLE" and got["good", "discovery"]["elevated_mean"] is None
    assert got["short", "discovery"]["reason"] == "weeks" and got["short", "discovery"]["mean"] is None and got["none", "discovery"]["weeks"] == 0


def test_a_stage_nobody_reached_is_not_read(spark, tmp_path, monkeypatch):
    """Later captures are unreadable from the first verdict on: a run that stops does not notice, one that goes on does."""
    judged = cp.judge_stage

    def spoil(folder):
        def judge(stage, *args):
            if stage == "discovery":
                for f in Path(tmp_path, folder, "captures").glob("stage=[vh]*/*.parquet"):
                    f.write_bytes(b"no parquet")
            return judged(stage, *args)

        monkeypatch.setattr(cp, "judge_stage", judge)

    spoil("stops")
    assert list(run(spark, tmp_path, {"bad": GOOD | {"discovery": [-1, -2] * 4}}, folder="stops")) == [("bad", "discovery")]
    spoil("goes")
    with pytest.raises(Exception, match="(?i)parquet"):
        run(spark, tmp_path, {"good": GOOD}, folder="goes", spec="t")


def test_a_receipt_is_used_once(spark, tmp_path):
    run(spark, tmp_path, {"good": GOOD}, folder="a")
    with pytest.raises(ValueError, match="discovery was opened before"):
        run(spark, tmp_path, {"good": GOOD, "new": GOOD}, folder="b")
    assert run(spark, tmp_path, {"good": GOOD}, folder="c", spec="another")["good", "holdout"]["verdict"] == "PASSED"
    assert run(spark, tmp_path, {"new": GOOD}, folder="d")["new", "holdout"]["verdict"] == "PASSED"


def test_a_check_without_observations_fails_and_a_traded_campaign_pays_twice(spark, tmp_path):
    no_checks = spark.createDataFrame([], "name string, week date, check string, value double")
    got = run(spark, tmp_path, {"good": GOOD}, checks=no_checks)
    assert got["good", "validation"]["failed"] == ["other"] and ("good", "holdout") not in got
    traded = cp.StageRules(RULES.least_weeks, 0.2, 2, True, {}, resamples=50)
    got = run(spark, tmp_path, {"thin": {"discovery": [0.4] * 8}, "fat": {"discovery": [0.6] * 8}}, rules=traded, folder="traded", spec="traded")
    assert got["thin", "discovery"]["failed"] == ["elevated_mean"] and got["thin", "discovery"]["double_cost"] == "FAILED"
    assert got["fat", "discovery"]["double_cost"] == "PASSED" and got["fat", "validation"]["verdict"] == "UNTESTABLE"


def test_one_sided_positions_are_untestable(spark, tmp_path):
    captures = staged(spark, {"x": GOOD}).withColumn("position", F.lit(1))
    entrants, checks = spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([], "name string, week date, check string, value double")
    row = cp.judge_stage("discovery", captures.filter("stage = 'discovery'").drop("stage"), checks, entrants, ["name"], RULES, "s").collect()[0]
    assert (row["verdict"], row["reason"], row["failed"]) == ("UNTESTABLE", "state share", [])


def random_rows(spark, n=60):
    draw = random.Random(3)
    rows = [(i, draw.choice([1, -1, None]), draw.choice([None, draw.uniform(-1, 1), draw.uniform(-1, 1)])) for i in range(n) if draw.random() < 0.85]
    return rows, spark.createDataFrame([("a", *r) for r in rows], "name string, i int, position int, y double")


def test_matured_captures_equal_a_brute_force_version(spark):
    rows, df = random_rows(spark)
    got = {r["i"]: r["base"] for r in cp.matured_captures(df, ["name"], position="position", outcome="y", horizon=4, warmup=5).collect()}
    for i, p, y in rows:
        old = [b for j, _, b in rows if b is not None and j + 4 <= i]
        want = p * (y - sum(old) / len(old)) if p and y is not None and len(old) >= 5 else None
        assert (got[i] is None and want is None) or got[i] == pytest.approx(want)


def test_turnover_resets_at_a_missing_week(spark):
    rows, df = random_rows(spark)
    got = {r["i"]: (r["base"], r["elevated"]) for r in cp.turnover_captures(df, ["name"], position="position", outcome="y", base_bps=10, elevated_bps=20).collect()}
    told, before = {i: (p, y) for i, p, y in rows}, 0
    for i in range(60):
        p, y = told.get(i, (None, None))
        if p is None or y is None:
            before = 0
            assert got.get(i, (None, None)) == (None, None)
            continue
        turnover = abs(p - before) * 2
        assert got[i] == (pytest.approx(p * y - turnover * 0.001), pytest.approx(p * y - turnover * 0.002))
        before = p


def test_an_outcome_known_on_the_day_of_the_decision_has_matured(spark):
    rows = [(week(i), 1, float(i), week(i + 2)) for i in range(8)]
    df = spark.createDataFrame([("a", *r) for r in rows], "name string, day date, position int, y double, known date")
    got = {r["day"]: r["base"] for r in cp.known_captures(df, ["name"], position="position", outcome="y", decision="day", known_on="known", warmup=3).collect()}
    assert [got[week(i)] for i in range(8)] == [None] * 4 + [4 - 1.0, 5 - 1.5, 6 - 2.0, 7 - 2.5]


def test_weeks_between_stages_belong_to_none_and_the_holdout_closes(spark):
    df = spark.createDataFrame([("a", i, 1.0 if i != 13 else None) for i in range(20)], "name string, i int, base double")
    bounds = spark.createDataFrame([("discovery", 0, 4), ("validation", 7, 9), ("holdout", 12, 99)], "stage string, first_i int, last_i int")
    got = {r["i"]: r["stage"] for r in cp.with_stage(df, bounds, ["name"], closes_after=3).collect()}
    assert got == {**{i: "discovery" for i in range(5)}, **{i: "validation" for i in range(7, 10)}, **{i: "holdout" for i in (12, 14, 15)}}
