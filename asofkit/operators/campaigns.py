"""Campaigns: outcomes on a grid of weeks, judged stage by stage, where a later stage is read only after the one before it has passed.

Many campaigns run at once, one per key; only their verdicts decide what is read next. The captures of a run lie in one folder per stage, so a stage that nobody
reached is not scanned. Every opening of a stage leaves a receipt, and a stage that has a receipt is never opened again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.operators.asof import asof
from asofkit.operators.gates import stage_gates

STAGES = ("discovery", "validation", "holdout")
FIGURES = ("mean", "first_half", "second_half", "without_best", "lower_bound", "elevated_mean")


@dataclass(frozen=True)
class StageRules:
    """What a campaign needs: weeks by stage, the least share of its rarer position, the length of resampled blocks, and the checks that each stage must pass."""

    least_weeks: Mapping[str, int]
    least_share: float
    block: int
    traded: bool
    checks: Mapping[str, Sequence[str]]
    resamples: int = 2000


# --- the grid, and what a position captured ------------------------------------------------------------------------


def week_of(day: str) -> Column:
    return F.trunc(day, "week")


def numbered(rows: DataFrame, origin: DataFrame, week: str = "week") -> DataFrame:
    """Adds ``i``, the number of the week on the grid of all weeks since the one of ``origin`` (one row, column ``first``); weeks without rows count too."""
    return rows.join(F.broadcast(origin), how="cross").withColumn("i", (F.date_diff(week, "first") / 7).cast("int")).drop("first")  # one row


def ahead(x: str, weeks: int, keys: Sequence[str], i: str = "i") -> Column:
    """The value ``weeks`` weeks later on the grid; NULL if that week has none."""
    return F.max(x).over(W.partitionBy(*keys).orderBy(i).rangeBetween(weeks, weeks))


def matured_captures(rows: DataFrame, keys: Sequence[str], *, position: str, outcome: str, horizon: int, warmup: int = 13, i: str = "i") -> DataFrame:
    """Adds ``base`` and ``elevated``: position times the outcome over the mean of the outcomes that had matured ``horizon`` weeks before.

    Outcomes of weeks without a position mature too. NULL without a position or an outcome, and below ``warmup`` matured outcomes.
    """
    old = W.partitionBy(*keys).orderBy(i).rangeBetween(W.unboundedPreceding, -horizon)
    capture = F.when(F.count(outcome).over(old) >= warmup, F.col(position) * (F.col(outcome) - F.avg(outcome).over(old)))
    return rows.withColumn("base", capture).withColumn("elevated", F.col("base"))


def known_captures(rows: DataFrame, keys: Sequence[str], *, position: str, outcome: str, decision: str, known_on: str, warmup: int = 3) -> DataFrame:
    """As ``matured_captures`` for outcomes that become known on days of their own: an outcome has matured if it was known on or before the decision."""
    running = W.partitionBy(*keys).orderBy("__known").rowsBetween(W.unboundedPreceding, 0)
    by_day = rows.filter(F.col(outcome).isNotNull() & F.col(known_on).isNotNull()).groupBy(*keys, F.col(known_on).alias("__known")).agg(F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    told = by_day.select(*keys, "__known", F.sum("s").over(running).alias("__s"), F.sum("n").over(running).alias("__n"))
    seen = asof(rows, told, keys=list(keys), left_ts=decision, right_ts="__known", values=["__s", "__n"])
    capture = F.when(F.col("__n") >= warmup, F.col(position) * (F.col(outcome) - F.col("__s") / F.col("__n")))
    return seen.withColumn("base", capture).withColumn("elevated", F.col("base")).select(*rows.columns, "base", "elevated")


def turnover_captures(rows: DataFrame, keys: Sequence[str], *, position: str, outcome: str, base_bps: float, elevated_bps: float, legs: int = 2, i: str = "i") -> DataFrame:
    """Adds ``base`` and ``elevated``: position times outcome less the cost of the change of position in every leg. A week without a position or an outcome is flat,
    so the week behind it pays for its whole position."""
    held = F.when(F.col(position).isNotNull() & F.col(outcome).isNotNull(), F.col(position))
    rows = rows.withColumn("__held", held)
    before = F.max("__held").over(W.partitionBy(*keys).orderBy(i).rangeBetween(-1, -1))
    turnover = F.abs(F.col("__held") - F.coalesce(before, F.lit(0))) * legs
    net = lambda bps: F.col("__held") * F.col(outcome) - bps * turnover / 10_000
    return rows.withColumns({"base": net(base_bps), "elevated": net(elevated_bps)}).drop("__held")


def with_stage(captures: DataFrame, bounds: DataFrame, keys: Sequence[str], *, closes_after: int, i: str = "i") -> DataFrame:
    """The weeks with a capture that lie in a stage. ``bounds`` has three rows (``stage, first_i, last_i``); the last stage takes the first ``closes_after`` of its weeks.

    Weeks between two stages belong to none.
    """
    on = captures.filter("base is not null").join(F.broadcast(bounds), F.col(i).between(F.col("first_i"), F.col("last_i"))).drop("first_i", "last_i")  # three rows
    place = F.row_number().over(W.partitionBy(*keys, "stage").orderBy(i))
    return on.withColumn("__place", place).filter((F.col("stage") != STAGES[-1]) | (F.col("__place") <= closes_after)).drop("__place")


# --- the stage machine ---------------------------------------------------------------------------------------------


def sign_checks(checks: DataFrame, chosen: DataFrame, entrants: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``keys, failed_checks``: of the named checks (``keys, week, check, value``) those whose mean over the chosen weeks is not positive; one without observations fails."""
    wanted = entrants.select(*keys, F.explode(F.array(*[F.lit(n) for n in names])).alias("check"))
    means = checks.join(chosen.select(*keys, "week"), [*keys, "week"]).groupBy(*keys, "check").agg(F.avg("value").alias("value"))
    bad = ~F.coalesce(F.col("value") > 0, F.lit(False))
    return wanted.join(means, [*keys, "check"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(bad, F.col("check")))).alias("failed_checks"))


def judge_stage(stage: str, captures: DataFrame, checks: DataFrame, entrants: DataFrame, keys: Sequence[str], rules: StageRules, seed: str) -> DataFrame:
    """One row per entrant: ``weeks``, the figures of its gates, what failed, why it is untestable, and ``verdict``.

    Too few weeks, none included, or too few in the rarer position make a stage UNTESTABLE; it then shows no figures and needs no checks.
    """
    keys = list(keys)
    report = stage_gates(captures, keys, "week", "base", "elevated", "position", min_periods=rules.least_weeks[stage], min_share=rules.least_share, block=rules.block, resamples=rules.resamples, seed=seed, traded=rules.traded)
    out = entrants.join(report.withColumnRenamed("verdict", "__gates"), keys, "left").withColumn("weeks", F.coalesce("periods", F.lit(0).cast("long")))
    names = list(rules.checks.get(stage, ()))
    out = out.join(sign_checks(checks, captures, entrants, keys, names), keys, "left") if names else out.withColumn("failed_checks", F.array().cast("array<string>"))
    untestable = F.coalesce(F.col("__gates"), F.lit("UNTESTABLE")) == "UNTESTABLE"
    gates = [c for c in FIGURES if rules.traded or c != "elevated_mean"]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c) > 0, F.lit(False)), F.lit(c)) for c in gates]))
    failed = F.when(untestable, F.array().cast("array<string>")).otherwise(F.concat(broken, "failed_checks"))
    double_cost = F.when(untestable | F.lit(not rules.traded), "NOT_APPLICABLE").when(F.col("elevated_mean") > 0, "PASSED").otherwise("FAILED")
    out = out.withColumns({"failed": failed, "double_cost": double_cost, "reason": F.when(untestable, F.when(F.col("weeks") < rules.least_weeks[stage], "weeks").otherwise("state share"))})
    verdict = F.when(untestable, "UNTESTABLE").when(F.size("failed") > 0, "FAILED").otherwise("PASSED")
    return out.select(*keys, "weeks", *[F.when(~untestable, F.col(c)).alias(c) for c in FIGURES], "double_cost", "failed", "reason", verdict.alias("verdict"))


def open_stage(spark: SparkSession, receipts: str, entrants: DataFrame, keys: Sequence[str], spec: str, stage: str) -> None:
    """Leave a receipt for every entrant before its stage is read; an error if one of them has opened this stage under this specification before."""
    mine = entrants.select(*keys, F.lit(spec).alias("spec"), F.lit(stage).alias("stage"))
    mine.limit(0).write.mode("ignore").parquet(receipts)
    before = spark.read.schema(mine.schema).parquet(receipts).filter((F.col("spec") == spec) & (F.col("stage") == stage))
    if not before.join(entrants, list(keys), "left_semi").isEmpty():
        raise ValueError(f"{stage} was opened before: its receipt is used")
    mine.write.mode("append").parquet(receipts)


def run_stages(spark: SparkSession, folder: str, receipts: str, captures: DataFrame, checks: DataFrame, entrants: DataFrame, *, keys: Sequence[str], rules: StageRules, spec: str) -> DataFrame:
    """Reports of all stages that were opened: ``keys, stage``, the columns of ``judge_stage`` and ``campaign_verdict``.

    ``captures`` (``keys, week, stage, position, base, elevated``) and ``checks`` (``keys, week, check, value``) are written once, by stage. ``entrants`` are the distinct keys that take part, with or
    without captures. A stage is opened for those that passed the one before and for no others, and not read at all if there are none. ``campaign_verdict`` is the verdict of the
    last stage a campaign reached, so PASSED means that it passed the holdout. ``folder`` is new for each run, ``receipts`` is kept.
    """
    keys = list(keys)
    kept = captures.select(*keys, "week", "stage", "position", "base", "elevated")
    kept.write.partitionBy("stage").parquet(f"{folder}/captures")
    told = checks.join(spark.read.schema(kept.schema).parquet(f"{folder}/captures").select(*keys, "week", "stage"), [*keys, "week"])
    told.select(*keys, "week", "stage", "check", "value").write.partitionBy("stage").parquet(f"{folder}/checks")
    still = entrants.select(*keys)
    for stage in STAGES:
        open_stage(spark, receipts, still, keys, spec, stage)
        only = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}").filter(F.col("stage") == stage).drop("stage")  # noqa: B023, E731
        rows = only("captures", kept.schema).join(still, keys, "left_semi")
        shown = only("checks", told.select(*keys, "week", "stage", "check", "value").schema)
        judge_stage(stage, rows, shown, still, keys, rules, f"{spec}|{stage}").write.parquet(f"{folder}/reports/stage={stage}")
        still = spark.read.parquet(f"{folder}/reports/stage={stage}").filter("verdict = 'PASSED'").select(*keys)
        if still.isEmpty():
            break
    reports = spark.read.parquet(f"{folder}/reports")
    last = F.max_by("verdict", F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))).over(W.partitionBy(*keys))
    return reports.withColumn("campaign_verdict", last)
