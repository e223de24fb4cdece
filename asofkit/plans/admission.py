"""Queries on proposals: admissibility, canonical form, descriptors, reads, near duplicates and the admission of a batch.

Proposals are made from the parts: of every eight, four are valid (two of them with one meaning) and four are not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import rules
from asofkit.sources.files import work_folder
from asofkit.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


_G, _V = "(p_partkey // 8)", "((p_partkey // 8) % 40)"
_VALUE = f"CASE WHEN {_V} % 20 = 0 THEN CAST({_V} // 20 AS VARCHAR) ELSE CAST({_V} / 20.0 AS VARCHAR) END"
_BETWEEN = """{"observation":{"end_minute":600,"obs":"return_between","start_minute":575},"op":"gt","value":0.5}"""
_OPEN = f"""'{{"observation":{{"minute":600,"obs":"return_from_open"}},"op":"lt","value":' || {_VALUE} || '}}'"""
_STRUCTURE = """"structure":{"helper":"call_debit_spread","otm_offset":0,"width":5}}"""

#: The verdicts that the proposals must get, in SQL.
_JUDGED = f"""judged AS (SELECT *, CASE WHEN ok THEN sha256('{{"entry_minute":630,"schema_version":3,"signal":' || signal || ',{_STRUCTURE}') END AS rule_hash FROM (
SELECT p_partkey AS attempt, p_partkey % 8 AS k, p_partkey % 8 IN (0, 1, 5, 7) AS ok, {_V} / 20.0 AS v,
CASE p_partkey % 8 WHEN 2 THEN 'unsupported version' WHEN 3 THEN 'minute: not on the grid before entry' WHEN 4 THEN 'feature under not' WHEN 6 THEN 'unknown observation' END AS reason,
CASE WHEN p_partkey % 8 < 2 THEN '{{"args":[{_BETWEEN},' || {_OPEN} || '],"op":"and"}}' WHEN p_partkey % 8 = 5 THEN '{{"arg":' || {_OPEN} || ',"op":"not"}}'
 WHEN p_partkey % 8 = 7 THEN '{{"observation":{{"family":"portfolio_signal","metric":"m' || {_G} % 3 || '","obs":"feature"}},"op":"gte","value":' || {_VALUE} || '}}' END AS signal,
CASE WHEN p_partkey % 8 < 2 THEN 'and/gt/lt:return_between+return_from_open' WHEN p_partkey % 8 = 5 THEN 'not/lt:return_from_open' WHEN p_partkey % 8 = 7 THEN 'gte:feature:portfolio_signal.m' || {_G} % 3 END AS family,
CASE WHEN p_partkey % 8 = 7 THEN 'm' || {_G} % 3 END AS metric FROM part)),
firsts AS (SELECT *, CASE WHEN ok AND min(attempt) OVER (PARTITION BY rule_hash) < attempt THEN min(attempt) OVER (PARTITION BY rule_hash) END AS duplicate_of FROM judged),
near AS (SELECT a.attempt AS first, b.attempt AS second FROM firsts a JOIN firsts b ON a.family = b.family AND a.attempt < b.attempt AND a.v <> b.v AND abs(a.v - b.v) / 0.1 < 1.0 WHERE a.ok AND b.ok AND a.duplicate_of IS NULL AND b.duplicate_of IS NULL)"""


def proposals(spark, d):
    """``attempt, document``."""
    p = table(spark, d, "part")
    g, k = F.floor(F.col("p_partkey") / 8), F.col("p_partkey") % 8
    v = ((g % 40) / 20.0).cast("string")
    open_ = lambda minute: F.concat(F.lit('{"op":"lt","observation":{"obs":"return_from_open","minute":' + str(minute) + '},"value":'), v, F.lit("}"))
    feature = F.concat(F.lit('{"op":"gte","observation":{"obs":"feature","family":"portfolio_signal","metric":"m'), (g % 3).cast("string"), F.lit('"},"value":'), v, F.lit("}"))
    negated = lambda x: F.concat(F.lit('{"op":"not","arg":'), x, F.lit("}"))
    pair = lambda op, a, b: F.concat(F.lit(f'{{"op":"{op}","args":['), a, F.lit(","), b, F.lit("]}"))
    between = F.lit(_BETWEEN)
    signal = (
        F.when(k == 0, pair("and", open_(600), between)).when(k == 1, negated(pair("or", negated(between), negated(open_(600))))).when(k == 3, open_(-605)).when(k == 4, negated(feature))
        .when(k == 5, negated(open_(600))).when(k == 6, F.lit('{"op":"lt","observation":{"obs":"crystal_ball","minute":600},"value":1}')).when(k == 7, feature).otherwise(open_(600))
    )
    version = F.when(k == 2, "99").otherwise("3")
    document = F.concat(F.lit('{"schema_version":'), version, F.lit(',"entry_minute":630,"signal":'), signal, F.lit(',"structure":{"helper":"call_debit_spread","width":5.0,"otm_offset":0}}'))
    return p.select(F.col("p_partkey").alias("attempt"), document.alias("document"))


@query(f"WITH {_JUDGED} SELECT attempt, ok, reason, rule_hash, family, CASE WHEN ok THEN 630 END AS bucket, duplicate_of FROM firsts")
def prj9_prj10_prj11_proposals(spark, d):
    return rules.judge_proposals(proposals(spark, d)).select("attempt", "ok", "reason", "rule_hash", "family", "bucket", "duplicate_of")


@query(f"WITH {_JUDGED} SELECT attempt, 'portfolio_signal' AS family, metric, metric = 'm2' AS uncovered FROM judged WHERE k = 7")
def prj12_join20_feature_reads(spark, d):
    reads = rules.feature_reads(rules.judge_proposals(proposals(spark, d)))
    uncovered = rules.uncovered_reads(reads, spark.range(0).select(F.lit("").alias("family")), _covered(spark)).withColumn("uncovered", F.lit(True))
    return reads.join(uncovered, ["attempt", "family", "metric"], "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(False)))


def _covered(spark):
    return spark.range(2).select(F.lit("portfolio_signal").alias("family"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("metric"))


@query(f"WITH {_JUDGED} SELECT first, second FROM near")
def join18_near_duplicates(spark, d):
    return rules.near_duplicates(rules.judge_proposals(proposals(spark, d)))


@query(f"""WITH {_JUDGED}, r AS (SELECT f.attempt, f.family, CASE WHEN NOT ok THEN 'invalid' WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM near WHERE second = f.attempt) THEN 'near duplicate' WHEN metric = 'm2' THEN 'uncovered feature' END AS refused FROM firsts f),
q AS (SELECT attempt, coalesce(refused, CASE WHEN row_number() OVER (PARTITION BY family, refused IS NULL ORDER BY attempt) > 2 THEN 'family quota' END) AS refused FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY refused IS NULL ORDER BY attempt) AS place FROM q)
SELECT attempt, coalesce(refused, CASE WHEN place > 3 THEN 'budget' ELSE 'admitted' END) AS decision FROM b""")
def ev21_batch_admission(spark, d):
    folder = work_folder(spark, "proposals")  # the admission reads the verdicts eight times, so they are written once
    used = ("attempt", "ok", "duplicate_of", "family", "bucket", "helper", "minutes", "thresholds", "width", "otm_offset", "reads")
    rules.judge_proposals(proposals(spark, d)).select(*used).write.parquet(folder)
    judged = spark.read.parquet(folder)
    uncovered = rules.uncovered_reads(rules.feature_reads(judged), spark.range(0).select(F.lit("").alias("family")), _covered(spark))
    return rules.admit(judged, uncovered, rules.near_duplicates(judged), quota=2, budget=3)
