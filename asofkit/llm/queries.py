"""The registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm.alignment import pair_scores
from asofkit.llm.common import held_out, read_table
from asofkit.llm.decontamination import contamination_digest
from asofkit.llm.fingerprints import compare_with_next
from asofkit.llm.jaccard import link_documents
from asofkit.llm.lm_scoring import score_texts
from asofkit.llm.mixing import mix_sources
from asofkit.llm.quality_rules import clean_lines, quality_sql
from asofkit.llm.secrets import secret_digest
from asofkit.llm.sharding import shard_rows
from asofkit.llm.token_counts import document_token_counts
from asofkit.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity
from asofkit.llm.warc import build_derivatives, page_responses
from asofkit.llm.whitening import whiten


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, learn_from=lambda doc_id: ~held_out(doc_id, 4, 2))
    scored = score_toxicity(docs, model, locate=THRESHOLD)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents"), shingle=3, threshold=0.9)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents")).drop("row_number")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = build_derivatives(page_responses(read_table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")
    return made.withColumns({"record_length": F.octet_length("record"), "record_sha256": F.sha2("record", 256)}).drop("record")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(read_table(spark, sf_dir, "documents"), keep_text=False)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_scores(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_toxicity, op3_lm_scoring, op4_jaccard_join, op5_token_counts, op6_sharding, op7_fingerprints,
        op8_warc_derivatives, op9_secret_scan, op10_decontamination, op11_embedding_whitening, op12_quality_rules, op13_token_alignment, pipeline,
    )
}

#: Queries that SQL can express.
ORACLES: dict[str, str] = {"op12_quality_rules": quality_sql()}
