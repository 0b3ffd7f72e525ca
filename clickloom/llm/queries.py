"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import chat, cross_polytope, decontaminate, language_id, language_model, mixing, ngram_join, periodic_runs, secret_scan, suffix_dedup, token_alignment, toxicity, warc
from clickloom.session import scratch_path


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    found = ngram_join.near_duplicates(_table(spark, sf, "documents"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).drop("copies")


def op4_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.scores(_table(spark, sf, "documents"))


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive(_table(spark, sf, "pages"), scratch_path(spark, "warc"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    extra = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    extra = spark.createDataFrame(extra, "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.formatted_digests(chat.records(rows.union(extra)))


def op9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return cross_polytope.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(_table(spark, sf, "documents"))


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.align_tokens(_table(spark, sf, "documents"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periodic_runs.repeat_tails(_table(spark, sf, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op13_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.secrets(_table(spark, sf, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard, op2_decontaminate, op3_mixing, op4_lm_scores, op5_warc, op6_toxicity, op7_suffix_dedup, op8_chat_format, op9_nearest, op10_language_id,
             op11_token_alignment, op12_periodic_runs, op13_secrets]
    return {f.__name__: f for f in found}
