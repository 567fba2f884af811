"""Queries over the `documents` table for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (
    decision_list, lexical_search, minhash, mixing, poly_dedup, quality_pu, secret_scan, sentencepiece_codec, sharding, simhash_bk, suffix_tree,
    token_alignment, toxicity_knn)
from riskspark.llm.labelled import held_out
from riskspark.llm.oracles import ORACLES

SHARDS = 40
WEIGHTS, SHARE, MOST = [3.0, 1.0, 2.0], 1.5, 2.0


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    tree, vocabulary = suffix_tree.learn(suffix_tree.taught(docs, folds=5, held=1))
    return suffix_tree.score(docs, tree, vocabulary).select(
        "doc_id", held_out(5, 1), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


def op2_interleave(spark: SparkSession, folder: str) -> DataFrame:
    """Stratified interleaving into 40 shards; the law is `rows`. Equal texts need not share a shard."""
    return sharding.interleave(documents(spark, folder), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(documents(spark, folder), model_file())


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality_pu.train(docs, labels(spark, folder), folds=4, held=2)
    return quality_pu.scored(docs, model).select(
        "doc_id", held_out(4, 2), "score", (F.col("score") >= quality_pu.ACCEPT).cast("int").alias("predicted"))


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.edit_fingerprints(documents(spark, folder))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return poly_dedup.exact_groups(documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder))
    return found.select(
        "doc_id", *[secret_scan.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_bk.near_groups(documents(spark, folder), width=3, radius=2).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """`stretches` lists shard:start+words, by shard, then repetition."""
    listed = F.expr("array_join(transform(stretches, s -> concat(s.shard, ':', s.start, '+', s.words)), ',')")
    return mixing.sharded(documents(spark, folder), WEIGHTS, SHARE, MOST).select(
        "doc_id", "size", "source_size", "target", "taken", listed.alias("stretches"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    index = toxicity_knn.train(docs, labels(spark, folder), folds=5, held=0)
    return toxicity_knn.scored(docs, index).select(
        "doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules learned from the labels of all folds but the one of `op4_quality`, so that the same rows measure both."""
    docs = documents(spark, folder)
    rules = decision_list.train(docs, labels(spark, folder), folds=4, held=2)
    return decision_list.judged(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), most=10)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.aligned(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), model_file()).drop(
        "groups")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # it uses this module

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_interleave": op2_interleave,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_minhash": op5_minhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}

__all__ = ["ORACLES", "QUERIES"]
