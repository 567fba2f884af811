"""The corpus pipeline: from raw documents to encoded ones, each stage one operator over all that the stage before kept.

1. quality: documents that the classifier rejects go (score below 0.7; a document without words scores 0 and goes).
2. exact_dedup: of equal texts, white space aside, the row with the smallest doc_id stays.
3. near_dedup: one row of each group of near duplicates stays, the one with the smallest doc_id. SimHash links are those of
   `op8_simhash`. A 64-bit fingerprint can't see a similarity of 0.8 on five-word shingles (such pairs differ in about ten
   bits, where shards no longer separate), so links of verified MinHash candidates at that similarity are added.
4. mixing: documents are repeated or dropped until the sources meet their target weights.
5. encoding: SentencePiece ids of every row, as digests, decoded and compared.

Stages that filter return the columns of the documents as they got them. Null texts count as empty throughout; a row
without doc_id is kept by deduplication unless an equal text stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import minhash, mixing, poly_dedup, quality_pu, sentencepiece_codec, simhash_bk
from riskspark.llm.queries import MOST, SHARE, WEIGHTS, labels, model_file
from riskspark.session import checkpoint_dir

#: SQL can express neither the classifier nor the fingerprints; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_pu.train(docs, labels(spark, sf_dir), folds=4, held=2)
    return quality_pu.accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poly_dedup.first_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    members, pairs = minhash.near_pairs(docs)
    more = pairs.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")).unionByName(
        members.where("doc_id <> class_id").select(F.col("class_id").alias("src"), F.col("doc_id").alias("dst")))
    return simhash_bk.first_rows(docs, width=3, radius=2, more=more)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(docs, WEIGHTS, SHARE, MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(docs, model_file())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix),
          ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each writes a table below the shared folder that the next one reads."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
