"""Similar cases, training sets, boosted trees with isotonic calibration, batch scoring."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.functions.numeric import rnd
from riskspark.operators import curves
from riskspark.operators.similarity import similar_by_hash, top_similar
from riskspark.plans import jobs
from riskspark.plans.decisions import vectorized
from riskspark.plans.lake import Lake


#: Folds of the cross-fitted calibration, and steps of its histogram.
FOLDS, BINS = 3, 10_000
#: Rows that a task of a fit has, about; the many short jobs of a fit cost by the task.
FIT_ROWS = 50_000


def category_profiles(store: DataFrame) -> DataFrame:
    """The mean vector of each category: one query per category."""
    return store.groupBy(F.col("category").cast("bigint").alias("query_id")).agg(
        Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))).alias("_mean")).select(
        "query_id", vector_to_array("_mean").alias("vector"))


def similar_cases(lake: Lake, k: int = 5) -> DataFrame:
    """The five stored cases nearest to each category's profile, with their payload."""
    found = top_similar(lake.case_vectors, category_profiles(lake.case_vectors), k)
    payload = lake.case_vectors.select("case_id", "category")
    return payload.join(found, "case_id").select("query_id", "rank", "case_id", "category", "score")


def similar_to_cases(lake: Lake, every: int = 100, k: int = 5, hashed: bool = False) -> DataFrame:
    """The stored cases nearest to a case in hand, by the case's own vector: here those whose id `every` divides, against
    all. A case that is stored finds itself. `hashed` compares a case only with cases of its buckets."""
    asked = lake.case_vectors.where(F.col("case_id") % every == 0).select(F.col("case_id").alias("query_id"), "vector")
    found = (similar_by_hash if hashed else top_similar)(lake.case_vectors, asked, k)
    payload = lake.case_vectors.select("case_id", "category")
    return payload.join(found, "case_id").select("query_id", "rank", "case_id", "category", "score")


def store_cases(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by point id, the MD5 of the case id; a new vector replaces the stored one."""
    point = F.md5(F.col("case_id").cast("string").cast("binary")).alias("point_id")
    rows = stored.select(point, "*", F.lit(0).alias("_new")).unionByName(new.select(point, "*", F.lit(1).alias("_new")))
    columns = [c for c in rows.columns if c not in ("point_id", "_new")]
    return rows.groupBy("point_id").agg(F.max_by(F.struct(*columns), "_new").alias("r")).select("point_id", "r.*")


def case_vector_store(lake: Lake) -> DataFrame:
    """All cases stored, then stored again under a normalised vector: still one point per case."""
    unit = lake.case_vectors.withColumn("_n", F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))))
    normal = unit.withColumn("vector", F.transform("vector", lambda x: (x / F.col("_n")).cast("float"))).drop("_n")
    return store_cases(lake.case_vectors, normal).select("point_id", "case_id", "category",
                                                         F.size("vector").alias("dimensions"))


def held_out(label: Column, key: Column) -> Column:
    """A fifth of each class, chosen by a hash of class and id."""
    text = F.concat(label.cast("int").cast("string"), F.lit(":"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 5 == 0


def training_set(lake: Lake, snapshot_date: str = "2024-02-25", maturity_days: int = 30) -> DataFrame:
    """Feature vectors joined to mature labels: features are as of the event, labels as of the snapshot."""
    none = lake.spark.createDataFrame([], "auth_event_id bigint, snapshot_date date")
    labels = jobs.label_snapshot(lake, snapshot_date, maturity_days, none).select(
        "auth_event_id", F.col("is_fraud_snapshot").alias("is_fraud"))
    return vectorized(lake.feature_events).select("auth_event_id", *C.FEATURES).join(labels, "auth_event_id").withColumn(
        "is_test", held_out(F.col("is_fraud"), F.col("auth_event_id")))


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 9, 8), 16, 10).cast("bigint") % folds


def at_once(vectors: DataFrame, *parts: Callable) -> list:
    """What each part returns, run side by side: the jobs of one fit are too short to keep a cluster busy."""
    target = inheritable_thread_target(vectors.sparkSession)
    with ThreadPool(len(parts)) as pool:
        return pool.map(lambda part: part(), [target(part) for part in parts])


def out_of_fold(estimator: GBTClassifier, vectors: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(label, raw_probability) of every row, under a model that did not see its fold. A fold whose others have one class
    only is left out."""
    # One row per fold.
    classes = {row.fold: set(row.labels) for row in vectors.where(F.col("fold").isNotNull()).groupBy("fold").agg(
        F.collect_set("label").alias("labels")).collect()}
    kept = [k for k in range(folds) if len(set().union(*[own for fold, own in classes.items() if fold != k])) > 1]
    if not kept:
        return vectors.select("label", F.lit(0.5).alias("raw_probability"))
    models = at_once(vectors, *[lambda k=k: estimator.fit(vectors.where(F.col("fold") != k)) for k in kept])
    return reduce(DataFrame.unionByName, [model.transform(vectors.where(F.col("fold") == k)).select(
        "label", vector_to_array("probability")[1].alias("raw_probability")) for k, model in zip(kept, models, strict=True)])


def score_bins(rows: DataFrame) -> DataFrame:
    """(raw_probability, label, n): scores rounded to one in `BINS`, with the share of positives and the number of rows."""
    return rows.groupBy((F.round(F.col("raw_probability") * BINS) / BINS).alias("raw_probability")).agg(
        F.avg("label").alias("label"), F.count("*").cast("double").alias("n"))


def train_boosted(rows: DataFrame, trees: int = 10, depth: int = 4) -> PipelineModel:
    """Class-weighted boosted trees and an isotonic calibration of their raw probability, as one fitted pipeline.

    The calibration is cross-fitted: each third of the rows, by a hash of the event, is scored by trees that were fitted on
    the other two, and violators are pooled on the histogram of these scores, `BINS` + 1 weighted rows at most.

    A fit is hundreds of short jobs over the same rows. They are checkpointed first, so that no task carries the plan that made
    them, and read in as few partitions as `FIT_ROWS` asks for.
    """
    train = rows.where(~F.col("is_test")).select(
        "auth_event_id", *C.FEATURES, F.col("is_fraud").cast("double").alias("label")).checkpoint()
    # One row: the class weight.
    n, positive = train.agg(F.count("*"), F.sum("label")).first()
    weight = (n - positive) / max(positive, 1.0)
    assembled = VectorAssembler(inputCols=C.FEATURES, outputCol="features")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FIT_ROWS))
    vectors = assembled.transform(train.coalesce(tasks)).withColumn(
        "weight", F.when(F.col("label") == 1.0, F.lit(float(weight))).otherwise(F.lit(1.0))).select(
        "features", "label", "weight", fold_of(F.col("auth_event_id")).alias("fold")).persist()
    boosting = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=42, weightCol="weight",
                             predictionCol="predicted")
    booster, bins = at_once(
        vectors, lambda: boosting.fit(vectors), lambda: score_bins(out_of_fold(boosting, vectors)).checkpoint())
    calibration = IsotonicRegression(featuresCol="raw_probability", predictionCol="calibrated", weightCol="n").fit(bins)
    vectors.unpersist()
    return PipelineModel([assembled, booster, calibration])


def score_batch(model: PipelineModel, vectors: DataFrame) -> DataFrame:
    """Raw and calibrated probability of every row under a fitted model."""
    assembled, booster, calibration = model.stages
    raw = booster.transform(assembled.transform(vectors)).withColumn(
        "raw_probability", vector_to_array("probability")[1])
    scored = calibration.transform(raw)
    return scored.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))


def training_report(lake: Lake) -> DataFrame:
    """Hold-out metrics at the review cut and the feature importances of a fitted model."""
    rows = training_set(lake)
    model = train_boosted(rows)
    tested = score_batch(model, rows.where("is_test")).select(
        "is_fraud", F.col("calibrated").alias("probability"), F.lit(0).cast("decimal(18,2)").alias("amount_usd"),
        F.lit("holdout").alias("sample"))
    ordered = curves.scores_in_order(tested, ["sample"])
    metrics = curves.ranking_metrics(ordered, ["sample"]).join(
        curves.confusion(ordered, ["sample"], C.THRESHOLD_DECLINE, C.THRESHOLD_REVIEW), "sample")
    names = ["auc_roc", "auc_pr", "precision", "recall", "f1", "sample_size"]
    pairs = [item for name in names for item in (F.lit(name), F.col(name).cast("double"))]
    importances = lake.spark.createDataFrame(
        [("importance", name, float(value)) for name, value in zip(C.FEATURES, model.stages[1].featureImportances.toArray())],
        "kind string, name string, value double")
    return metrics.select(F.lit("metric").alias("kind"), F.stack(F.lit(len(names)), *pairs).alias(
        "name", "value")).unionByName(importances)


def scored_batch(lake: Lake) -> DataFrame:
    model = train_boosted(training_set(lake))
    return score_batch(model, vectorized(lake.feature_events)).select(
        "auth_event_id", rnd(F.col("raw_probability"), 6).alias("raw_probability"),
        rnd(F.col("calibrated"), 6).alias("calibrated_probability"))
