"""Components that grow by increments, and calibration on rows that the model has not seen."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.operators import graph
from riskspark.plans import ml


def plain(nodes, links):
    home = {n: n for n in nodes}
    for a, b in links:
        old, new = max(home[a], home[b]), min(home[a], home[b])
        home = {n: new if h == old else h for n, h in home.items()}
    return set(home.items())


def test_ten_increments_equal_a_full_run(spark, tmp_path):
    rng = random.Random(31)
    path = str(tmp_path / "components")
    made = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    named = lambda rows: spark.createDataFrame([(n,) for n in rows], "node string")
    every, nodes = [("n1", "n2"), ("n3", "n4")], {f"n{i}" for i in range(1, 9)}
    graph.store_components(path, named(nodes), made(every))
    for step in range(10):
        width = 20 * (step + 1)
        new = [(f"n{rng.randrange(width)}", f"n{rng.randrange(width)}") for _ in range(6)]
        new += [("hub", f"n{rng.randrange(width)}") for _ in range(3 if step % 3 == 0 else 0)] + new[:1]
        alone = {f"lone{step}"}
        every, nodes = every + new, nodes | alone | {n for e in new for n in e}
        graph.grow_components(path, named(alone), made(new))
        rows = [tuple(r) for r in graph.stored_components(spark, path).collect()]
        full = plain(nodes, every)
        assert set(rows) == full and len(rows) == len(full)
    touched = graph.grow_components(path, named({"n1"}), made(every[-4:]))
    assert touched == [] and {tuple(r) for r in graph.stored_components(spark, path).collect()} == full


def test_an_increment_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "components")
    nodes = spark.range(400).select(F.concat(F.lit("n"), F.col("id")).alias("node"))
    graph.store_components(path, nodes, spark.createDataFrame([("n1", "n2")], "src string, dst string"))
    before = set(spark.read.parquet(path).inputFiles())
    touched = graph.grow_components(path, nodes.limit(0), spark.createDataFrame([("n7", "n8")], "src string, dst string"))
    kept = before & set(spark.read.parquet(path).inputFiles())
    assert 1 <= len(touched) <= 2 and len(kept) >= len(before) - 2


def test_calibration_is_cross_fitted(spark):
    """No row is scored by trees that saw it, and bins pool to a rising curve near the true rate."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rng = random.Random(7)
    rows = []
    for i in range(600):
        x = rng.random()
        rows.append((i, x, float(rng.random() < x)))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(rows, "id long, x double, label double")).withColumn("fold", ml.fold_of(F.col("id"))).cache()
    assert {r.fold for r in vectors.select("fold").distinct().collect()} == {0, 1, 2}
    scored = ml.out_of_fold(GBTClassifier(maxIter=3, maxDepth=3, seed=1), vectors)
    assert scored.count() == 600
    bins = ml.score_bins(scored)
    assert bins.agg(F.sum("n")).first()[0] == 600
    fitted = IsotonicRegression(featuresCol="raw_probability", weightCol="n").fit(bins)
    curve = list(fitted.predictions)
    assert curve == sorted(curve)
    share = bins.agg((F.sum(F.col("label") * F.col("n")) / F.sum("n"))).first()[0]
    calibrated = fitted.transform(scored).agg(F.avg("prediction")).first()[0]
    assert calibrated == pytest.approx(share, abs=0.02)
    one_class = vectors.withColumn("label", F.lit(1.0))
    assert ml.out_of_fold(GBTClassifier(maxIter=2), one_class).select("raw_probability").distinct().count() == 1


def test_a_fit_does_not_pay_for_the_partitions_of_its_rows(spark):
    """Rows in 90 partitions give the model that they give in two, and the jobs of the fits don't run over all 90."""
    from riskspark import constants as C

    rng = random.Random(5)
    rows = []
    for i in range(900):
        x = [rng.random() for _ in C.FEATURES]
        rows.append((i, *x, rng.random() < x[0], i % 5 == 0))
    frame = spark.createDataFrame(rows, ", ".join(
        ["auth_event_id long", *[f"{c} double" for c in C.FEATURES], "is_fraud boolean", "is_test boolean"]))
    context = spark.sparkContext

    def fitted(parts: int):
        context.setJobGroup(f"fit-{parts}", "")
        model = ml.train_boosted(frame.repartition(parts, "auth_event_id"), trees=3, depth=2)
        context.setLocalProperty("spark.jobGroup.id", None)
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(f"fit-{parts}") for s in tracker.getJobInfo(j).stageIds}
        return model, [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]

    (few, _), (many, tasks) = fitted(2), fitted(90)
    assert sum(n >= 90 for n in tasks) <= 4 and len(tasks) > 20
    score = lambda model: [r.calibrated for r in ml.score_batch(model, frame).orderBy("auth_event_id").collect()]
    assert score(many) == pytest.approx(score(few), abs=1e-9)
