"""Moving quantiles from sketches against sorted values: exact while nothing is thrown away, within the stated error beyond."""

import bisect
import math
import random

from pyspark.sql import functions as F

from riskspark.operators import sketches


def brute(rows, slices, point):
    """{(key, slice): (rows, n, quantile)} over the whole slices before each slice."""
    out = {}
    for key, day in {(k, t // 10) for k, t, _ in rows}:
        held = sorted(v for k, t, v in rows if k == key and day - slices <= t // 10 < day and v is not None)
        here = sum(k == key and t // 10 == day for k, t, _ in rows)
        out[key, day] = here, len(held), held[max(math.ceil(point * len(held)), 1) - 1] if held else None
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, v double")


def test_few_values_are_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(300), rng.choice([None, 1.0, 2.0, rng.random()])) for _ in range(400)]
    rows += [("late", 5, 3.0), ("late", 295, None), ("late", 299, 7.0), ("bare", 1, None), ("bare", 20, 1.0)] + rows[:20]
    parts = sketches.slice_sketches(frame(spark, rows), ["k"], "t", "v", 10)
    found = sketches.moving_quantiles(parts, ["k"], 7, {"half": 0.5, "most": 0.95}).collect()
    for point, name in ((0.5, "half"), (0.95, "most")):
        assert {(r.k, r.slice): (r.rows, r.n, r[name]) for r in found} == brute(rows, 7, point)
    assert len(found) == len({(k, t // 10) for k, t, _ in rows})


def test_nothing_and_missing_times(spark):
    none = frame(spark, [])
    assert sketches.moving_quantiles(sketches.slice_sketches(none, ["k"], "t", "v", 10), ["k"], 3, {"q": 0.5}).count() == 0
    untimed = sketches.slice_sketches(frame(spark, [("a", None, 1.0)]), ["k"], "t", "v", 10)
    assert untimed.count() == 0


def test_stored_parts_merge(spark, tmp_path):
    """Slices stored by day and in parts answer as if they had been built at once."""
    rows = [("a", t, float(t * 37 % 101)) for t in range(60)] + [("b", t, 1.0) for t in range(0, 60, 7)]
    path = str(tmp_path / "sketches")
    for part in (rows[:20], rows[20:45], rows[45:]):
        sketches.slice_sketches(frame(spark, part), ["k"], "t", "v", 10).write.mode("append").parquet(path)
    stored = sketches.merged(spark.read.parquet(path), ["k", "slice"])
    found = sketches.moving_quantiles(stored, ["k"], 4, {"q": 0.9}).collect()
    assert {(r.k, r.slice): (r.rows, r.n, r.q) for r in found} == brute(rows, 4, 0.9)


def test_rank_error_of_a_hot_key(spark):
    """A hundred thousand values of one key, sixty merged sketches: ranks within twice the stated error."""
    rows = spark.range(100_000).select(
        F.lit("hot").alias("k"), (F.col("id") % 600).alias("t"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    every = sorted(r.v for r in rows.where("t < 590").collect())
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    last = sketches.moving_quantiles(
        sketches.slice_sketches(rows, ["k"], "t", "v", 10), ["k"], 90, points).where("slice = 59").first()
    assert last.n == len(every)
    for name, point in points.items():
        rank = bisect.bisect_right(every, last[name]) / len(every)
        assert abs(rank - point) <= 2 * 2.3 / sketches.K ** 0.97
