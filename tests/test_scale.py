"""The ways taken for hot keys, hubs and ties give the same results as brute force."""

import random
import re

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from compare import difference
from oracles.base import sql
from riskspark.operators import curves, graph, quantiles, ranges, similarity
from riskspark.plans.features import event_features


@pytest.fixture(scope="module")
def timeline(spark):
    draw = random.Random(3)
    rows = [("hot", draw.randrange(0, 4000) * 1_000_000, draw.randrange(1, 90)) for _ in range(400)]
    rows += [("cold", draw.randrange(0, 4000) * 1_000_000, draw.randrange(1, 90)) for _ in range(30)]
    rows += [("hot", 5_000_000, 7)] * 25
    return rows, spark.createDataFrame(rows, "entity string, t long, value long"), \
        spark.createDataFrame([("hot",)], "entity string")


def test_hot_keys(timeline):
    _, df, _ = timeline
    assert [r.entity for r in ranges.hot_keys(df, "entity", 100).collect()] == ["hot"]
    assert ranges.hot_keys(df, "entity", 1000) is None


def test_range_totals_of_hot_keys(timeline):
    rows, df, hot = timeline
    span = 600_000_000
    changes = ranges.expiring(df, F.col("t") + span + 1, {"n": F.lit(1)}, ["entity"])
    live = ranges.running_totals(changes, ["entity"], ["n"], width=100_000_000, hot=hot)
    got = {(r.entity, r.t): r.n for r in live.collect()}
    for key, t, _ in rows:
        assert got[key, t] == sum(1 for k, u, _ in rows if k == key and t - span <= u <= t)


@pytest.mark.parametrize("use_hot", [False, True])
def test_distinct_members(timeline, use_hot):
    rows, df, hot = timeline
    span = 300_000_000
    pairs = df.select("entity", (F.col("value") % 7).alias("member"), "t")
    changes = ranges.live_members(pairs, ["entity"], "member", span, "n", hot if use_hot else None)
    asked = df.select("entity", "t", F.lit(0).cast("bigint").alias("n"))
    got = {(r.entity, r.t): r.n for r in ranges.running_totals(
        changes.unionByName(asked), ["entity"], ["n"], width=100_000_000, hot=hot if use_hot else None).collect()}
    for key, t, _ in rows:
        assert got[key, t] == len({v % 7 for k, u, v in rows if k == key and t - span <= u <= t})


@pytest.mark.parametrize("use_hot", [False, True])
def test_range_quantile(timeline, use_hot):
    import numpy as np

    rows, df, hot = timeline
    span = 500_000_000
    got = {(r.entity, r.t): r.quantile for r in ranges.range_quantile(
        df, "entity", span, 0.95, hot if use_hot else None).collect()}
    assert len(got) == len({(k, t) for k, t, _ in rows})
    for key, t, _ in rows:
        want = np.quantile([v for k, u, v in rows if k == key and t - span <= u <= t], 0.95)
        assert got[key, t] == pytest.approx(want)


def test_rolling_quantile_across_batches(spark, timeline):
    """Timelines longer than an Arrow batch, with peers on the border."""
    rows, df, _ = timeline
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = {(r.entity, r.t): r.quantile for r in ranges.range_quantile(df, "entity", 10**9, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {(r.entity, r.t): r.quantile for r in ranges.range_quantile(df, "entity", 10**9, 0.5).collect()}
    assert small == pytest.approx(whole)


@pytest.mark.parametrize("use_hot", [False, True])
def test_previous_rows(timeline, spark, use_hot):
    rows, _, hot = timeline
    listed = [(k, t, i, None if v % 3 == 0 else f"ip{v}") for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(listed, "entity string, t long, id long, ip string")
    got = {r.id: (r.prev_t, r.prev_ip) for r in ranges.with_previous(
        df, "entity", "t", "id", {"ip": "prev_ip"}, 200_000_000, hot if use_hot else None).collect()}
    for k, t, i, _ in listed:
        earlier = sorted((u, j, ip) for kk, u, j, ip in listed if kk == k and (u, j) < (t, i))
        known = [ip for _, _, ip in earlier if ip]
        assert got[i] == (earlier[-1][0] if earlier else None, known[-1] if known else None)


def test_all_features_with_every_entity_hot(lake, database):
    features = event_features(lake.auth_events, lake.chargebacks, lake.customers, lake.devices, lake.ips,
                              lake.gazetteer, hot_rows=30)
    assert difference(features, database, sql("SELECT * FROM features")) is None


def _graph(spark):
    draw = random.Random(5)
    edges = {(f"a{i}", "hub") for i in range(0, 60)} | {(f"a{i}", "hub2") for i in range(40, 80)}
    edges |= {(f"a{draw.randrange(90)}", f"d{draw.randrange(30)}") for _ in range(70)} | {("hub", "hub2"), ("d1", "hub")}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(40)}
    nodes = sorted({n for e in edges for n in e} | {"lonely"})
    return edges, nodes, spark.createDataFrame(list(edges), "src string, dst string"), \
        spark.createDataFrame([(n, 1, i % 5) for i, n in enumerate(nodes)], "node string, n int, w int")


@pytest.mark.parametrize("hub_degree", [0, 3, 10, 10_000, None])
def test_two_hops_with_hubs(spark, hub_degree):
    edges, nodes, edge_df, weights = _graph(spark)
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    value = {r.node: r.w for r in weights.collect()}
    got = {r.root: (r.n, r.w) for r in graph.two_hop_totals(
        graph.undirected(edge_df), weights, weights.select(F.col("node").alias("root")), hub_degree).collect()}
    for n in nodes:
        reach = (near[n] | {m for x in near[n] for m in near[x]}) - {n}
        assert got[n] == (len(reach), sum(value[m] for m in reach))


@pytest.mark.parametrize("hub_degree", [0, 20, None])
def test_two_hops_of_star_clique_and_chain(spark, hub_degree):
    """A star of 400 leaves, a clique of 60, and a chain from the star to a node beyond the clique."""
    edges = [("hub", f"l{i}") for i in range(400)] + [(f"k{i}", f"k{j}") for i in range(60) for j in range(i)]
    edges += [("l0", "m1"), ("m1", "m2"), ("m2", "k0"), ("k59", "end")]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    value = {n: i % 7 + 1 for i, n in enumerate(sorted(near))}
    weights = spark.createDataFrame([(n, 1, w) for n, w in value.items()], "node string, n long, w long")
    pairs = graph.undirected(spark.createDataFrame(edges, "src string, dst string"))
    got = {r.root: (r.n, r.w) for r in graph.two_hop_totals(
        pairs, weights, weights.select(F.col("node").alias("root")), hub_degree).collect()}
    for n in near:
        reach = (near[n] | {m for x in near[n] for m in near[x]}) - {n}
        assert got[n] == (len(reach), sum(value[m] for m in reach)), n


def test_hub_sets_stay_few(spark):
    """All members of a clique have one set of hubs, so sets that share a hub are as few as there are kinds of nodes."""
    members = spark.createDataFrame([("a", f"h{i}") for i in range(50)] + [("b", "h0"), ("c", "h99")], "set string, member string")
    got = sorted(map(tuple, graph.shared_sets(members, block=1).collect()))
    assert got == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]


def test_light_degree_bounds_the_paths(spark):
    rng = random.Random(5)
    for degrees in ([1] * 500 + [100, 400], [rng.randint(1, 3000) for _ in range(300)], [40] * 41, []):
        rows = spark.createDataFrame([(d,) for d in degrees], "degree long")
        (bound,) = graph.light_degree(rows, paths_per_edge=16).first()
        assert sum(d * d for d in degrees if d <= bound) <= 16 * sum(degrees)


def test_components(spark):
    edges, nodes, edge_df, weights = _graph(spark)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    smallest = {}
    for n in nodes:
        smallest[find(n)] = min(smallest.get(find(n), n), n)
    got = {r.node: r.component for r in graph.components(weights.select("node"), edge_df).collect()}
    assert got == {n: smallest[find(n)] for n in nodes}


def test_expand(spark):
    _, _, edge_df, _ = _graph(spark)
    roots = spark.createDataFrame([("c0",), ("lonely",)], "root string")
    got = {(r.node, r.hop) for r in graph.expand(graph.undirected(edge_df), roots, 3).collect()}
    assert got == {("c1", 1), ("c2", 2), ("c3", 3)}


def test_ring_patterns(spark):
    """Six nodes in one component; four accounts on two devices look synthetic and, with two shared devices, mule-like."""
    from riskspark.plans.graph import mule, node_weights, synthetic

    edges = [(f"account:{i}", f"device:{d}") for i in range(4) for d in "AB"]
    nodes = spark.createDataFrame(
        [(n, n.split(":")[0], 0.0) for n in sorted({n for e in edges for n in e})], "node string, node_type string, risk double")
    pairs = graph.undirected(spark.createDataFrame(edges, "src string, dst string"))
    totals = node_weights(nodes, pairs).agg(*[F.sum(c).alias(c) for c in ("n_accounts", "n_devices", "n_emails", "n_mules")])
    row = totals.select(synthetic(F.col("n_accounts"), F.col("n_devices"), F.col("n_emails")).alias("s"),
                        mule(F.col("n_accounts"), F.col("n_mules")).alias("m")).first()
    assert (row.s, row.m) == (True, True)
    one = graph.undirected(spark.createDataFrame([(f"account:{i}", "device:A") for i in range(5)], "src string, dst string"))
    assert node_weights(nodes, one).agg(F.sum("n_mules")).first()[0] == 0


def test_top_share_with_one_hot_score(spark):
    draw = random.Random(11)
    rows = [(i, 0.5 if draw.random() < .6 else draw.randrange(1000) / 1000, draw.randrange(1, 900), draw.choice([True, False, None]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "auth_event_id long, probability double, a int, is_fraud boolean").withColumn(
        "amount_usd", F.col("a").cast("decimal(18,2)"))
    got = {r.step: (r.n, r.fraud_usd, r.n_legit) for r in curves.top_share_totals(df, [d / 10 for d in range(1, 11)]).collect()}
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    for d in range(1, 11):
        top = ranked[: int(len(rows) * (d / 10))]
        assert got[d] == (len(top), sum(r[2] for r in top if r[3]), sum(1 for r in top if r[3] is False))


def test_quantiles(spark):
    import numpy as np

    draw = random.Random(2)
    rows = [(draw.choice("ab"), round(draw.lognormvariate(2, 1), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in quantiles.quantiles(df, F.col("v"), {"p50": .5, "p95": .95}, ["g"]).collect()}
    for g in "ab":
        values = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx((np.quantile(values, .5), np.quantile(values, .95)))


def test_auc_of_a_perfect_classifier(spark):
    rows = [("m", 0.1, 100.0, False)] * 100 + [("m", 0.9, 100.0, True)] * 100
    ordered = curves.scores_in_order(spark.createDataFrame(
        rows, "model string, probability double, amount_usd double, is_fraud boolean"), ["model"])
    found = curves.ranking_metrics(ordered, ["model"]).first()
    assert (found.auc_roc, found.auc_pr) == (1.0, 1.0)
    rates = curves.confusion(ordered, ["model"], .85, .55).first()
    assert (rates.recall, rates.prevented_loss, rates.expected_loss) == (1.0, 10000.0, 10000.0)


def test_similarity_in_blocks(spark):
    """Any number of blocks gives the same rows, ties by id included."""
    import numpy as np

    draw = np.random.default_rng(1)
    store, asked = draw.integers(-2, 3, size=(200, 4)).astype(float), draw.integers(-2, 3, size=(9, 4)).astype(float)
    store[7] = 0
    left = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(store)], "case_id long, vector array<double>")
    right = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    cosine = np.round(unit(asked) @ unit(store).T, 6)
    for blocks in ((1000, 1000), (16, 4), (1, 2)):
        got = {(r.query_id, r["rank"]): r.case_id for r in similarity.top_similar(left, right, 3, *blocks).collect()}
        assert got == {(q, i + 1): c for q in range(9) for i, c in enumerate(
            np.lexsort((np.arange(200), -cosine[q]))[:3].tolist())}
    plan = similarity.top_similar(left, right, 3, 16, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    for f in (similarity.top_similar, similarity.similar_by_hash):
        assert f(left.limit(0), right, 3).count() == f(left, right.limit(0), 3).count() == 0


def test_recall_of_hashed_similarity(spark):
    """At least 0.9 of the exact neighbours, on the stored vectors and on clustered ones; large buckets are cut."""
    import numpy as np

    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 32))
    made = centres[draw.integers(0, 40, 6000)] + 0.6 * draw.normal(size=(6000, 32))
    clustered = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "case_id long, vector array<double>")
    from riskspark.plans.lake import Lake

    for vectors, block in ((clustered, 100), (Lake.of(spark, "/root/testdata/sf0.1").case_vectors, 32_768)):
        asked = vectors.where(F.col("case_id") % 50 == 0).select(F.col("case_id").alias("query_id"), "vector")
        exact = {(r.query_id, r.case_id) for r in similarity.top_similar(vectors, asked, 5).collect()}
        found = similarity.similar_by_hash(vectors, asked, 5, bucket_rows=200, block=block).collect()
        assert len({(r.query_id, r.case_id) for r in found}) == len(found)
        recall = len(exact & {(r.query_id, r.case_id) for r in found}) / len(exact)
        print(len(exact), recall)
        assert recall >= 0.9


def test_top_share_with_repeated_ids(spark):
    """Each id twice: every step is filled, with as many rows as it asks for."""
    rows = [(i // 2, 0.5, Decimal(i), i % 3 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "auth_event_id long, probability double, amount_usd decimal(18,2), is_fraud boolean")
    got = curves.top_share_totals(df, [k / 20 for k in range(1, 21)]).orderBy("step").collect()
    ordered = sorted(rows, key=lambda r: (r[0], -(r[2] if r[3] else 0), r[3]))
    for k, r in enumerate(got, 1):
        assert (r.n, r.fraud_usd, r.n_legit) == (
            k, float(sum(x[2] for x in ordered[:k] if x[3])), sum(not x[3] for x in ordered[:k]))


def test_thresholds_compare_unrounded_scores(spark):
    df = spark.createDataFrame([(0.5499996, Decimal(1), True), (0.55, Decimal(2), False), (None, Decimal(3), True)],
                               "probability double, amount_usd decimal(18,2), is_fraud boolean")
    (row,) = curves.threshold_totals(df, [0.55]).collect()
    assert (row.tp, row.fp, row.fn, row.tn) == (0, 1, 1, 0)


def test_queue_summary_totals_every_status(spark):
    from riskspark.plans.dashboard import queue_summary

    states = ["open", "resolved_fraud", "resolved_not_fraud", "escalated", None, "closed"]
    (row,) = queue_summary(spark.createDataFrame([("q", s) for s in states], "queue_name string, case_status string")).collect()
    assert (row.open, row.in_progress, row.closed, row.other, row.total) == (1, 0, 1, 4, 6)


def test_quantiles_of_very_small_and_very_large_values(spark):
    df = spark.createDataFrame([("s", 1.23e-8), ("s", 2.5e-8), ("l", 1e15), ("l", 3e15), ("l", -4e20)], "g string, v double")
    got = {r.g: r.m for r in quantiles.quantiles(df, F.col("v"), {"m": 0.5}, ["g"]).collect()}
    assert got == {"s": pytest.approx(1.865e-8), "l": 1e15}


def test_a_job_that_is_repeated_adds_nothing(lake, tmp_path):
    from riskspark.plans import jobs

    first = {r.job: r.rows_written for r in jobs.daily(lake, "2024-02-03", str(tmp_path)).collect()}
    assert first["backfill"] > 0 and first["drift"] == 19 and first["shadow"] == 1
    assert {r.rows_written for r in jobs.daily(lake, "2024-02-03", str(tmp_path)).collect()} == {0}


def test_running_positions_by_brute_force(spark):
    from riskspark.operators import ranks

    draw = random.Random(17)
    rows = list({(draw.choice(["a", "b", None, ""]), draw.choice([0.5, draw.random()]), k % 7): draw.randrange(9)
                 for k in range(600)}.items())
    df = spark.createDataFrame([(*k, v) for k, v in rows], "g string, p double, i int, n long").repartition(5)
    for groups, part in ((["g"], df), ([], df.where("g = 'a'"))):
        out = ranks.running(part, groups, ["p", "i"], ["n"])
        assert out.count() == part.count()
        for r in out.collect():
            same = [(k, v) for k, v in rows if k[0] == r.g]
            assert (r.n_before, r.n_total) == (sum(v for k, v in same if k[1:] < (r.p, r.i)), sum(v for _, v in same))
    assert ranks.running(df.limit(0), ["g"], ["p"], ["n"]).count() == 0


def test_scores_closer_than_six_decimals_are_ranked(spark):
    """AUC, average precision, confusion and top shares on raw doubles, 1e-7 apart, with ties, against brute force."""
    draw = random.Random(23)
    rows = [(i, 0.55 + draw.randrange(-40, 40) * 1e-7, Decimal(draw.randrange(1, 500)), draw.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "auth_event_id long, probability double, amount_usd decimal(18,2), is_fraud boolean").withColumn(
        "model", F.lit("m"))
    ordered = curves.scores_in_order(df, ["model"])
    bad, good = [r[1] for r in rows if r[3]], [r[1] for r in rows if not r[3]]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    precision = sum(sum(b >= x for b in bad) / sum(r[1] >= x for r in rows) for x in bad) / len(bad)
    found = curves.ranking_metrics(ordered, ["model"]).first()
    assert (found.auc_roc, found.auc_pr) == (pytest.approx(auc, abs=1e-6), pytest.approx(precision, abs=1e-6))
    rates = curves.confusion(ordered, ["model"], .85, .55).first()
    assert rates.recall == pytest.approx(sum(b >= .55 for b in bad) / len(bad), abs=1e-6)
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    for r in curves.top_share_totals(df, [0.1, 0.37, 1.0]).collect():
        top = ranked[:int(400 * [0.1, 0.37, 1.0][r.step - 1])]
        assert (r.n, r.fraud_usd, r.n_legit) == (len(top), sum(x[2] for x in top if x[3]), sum(not x[3] for x in top))
    (few,) = curves.top_share_totals(df.limit(0), [0.5]).collect()
    assert (few.n, few.fraud_usd, few.n_legit) == (0, 0, 0)


def test_ks_by_brute_force(spark):
    from riskspark.operators.drift import ks_statistic

    draw = random.Random(29)
    rows = [(0.5 + draw.randrange(50) * 1e-8, draw.random() < 0.4) for _ in range(300)] + [(0.5 + 2e-7, True)] * 30
    df = spark.createDataFrame(rows, "v double, s boolean")
    a, b = [v for v, s in rows if s], [v for v, s in rows if not s]
    gap = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v, _ in rows)
    (row,) = ks_statistic(df, F.col("v"), F.col("s")).collect()
    assert (row.ks, row.n_a, row.n_b) == (pytest.approx(gap, abs=1e-6), len(a), len(b))


def test_buckets_of_a_tree(spark):
    cuts = sorted({random.Random(1).random() for _ in range(91)})
    values = [0.0, 1.0, *cuts, *[c - 1e-12 for c in cuts], *[c + 1e-12 for c in cuts]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.b for r in df.select("v", curves.bucket_of(F.col("v"), cuts).alias("b")).collect()}
    assert got == {v: sum(c <= v for c in cuts) for v in values}


def test_decisions_use_unrounded_scores(spark):
    """0.5499996 rounds to 0.55, but stays below the cut in everything that decides."""
    from riskspark.plans import evaluation

    df = spark.createDataFrame([(1, "t", 0.3499997, 0.35), (2, "t", 0.36, 0.36)],
                               "auth_event_id long, event_type string, raw_probability double, calibrated_probability double")
    assert evaluation.detection_rate(df).first().caught == 1
    both = spark.createDataFrame([(1, "a", 0.5499996, 0.55), (1, "b", 0.56, 0.56)],
                                 "auth_event_id long, model_version string, raw_probability double, calibrated_probability double")
    row = evaluation.shadow_experiment(both, "a", "b").first()
    assert (row.champion_decline_pct, row.challenger_decline_pct, row.agreement_pct, row.champion_avg_score) == (0, 100, 0, 0.55)


def test_shuffles_start_with_many_partitions(lake):
    """However few partitions the session names, sorts get small ones; adaptive execution joins those that are tiny."""
    spark = lake.spark
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    least = 32 * spark.sparkContext.defaultParallelism
    assert int(re.search(r"hashpartitioning\(.*?, (\d+)\)", plan)[1]) >= least
    assert counted.rdd.getNumPartitions() < least
