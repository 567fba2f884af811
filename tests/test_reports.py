"""Invariants of the economics, evaluation and merge jobs on literal or whole tables."""

import pytest
from pyspark.sql import functions as F

from riskspark.operators.merge import latest, merge_snapshot
from riskspark.plans import dashboard, economics, evaluation, ml, replay
from riskspark.plans.scoring_views import cases


def test_prevented_and_missed_make_the_fraud_volume(lake):
    row = economics.summary(lake).first()
    assert row.prevented_fraud_usd + row.missed_fraud_usd == pytest.approx(row.fraud_volume_usd)


def test_summary_filters(lake):
    row = economics.summary(lake, "2024-01-10 00:00:00", "2024-01-20 00:00:00", "US").first()
    rows = lake.auth_events.where("event_time >= '2024-01-10' and event_time < '2024-01-20' and merchant_country_code = 'US'")
    assert row.total_transactions == rows.count()
    empty = economics.summary(lake, "2030-01-01 00:00:00").first()
    assert empty.total_transactions == 0 and empty.total_volume_usd == 0 and empty.approval_rate == 0


def test_approval_grows_with_the_threshold(lake):
    rows = economics.optimize_threshold(lake.scored_lines).orderBy("threshold").collect()
    assert len(rows) == 91 and sum(r.is_optimal for r in rows) == 1
    assert all(a.approval_rate <= b.approval_rate for a, b in zip(rows, rows[1:]))


def test_there_are_593_triples_in_order():
    triples = economics.threshold_triples()
    assert len(triples) == 593 and all(s < r for _, r, s in triples)


def _results(spark, champion, challenger):
    names = ["auc_roc", "auc_pr", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate"]
    return spark.createDataFrame([("a", *champion), ("b", *challenger)],
                                 "model_version string, " + ", ".join(f"{n} double" for n in names))


def test_compare_and_regression(spark):
    better = _results(spark, (.8, .6, .7, .7, .7, .05, .3), (.9, .7, .8, .8, .8, .04, .2))
    assert evaluation.eval_compare(better, "a", "b").first().recommendation == "promote"
    assert not evaluation.eval_regression(better, "a", "b").where("regressed").count()
    worse = _results(spark, (.9, .7, .8, .8, .8, .04, .2), (.8, .7, .8, .8, .8, .04, .2))
    assert evaluation.eval_compare(worse, "a", "b").first().recommendation == "hold"
    assert [r.metric for r in evaluation.eval_regression(worse, "a", "b").where("regressed").collect()] == ["auc_roc"]


def test_merge_inserts_and_updates(spark):
    old = spark.createDataFrame([(1, "US", "pending"), (2, "DE", "pending")], "id long, country string, kyc string")
    new = spark.createDataFrame([(2, "FR", "verified"), (3, "GB", "pending")], "id long, country string, kyc string")
    got = {tuple(r) for r in merge_snapshot(old, new, "id", ["kyc"], {}).collect()}
    assert got == {(1, "US", "pending"), (2, "DE", "verified"), (3, "GB", "pending")}


def test_latest_and_first(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "key string, t int, v string")
    assert latest(rows, ["key"], ["t"], ["v"]).first().v == "c"
    assert latest(rows, ["key"], ["t"], ["v"], first=True).first().v == "a"


def test_queue_pages_follow_each_other(lake):
    rows = cases(lake.scored_events)
    one = dashboard.case_queue(rows, limit=7).collect()
    last = one[-1]
    two = dashboard.case_queue(rows, limit=7, after=(last["rank"], str(last.created_at), last.case_id)).collect()
    both = dashboard.case_queue(rows, limit=14).collect()
    assert [r.case_id for r in one + two] == [r.case_id for r in both]


def test_search_filters_and_total(lake):
    page = dashboard.search(lake.scored_events, limit=3, customer_id=5, max_amount=1e6, end="2024-02-01 00:00:00").collect()
    assert page[0].total == lake.scored_events.where("customer_id = 5").count() and len(page) == 3
    with pytest.raises(ValueError):
        dashboard.search(lake.scored_events, nonsense=1)


@pytest.mark.parametrize("decision,fraud,correct", [
    ("approve", True, False), ("hard_decline", True, True), ("manual_review", False, False), ("step_up", False, True),
    (None, True, None), ("approve", None, None)])
def test_decision_correct(spark, decision, fraud, correct):
    row = spark.createDataFrame([(decision, fraud)], "d string, f boolean").select(
        replay.decision_correct(F.col("d"), F.col("f")).alias("c")).first()
    assert row.c == correct


def test_stored_vectors_are_replaced(spark):
    old = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], "case_id long, vector array<double>, category int")
    new = spark.createDataFrame([(2, [9.0], 1)], "case_id long, vector array<double>, category int")
    assert {(r.case_id, r.vector[0], r.category) for r in ml.store_cases(old, new).collect()} == {(1, 1.0, 0), (2, 9.0, 1)}
