"""Rules, scores, bands, decisions, currency and contracts on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.constants import CHAMPION_VERSION, FEATURES
from riskspark.functions import scoring as S
from riskspark.functions.money import default_rates, with_usd_rate
from riskspark.operators import contracts
from riskspark.plans.decisions import score_events
from riskspark.plans.scoring_views import feature_contributions, rules_long

SCHEMA = "auth_event_id bigint, " + ", ".join(f"{name} double" for name in FEATURES)
HIGH = dict(card_txn_count_10m=8, device_account_count_30d=5, proxy_vpn_tor_flag=1, amount_vs_customer_p95_ratio=4.0,
            ip_card_count_7d=6, seconds_since_last_txn=15, device_risk_score=0.6, customer_spend_24h=6000)


def vectors(spark, *rows):
    return spark.createDataFrame(
        [(i, *[float(row.get(name, 0)) if row.get(name, 0) is not None else None for name in FEATURES])
         for i, row in enumerate(rows)], SCHEMA)


def test_all_rules_fire_with_text(spark):
    rows = rules_long(vectors(spark, HIGH)).collect()
    assert [r.rule_id for r in rows] == [f"R00{i}" for i in range(1, 9)]
    assert all(r.fired and r.contribution_score == 1.0 and r.explanation for r in rows)


def test_rules_stay_silent(spark):
    fired = {r.rule_id for r in rules_long(vectors(spark, dict(card_txn_count_10m=4, seconds_since_last_txn=0))).collect()
             if r.fired}
    assert fired == set()


def test_rule_score_sums_weights_and_caps(spark):
    rows = vectors(spark, dict(card_txn_count_10m=5, device_account_count_30d=3, proxy_vpn_tor_flag=1), {}, HIGH)
    scores = [r.s for r in rows.select("auth_event_id", S.rules_score().alias("s")).orderBy("auth_event_id").collect()]
    assert scores == [0.75, 0.0, 1.0]


def test_custom_rule(spark):
    rule = S.Rule("X1", "large", "other", F.col("customer_spend_24h") > 10, "'large spend'")
    scored = score_events(vectors(spark, dict(customer_spend_24h=11)), [rule]).first()
    assert scored.rule_score == 0.1


def test_heuristic_low_and_high(spark):
    low, high = [r.p for r in vectors(spark, {"seconds_since_last_txn": 3600}, HIGH).select(
        "auth_event_id", S.heuristic_score(F.lit(CHAMPION_VERSION)).alias("p")).orderBy("auth_event_id").collect()]
    assert 0 <= low < 0.1
    assert high > 0.3


@pytest.mark.parametrize("p,band", [(.90, "critical"), (.70, "high"), (.50, "medium"), (.25, "low"), (.10, "minimal")])
def test_bands(spark, p, band):
    assert spark.range(1).select(S.risk_band(F.lit(p)).alias("b")).first().b == band


def test_reason_codes(spark):
    codes = vectors(spark, HIGH, {"seconds_since_last_txn": 100}).select(S.reason_codes().alias("c")).collect()
    assert {"HIGH_CARD_VELOCITY", "VPN_PROXY_TOR"} <= set(codes[0].c) and len(codes[0].c) == 5
    assert codes[1].c == ["BASELINE_RISK"]


@pytest.mark.parametrize("score,high,decision", [
    (.90, False, "hard_decline"), (.55, False, "manual_review"), (.40, False, "step_up"), (.20, False, "approve"),
    (.40, True, "manual_review")])
def test_decisions(spark, score, high, decision):
    assert spark.range(1).select(S.decide(F.lit(score), F.lit(high)).alias("d")).first().d == decision


def test_probabilities_stay_in_bounds(spark):
    draw = random.Random(7)
    rows = [{name: None if draw.random() < .2 else draw.uniform(0, 50) for name in FEATURES} for _ in range(100)]
    rows += [{"amount_vs_customer_p95_ratio": x} for x in (.001, .5, 1.0, 3.0, 10.0, 50.0)]
    out = score_events(vectors(spark, *rows)).select("fraud_probability", "calibrated_probability").collect()
    assert all(0 <= r.fraud_probability <= 1 and 0 <= r.calibrated_probability <= 1 for r in out)


def test_contributions_use_importances(spark):
    rows = feature_contributions(vectors(spark, dict(card_txn_count_10m=4)), {"card_txn_count_10m": 0.5}).where(
        "contribution <> 0").collect()
    assert [(r.feature, r.contribution) for r in rows] == [("card_txn_count_10m", 2.0)]


def test_currency(spark):
    rows = [("USD", 100.0, 100.0), ("EUR", 100.0, 108.0), (" gbp", 100.0, 127.0), ("JPY", 1e6, 6700.0),
            ("XYZ", 100.0, 100.0), (None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "code string, amount double, want double")
    got = with_usd_rate(df, default_rates(spark), "code", "rate").select(
        "want", (F.col("amount") * F.col("rate")).alias("got")).collect()
    assert len(got) == len(rows) and all(r.got == pytest.approx(r.want) for r in got)


def test_custom_rates(spark):
    rates = spark.createDataFrame([("XYZ", 2.0)], "currency string, usd_rate double")
    df = spark.createDataFrame([("xyz",), ("EUR",)], "code string")
    assert sorted(r.rate for r in with_usd_rate(df, rates, "code", "rate").collect()) == [1.0, 2.0]


GOOD = dict(transaction_id=1, account_id=1, card_id=1, customer_id=1, merchant_id=1, auth_type="recurring", channel="web",
            entry_mode="chip", auth_amount=10.0, currency_code="USD", merchant_country_code="US")
PAYLOAD = ("transaction_id bigint, account_id bigint, card_id bigint, customer_id bigint, merchant_id bigint, "
           "auth_type string, channel string, entry_mode string, auth_amount double, currency_code string, "
           "merchant_country_code string")


@pytest.mark.parametrize("change", [
    {}, {"account_id": None}, {"auth_type": "barter"}, {"channel": None}, {"entry_mode": "beam"}, {"auth_amount": 0.0},
    {"currency_code": "US"}, {"merchant_country_code": "USA"}])
def test_auth_contract(spark, change):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in PAYLOAD.split(", "))], PAYLOAD)
    checked = contracts.validate(df, contracts.AUTH_EVENT).first()
    assert len(checked.errors) == len(change) and checked.valid == (not change)
    valid, quarantined = contracts.split_valid(df, contracts.AUTH_EVENT)
    assert (valid.count(), quarantined.count()) == ((1, 0) if not change else (0, 1))


def test_feature_contract_coerces(spark):
    df = spark.createDataFrame([('{"customer_txn_count_1h": "bad", "device_risk_score": 1.5}',)], "feature_json string")
    row = contracts.validate(contracts.coerce_features(df), contracts.FEATURE_VECTOR).first()
    assert row.customer_txn_count_1h == 0 and row.seconds_since_last_txn is None
    assert row.errors == ["device_risk_score: must be at most 1"]
