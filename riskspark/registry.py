"""Query key -> job. Every job reads whole tables of one folder through a `Lake`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.constants import FEATURES, HOUR
from riskspark.functions import scoring as S
from riskspark.functions.geo import haversine_km, with_coordinates
from riskspark.functions.numeric import micros, rnd
from riskspark.operators import curves, ranges
from riskspark.plans import (
    dashboard, economics, evaluation, feature_store, features, graph, intake, jobs, ml, replay, reports)
from riskspark.plans import scoring_views as views
from riskspark.plans.decisions import vectorized
from riskspark.plans.lake import Lake
from riskspark.session import checkpoint_dir
from riskspark.streaming import feeds

Job = Callable[[Lake], DataFrame]
VELOCITY = [f for f in FEATURES if "_count_" in f]
JOBS: dict[str, Job] = {}


def job(name: str) -> Callable[[Job], Job]:
    def add(function: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query {name} is registered twice")
        JOBS[name] = function
        return function

    return add


def columns(*names: str) -> Job:
    """A projection of the scored events."""
    return lambda lake: lake.scored_events.select(*names)


# Scans, sources and sinks
job("src_parquet")(lambda lake: lake.scan("events"))
job("src_auth_events")(lambda lake: lake.auth_events)
job("src_clearing")(intake.clearing)
job("src_chargeback")(intake.chargeback_log)
job("src_label")(intake.label_records)
job("upsert_customer")(intake.upsert_customers)
job("upsert_device")(intake.upsert_devices)
job("sink_append")(intake.sink_append)
job("lifecycle_log")(lambda lake: intake.lifecycle(lake.scored_events))
job("contract_auth_event")(intake.contract_auth_event)
job("contract_feature_vector")(intake.contract_feature_vector)
job("contract_model_score")(intake.contract_model_score)

# Projections, filters and scalar expressions
job("fx_to_usd")(views.fx_to_usd)
job("fx_cross_rate")(views.fx_cross_rate)


@job("geo_lookup")
def geo_lookup(lake: Lake) -> DataFrame:
    ips = with_coordinates(lake.ips, lake.gazetteer, "geo_country_code", "geo_city").select(
        F.lit("ip").alias("source"), F.col("ip_address").alias("key"), "lat", "lon")
    homes = with_coordinates(lake.customers, lake.gazetteer, "home_country_code", "home_region").select(
        F.lit("home").alias("source"), F.col("customer_id").cast("string").alias("key"), "lat", "lon")
    return ips.unionByName(homes)


def _dimensions(lake: Lake) -> DataFrame:
    return features.with_dimensions(lake.auth_events, lake.customers, lake.devices, lake.ips, lake.gazetteer)


@job("haversine_km")
def haversine(lake: Lake) -> DataFrame:
    return _dimensions(lake).select(
        "auth_event_id",
        rnd(haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("ip_lat"), F.col("ip_lon")), 3).alias("km"))


job("device_risk")(lambda lake: _dimensions(lake).select("auth_event_id", "device_id", "device_risk_score"))
job("ip_flags")(lambda lake: _dimensions(lake).select("auth_event_id", "ip_address", "proxy_vpn_tor_flag"))
job("scoring_vector")(lambda lake: features.scoring_vector(lake.feature_events, "auth_event_id"))
job("feature_json")(lambda lake: intake.feature_json(lake.feature_events))
job("json_vector")(lambda lake: intake.json_vector(intake.feature_json(lake.feature_events)))
job("rules_eval")(lambda lake: views.rules_long(lake.scored_events))
job("rules_score")(columns("auth_event_id", "rule_score", "high_rule_fired"))
job("heuristic_score")(lambda lake: views.model_scores(vectorized(lake.feature_events)).select(
    "auth_event_id", "model_version", "fraud_probability"))
job("calibrate_sigmoid")(columns("auth_event_id", "fraud_probability", "calibrated_probability"))
job("risk_band")(columns("auth_event_id", "calibrated_probability", "risk_band"))


@job("reason_codes")
def reason_codes(lake: Lake) -> DataFrame:
    return lake.scored_events.select("auth_event_id", F.array_join("reason_codes", ",").alias("reason_codes"))


@job("reason_explain")
def reason_explain(lake: Lake) -> DataFrame:
    return lake.scored_events.select(
        "auth_event_id", F.array_join(S.reason_texts(F.col("reason_codes")), " | ").alias("risk_factors"))


job("feature_contrib")(lambda lake: views.feature_contributions(vectorized(lake.feature_events)))
job("blend_score")(columns("auth_event_id", "calibrated_probability", "rule_score", "final_score"))
job("decide")(columns("auth_event_id", "final_score", "decision"))
job("auth_status")(columns("auth_event_id", "decision", "auth_status"))
job("case_routing")(lambda lake: views.routed_cases(lake.scored_events))


@job("threshold_decision")
def threshold_decision(lake: Lake) -> DataFrame:
    """Champion at the default cuts, shadow models at tighter ones."""
    shadow = F.col("shadow")

    def cut(normal: float, tight: float):
        return F.when(shadow, F.lit(tight)).otherwise(F.lit(normal))

    return views.model_scores(lake.scored_events).select(
        "auth_event_id", "model_version", S.decide_by_probability(
            F.col("raw_probability"), cut(0.85, 0.60), cut(0.55, 0.45), cut(0.35, 0.30)).alias("decision"))


job("recommend_action")(lambda lake: views.recommendations(lake.scored_events))
job("case_context_text")(lambda lake: views.case_texts(lake.scored_events, lake.labels))
job("search_transactions")(dashboard.search_transactions)
job("audit_trail")(lambda lake: dashboard.audit_trail(intake.audit_events(lake.scored_events), entity_type="case"))
job("agent_traces")(lambda lake: dashboard.agent_traces(lake.traces))
job("features_get")(lambda lake: dashboard.features_get(lake.feature_events, lake.chargebacks))
job("case_review")(lambda lake: dashboard.review_cases(
    views.cases(lake.scored_events), dashboard.review_actions(lake)))
job("case_create")(dashboard.case_create)

# Point-in-time features
job("features_online")(lambda lake: lake.feature_events.select(
    "auth_event_id", F.col("event_time").alias("feature_timestamp"), *FEATURES))
job("score_events")(lambda lake: lake.scored_events.select(
    "auth_event_id", "transaction_id", "event_time", "fraud_probability", "calibrated_probability", "risk_band",
    "rule_score", "final_score", "decision", "auth_status", "queue_name", "priority", "model_version",
    F.array_join("reason_codes", ",").alias("reason_codes")))

# Queues, pages and summaries
job("case_queue")(lambda lake: dashboard.case_queue(views.cases(lake.scored_events)))
job("page_keyset")(dashboard.page_keyset)
job("recent_decisions")(lambda lake: dashboard.recent_decisions(lake.scored_events))
job("queue_summary")(lambda lake: dashboard.queue_summary(views.cases(lake.scored_events)))
job("queue_age")(lambda lake: dashboard.queue_age(views.cases(lake.scored_events), lake.as_of))
job("ops_summary")(dashboard.ops_summary)

# Joins
job("j_chargeback_event")(lambda lake: lake.chargebacks.join(
    lake.auth_events.select("auth_event_id", "merchant_id"), "auth_event_id").groupBy("merchant_id").agg(
    F.count("*").alias("n_chargebacks"), F.sum("chargeback_amount").cast("decimal(18,2)").alias("amount")))
job("j_merchant_mcc")(lambda lake: lake.auth_events.join(lake.merchants, "merchant_id").select("auth_event_id", "mcc"))


@job("j_score_event")
def score_event(lake: Lake) -> DataFrame:
    times = lake.auth_events.where(
        (F.col("event_time") >= F.lit("2024-01-01").cast("timestamp_ntz")) & (F.col("event_time") < lake.as_of))
    return lake.model_scores.where("not shadow").select(
        "auth_event_id", "model_version", "calibrated_probability").join(
        times.select("auth_event_id", "auth_amount"), "auth_event_id")


job("j_fraud_semi")(lambda lake: economics.fraud_events(lake.auth_events, lake.labels).select(
    "auth_event_id", "customer_id", "auth_amount"))
job("j_nonfraud_anti")(lambda lake: economics.nonfraud_events(lake.auth_events, lake.labels).select(
    "auth_event_id", "customer_id", "auth_amount"))
job("j_decision_left")(lambda lake: lake.auth_events.select("auth_event_id").join(
    economics.latest_decision(lake.decisions), "auth_event_id", "left"))
job("j_label_asof")(lambda lake: lake.auth_events.select("auth_event_id").join(
    economics.latest_label(lake.labels, F.lit("2024-03-15").cast("timestamp_ntz")), "auth_event_id").select(
    "auth_event_id", "is_fraud", "label_received_at"))
job("j_prev_txn_asof")(lambda lake: features.previous_events(lake.auth_events).select(
    "auth_event_id", F.timestamp_micros("prev_t").cast("timestamp_ntz").alias("prev_time"), "prev_ip"))


@job("j_range_velocity")
def range_velocity(lake: Lake) -> DataFrame:
    """Earlier events of the same customer within an hour: a range self-join written as gains and losses."""
    rows = lake.auth_events.select("auth_event_id", "customer_id", micros(F.col("event_time")).alias("t"))
    at_time = rows.groupBy("customer_id", "t").agg(F.count("*").alias("n"))
    changes = at_time.select("customer_id", F.stack(
        F.lit(2), F.col("t"), F.col("n"), F.lit(True), F.col("t") + F.lit(HOUR + 1), -F.col("n"), F.lit(False)
    ).alias("t", "n_1h", "here"))
    live = ranges.running_totals(changes, ["customer_id"], ["n_1h"], ["here"],
                                 hot=ranges.hot_keys(rows, "customer_id")).where("here")
    return rows.join(live, ["customer_id", "t"]).select("auth_event_id", "n_1h")


job("j_threshold_cross")(lambda lake: curves.threshold_totals(
    lake.scored_lines, economics.SWEEP).select("threshold", "tp", "fp", "fn", "tn"))
job("j_dim_star")(lambda lake: lake.auth_events.join(lake.devices, "device_id", "left").join(
    lake.ips, "ip_address", "left").join(lake.customers, "customer_id", "left").select(
    "auth_event_id", "emulator_flag", "geo_country_code", "home_country_code"))
job("j_champion_score")(lambda lake: views.champion_scores(lake.model_scores))

# Economics
job("economics_summary")(economics.summary)
job("economics_by_segment")(economics.by_segment)
job("threshold_economics")(lambda lake: economics.threshold_economics(
    economics.scored_labelled(lake), economics.SCREEN_SWEEP))
job("threshold_optimize")(lambda lake: economics.optimize_threshold(lake.scored_lines))
job("threshold_multi")(lambda lake: economics.optimize_triple(lake.scored_lines))
job("best_threshold_ui")(economics.best_threshold)
job("loss_curve")(lambda lake: economics.loss_curve(economics.scored_labelled(lake)))
WINDOW = ("2024-01-08", "2024-01-22")
job("economics_by_segment_window")(lambda lake: economics.by_segment(lake, *WINDOW))
job("loss_curve_window")(lambda lake: economics.loss_curve(economics.scored_labelled(lake), *WINDOW))

# Evaluation, drift, parity
job("model_eval")(evaluation.model_eval)
job("model_eval_window")(lambda lake: evaluation.model_eval(
    lake, *WINDOW, segment=F.col("channel"), population=F.col("billing_amount_usd") >= 50))


def _harness(lake: Lake) -> DataFrame:
    return evaluation.eval_harness(lake.scored_lines, lake.challenger_lines)


job("eval_harness")(_harness)
job("eval_compare")(lambda lake: evaluation.eval_compare(
    _harness(lake).where("segment = 'all'"), C.CHAMPION_VERSION, evaluation.CHALLENGER))
job("eval_regression")(lambda lake: evaluation.eval_regression(
    _harness(lake).where("segment = 'all'"), C.CHAMPION_VERSION, evaluation.CHALLENGER))
job("drift_psi")(lambda lake: evaluation.feature_drift(lake.feature_events).select("feature", "psi"))
job("drift_js")(lambda lake: evaluation.feature_drift(lake.feature_events).select("feature", "js"))
job("drift_feature")(lambda lake: evaluation.feature_drift(lake.feature_events))
job("drift_daily")(lambda lake: evaluation.daily_drift(
    jobs.offline_training(lake, "2024-02-03"), lake.feature_events, "2024-02-03"))
job("shadow_experiment")(lambda lake: evaluation.shadow_experiment(lake.model_scores))


def _parity(lake: Lake) -> DataFrame:
    return evaluation.parity_long(evaluation.online_offline(lake))


job("j_online_offline")(lambda lake: evaluation.online_offline(lake).select("auth_event_id", "feature_version"))
job("parity_event")(lambda lake: evaluation.parity_events(evaluation.online_offline(lake)))
job("parity_report")(lambda lake: evaluation.parity_report(_parity(lake)))
job("parity_totals")(lambda lake: evaluation.parity_totals(evaluation.online_offline(lake)))
job("worst_mismatch")(lambda lake: evaluation.worst_mismatches(_parity(lake)))

# Operational metrics and profiles
job("metric_scoring")(lambda lake: evaluation.metric_scoring(lake.ops_metrics))
job("metric_decisions")(lambda lake: evaluation.metric_decisions(lake.decisions))
job("metric_rules")(lambda lake: evaluation.top_rules(lake.scored_events))
job("metric_parity")(lambda lake: evaluation.metric_parity(_parity(lake)))
job("metric_copilot")(lambda lake: evaluation.metric_copilot(lake.traces))
job("metric_api")(lambda lake: evaluation.metric_api(lake.ops_metrics))
job("nearest_rank_pct")(lambda lake: evaluation.nearest_rank(lake.ops_metrics))
job("fraud_type_profile")(lambda lake: evaluation.fraud_type_profile(lake.auth_events))
job("label_delay_profile")(evaluation.label_delay_profile)
job("feature_separation")(evaluation.feature_separation)
job("detection_rate")(lambda lake: evaluation.detection_rate(lake.scored_events))
job("fp_concentration")(evaluation.false_positive_concentration)
job("ks_two_sample")(lambda lake: evaluation.ks_two_sample(lake.scored_events))

# Governance
job("model_registry")(lambda lake: evaluation.model_registry(evaluation.registry_log(lake)))
job("model_health")(evaluation.model_health)
job("top_importance")(evaluation.top_importance)
job("model_card")(evaluation.model_cards)
job("model_card_diff")(lambda lake: evaluation.model_card_diff(evaluation.model_cards(lake)))

# Single features, offline features, snapshots and nightly jobs
for _name, _columns in {
    "w_customer_count_1h": ["customer_txn_count_1h"], "w_customer_count_24h": ["customer_txn_count_24h"],
    "w_customer_spend_24h": ["customer_spend_24h"], "w_card_count_10m": ["card_txn_count_10m"],
    "w_merchant_count_10m": ["merchant_txn_count_10m"], "w_merchant_cb_rate_30d": ["merchant_chargeback_rate_30d"],
    "w_device_count_1d": ["device_txn_count_1d"], "w_device_accounts_30d": ["device_account_count_30d"],
    "w_ip_accounts_7d": ["ip_account_count_7d"], "w_ip_cards_7d": ["ip_card_count_7d"],
    "w_amount_p95": ["amount_vs_customer_p95_ratio", "amount_vs_merchant_p95_ratio"],
    "w_geo_home": ["geo_distance_from_home_km"], "w_geo_last": ["geo_distance_from_last_txn_km"],
    "w_seconds_since_last": ["seconds_since_last_txn"],
}.items():
    job(_name)(lambda lake, names=_columns: lake.some_features(names).select("auth_event_id", *names))


@job("features_stored")
def _stored(lake: Lake) -> DataFrame:
    """Two groups are stored for the days of the window, and some features of both read back."""
    path = f"{checkpoint_dir(lake.spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    feature_store.store(lake, path, *WINDOW, groups=["velocity", "previous"])
    return feature_store.read(lake.spark, path, ["customer_txn_count_24h", "merchant_chargeback_rate_30d",
                                                 "seconds_since_last_txn"], *WINDOW)


job("w_amount_p95_sketch")(lambda lake: features.amount_p95_sketched(lake.auth_events))
job("features_offline")(lambda lake: jobs.offline_features(lake, "2024-01-20 00:00:00").select(
    "auth_event_id", *FEATURES))
job("label_snapshot")(lambda lake: jobs.label_snapshot(
    lake, "2024-02-25", 30, jobs.existing_snapshots(lake, "2024-02-25")))
job("j_backfill_anti")(lambda lake: jobs.backfill(lake, "2024-01-25", jobs.existing_offline(lake, "2024-01-25")))
job("job_daily")(lambda lake: jobs.daily(lake, "2024-02-03", f"{feeds.run_folder(lake.spark)}/daily"))

# Replay and case context
job("replay_latest_label")(lambda lake: replay.label_span(lake.labels))
job("replay_decision")(replay.replay_decisions_text)
job("replay_compare")(replay.replay_compare)
job("replay_batch")(replay.replay_batch)
job("risk_summary")(replay.risk_summary)
job("gather_context")(replay.gather_context)
job("score_champion_shadow")(lambda lake: lake.model_scores.select(
    "auth_event_id", "model_version", "shadow", "fraud_probability", "calibrated_probability", "predicted_label",
    "risk_band"))

# Graph
job("graph_edges")(lambda lake: lake.graph_edges)
job("edge_type_profile")(lambda lake: graph.edge_type_profile(lake.graph_edges))
job("graph_upsert")(graph.upsert)
job("graph_node_risk")(lambda lake: lake.graph_nodes)
job("graph_components")(lambda lake: lake.graph_components)
job("graph_components_grown")(graph.growing_components)
job("graph_khop")(lambda lake: graph.account_hops(lake).select(
    "root", "n_nodes", "n_accounts", "n_devices", "n_ips"))
job("graph_risk")(graph.graph_risk)
job("graph_synthetic")(lambda lake: lake.graph_risk.select("account_id", "synthetic_identity"))
job("graph_mule")(lambda lake: lake.graph_risk.select("account_id", "mule_pattern"))
job("graph_rings")(graph.rings)
job("top_rings")(graph.top_rings)
job("graph_expand")(graph.expand_busiest)
job("graph_cluster_analysis")(graph.cluster_analysis)
job("graph_cluster_feature")(graph.cluster_feature)
job("j_txn_360")(replay.transaction_360_text)

# Similarity, training and batch scoring
job("similar_cases")(ml.similar_cases)
job("similar_to_cases")(ml.similar_to_cases)
job("similar_by_hash")(lambda lake: ml.similar_to_cases(lake, hashed=True))
job("case_vector_store")(ml.case_vector_store)
job("training_set")(lambda lake: ml.training_set(lake))
job("train_boosted")(ml.training_report)
job("score_batch")(ml.scored_batch)
job("contract_report")(reports.contract_report)

# Streaming
job("st_ingest")(feeds.ingested)
job("st_velocity")(lambda lake: feeds.scored(lake).select("auth_event_id", *VELOCITY))
job("st_score")(lambda lake: feeds.scored(lake).select(
    "auth_event_id", "calibrated_probability", "final_score", "decision"))
job("st_ops_tumbling")(feeds.ops_tumbling)
job("st_ops_sliding")(feeds.ops_sliding)
job("st_rule_topk")(feeds.rule_topk)
job("st_label_join")(feeds.label_join)
job("st_late")(feeds.late_rows)
