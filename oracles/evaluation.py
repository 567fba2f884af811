"""SQL checks: evaluation, drift, parity, metrics, profiles, governance, snapshots, replay."""

from __future__ import annotations

import oracles.economics  # noqa: F401  (its fragments)
from oracles.base import (
    FRAGMENTS, by_probability, heuristic, r, ratio, sigmoid, sql,
)
from oracles.core import BODIES as CORE
from oracles.economics import BODIES as ECONOMICS_BODIES
from riskspark import constants as C

LGB = C.SHADOW_VERSIONS[0]
SPLIT = "TIMESTAMP '2024-01-16'"


def ranks(rows: str, groups: str) -> str:
    """AUC by average ranks, average precision over the positives; `rows` has p, f (boolean) and the groups."""
    return f"""SELECT {groups}, {r('''CASE WHEN n_pos > 0 AND n_neg > 0 THEN
  (rank_sum - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg) END''', 6)} AS auc_roc,
  {r('CASE WHEN n_pos > 0 AND n_neg > 0 THEN ap END', 6)} AS auc_pr FROM (
SELECT {groups}, count(*) FILTER (f) AS n_pos, count(*) FILTER (NOT f) AS n_neg, sum(rk) FILTER (f) AS rank_sum,
  avg(prec) FILTER (f) AS ap FROM (
SELECT *, rank() OVER (PARTITION BY {groups} ORDER BY p) + (count(*) OVER (PARTITION BY {groups}, p) - 1) / 2.0 AS rk,
  CAST(sum(f::INT) OVER (PARTITION BY {groups} ORDER BY p DESC) AS DOUBLE)
    / count(*) OVER (PARTITION BY {groups} ORDER BY p DESC) AS prec FROM ({rows})) GROUP BY {groups})"""


def rates(rows: str, groups: str) -> str:
    return f"""SELECT {groups}, n AS sample_size, {ratio('tp + fn', 'n')} AS fraud_rate, {ratio('tp', 'tp + fp')} AS precision,
  {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('fp', 'fp + tn')} AS false_positive_rate,
  {ratio('fn', 'fn + tp')} AS false_negative_rate, {ratio('fn + tn', 'n')} AS approval_rate, {ratio('nd', 'n')} AS decline_rate,
  {ratio('tp + fp - nd', 'n')} AS review_rate, {r('loss', 2)} AS expected_loss, {r('saved', 2)} AS prevented_loss
FROM (SELECT {groups}, count(*) AS n, count(*) FILTER (p >= 0.55 AND f) AS tp, count(*) FILTER (p >= 0.55 AND NOT f) AS fp,
  count(*) FILTER (p < 0.55 AND f) AS fn, count(*) FILTER (p < 0.55 AND NOT f) AS tn, count(*) FILTER (p >= 0.85) AS nd,
  CAST(coalesce(sum(amount_usd) FILTER (f), 0) AS DOUBLE) AS loss,
  CAST(coalesce(sum(amount_usd) FILTER (f AND p >= 0.55), 0) AS DOUBLE) AS saved FROM ({rows}) GROUP BY {groups})"""


SELECTED = "event_time BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' AND billing_amount_usd >= 50"


def model_eval(rows: str, decisions: str, groups: str) -> str:
    """Ranking metrics, rates and decision mix per group; `decisions` holds the groups and decision_type."""
    return f"""SELECT {groups}, sample_size, precision AS precision_at_review, recall AS recall_at_review,
  false_positive_rate, false_negative_rate, auc_roc, auc_pr, coalesce(m.approval_rate, 0) AS approval_rate,
  coalesce(m.decline_rate, 0) AS decline_rate, coalesce(m.review_rate, 0) AS review_rate
FROM ({ranks(rows, groups)}) a JOIN ({rates(rows, groups)}) b USING ({groups})
LEFT JOIN (SELECT {groups}, {ratio("count(*) FILTER (decision_type = 'approve')", 'count(*)')} AS approval_rate,
  {ratio("count(*) FILTER (decision_type IN ('decline', 'hard_decline'))", 'count(*)')} AS decline_rate,
  {ratio("count(*) FILTER (decision_type = 'manual_review')", 'count(*)')} AS review_rate FROM ({decisions}) GROUP BY {groups}) m
  USING ({groups})"""


def unpivot(table: str, keep: str, where: str = "true", names=C.FEATURES) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM {table} WHERE {where}" for n in names)


def drift(long: str, groups: str) -> str:
    keys = groups.split(", ")
    on = " AND ".join(f"b.{k} = s.{k}" for k in keys)
    q = ", ".join(f"s.{k}" for k in keys)
    stats = f"""SELECT {groups}, min(value) AS lo, max(value) AS hi, CAST(count(value) FILTER (NOT production) AS DOUBLE) AS n_t,
  CAST(count(value) FILTER (production) AS DOUBLE) AS n_q, count(*) FILTER (production) AS prod_rows,
  CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (NOT production) AS DOUBLE) AS t_sum,
  CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (production) AS DOUBLE) AS q_sum FROM ({long}) GROUP BY {groups}"""
    counts = f"""SELECT {', '.join('l.' + k for k in keys)}, least(floor((value - lo) / (hi - lo) * 10), 9) AS bin,
  CAST(count(*) FILTER (NOT production) AS DOUBLE) AS t0, CAST(count(*) FILTER (production) AS DOUBLE) AS q0
FROM ({long}) l JOIN ({stats}) m ON {' AND '.join(f'm.{k} = l.{k}' for k in keys)}
WHERE value IS NOT NULL AND hi > lo GROUP BY ALL"""
    ok = "s.hi > s.lo AND s.n_t > 0 AND s.n_q > 0"
    return f"""SELECT {groups}, any_value(prod_rows) AS prod_rows, any_value(n_t) AS n_t, any_value(n_q) AS n_q,
  any_value(t_sum) AS t_sum, any_value(q_sum) AS q_sum,
  coalesce(sum((a1 - e1) * ln(a1 / e1)) FILTER (ok), 0) AS psi,
  coalesce(greatest(0, sum((a2 - e2) * ln(a2 / e2)) FILTER (ok)), 0) AS psi_smoothed,
  coalesce(sum(0.5 * e3 * ln(e3 / (0.5 * (e3 + a3))) + 0.5 * a3 * ln(a3 / (0.5 * (e3 + a3)))) FILTER (ok), 0) AS js
FROM (SELECT {q}, s.prod_rows, s.n_t, s.n_q, s.t_sum, s.q_sum, ({ok}) AS ok,
  greatest(coalesce(b.t0, 0) / s.n_t, 1e-6) AS e1, greatest(coalesce(b.q0, 0) / s.n_q, 1e-6) AS a1,
  (coalesce(b.t0, 0) + 1e-10) / (s.n_t + 1e-10) AS e2, (coalesce(b.q0, 0) + 1e-10) / (s.n_q + 1e-10) AS a2,
  (coalesce(b.t0, 0) + 1e-10) / (s.n_t + 1e-9) AS e3, (coalesce(b.q0, 0) + 1e-10) / (s.n_q + 1e-9) AS a3
  FROM ({stats}) s CROSS JOIN range(10) g(bin) LEFT JOIN ({counts}) b ON {on} AND b.bin = g.bin) GROUP BY {groups}"""


MODEL = "(CASE customer_id % 3 WHEN 0 THEN 'xgb' WHEN 1 THEN 'lgb' ELSE 'nn' END || '-m' || (customer_id % 20))"
FRAGMENTS.update({
    "split_long": unpivot("features", f"event_time >= {SPLIT} AS production"),
    "split_drift": drift("SELECT * FROM split_long", "feature"),
    "feature_drift": f"""SELECT feature, {r('psi', 6)} AS psi, {r('js', 6)} AS js,
  {r('coalesce(1 - n_q / nullif(prod_rows, 0), 0)', 6)} AS null_rate, {r('coalesce(t_sum / nullif(n_t, 0), 0)', 4)} AS train_mean,
  {r('coalesce(q_sum / nullif(n_q, 0), 0)', 4)} AS prod_mean FROM split_drift""",
    "labelled": """SELECT s.*, s.raw_probability AS p, l.is_fraud AS f, s.billing_amount_usd AS amount_usd
FROM scored s JOIN latest_label l USING (auth_event_id)""",
    "labelled_models": """SELECT s.*, s.raw_probability AS p, l.is_fraud AS f, s.billing_amount_usd AS amount_usd
FROM all_scores s JOIN latest_label l USING (auth_event_id)""",
    "line_models": f"""SELECT '{C.CHAMPION_VERSION}' AS model_version, probability AS p, is_fraud AS f, amount_usd, unnest(['all', segment]) AS segment
FROM scored_lines UNION ALL SELECT '{LGB}', probability, is_fraud, amount_usd, unnest(['all', segment]) FROM challenger_lines""",
    "harness": f"""SELECT * FROM ({ranks('SELECT * FROM line_models', 'model_version, segment')})
JOIN ({rates('SELECT * FROM line_models', 'model_version, segment')}) USING (model_version, segment)""",
    "harness_pairs": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, max({m}) FILTER (model_version = '{C.CHAMPION_VERSION}') AS champion, "
        f"max({m}) FILTER (model_version = '{LGB}') AS challenger FROM harness WHERE segment = 'all'"
        for m in ("auc_roc", "auc_pr", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate")),
    "parity_long": " UNION ALL ".join(
        "SELECT auth_event_id, '{n}' AS feature, {n} AS online, {off} AS offline FROM vectors".format(
            n=n, off="CASE WHEN auth_event_id % 100 = 0 THEN customer_spend_24h + 1 ELSE customer_spend_24h END"
            if n == "customer_spend_24h" else
            "CASE WHEN auth_event_id % 250 <> 0 THEN device_risk_score END" if n == "device_risk_score" else n)
        for n in C.FEATURES),
    "parity": "SELECT *, abs(online - offline) AS delta FROM parity_long",
    "registry_log": f"""SELECT {MODEL} AS model_version, CASE event_type WHEN 'signup' THEN 'register' ELSE 'promote' END AS action,
  event_time, auth_event_id AS event_id, 'owner_' || customer_id AS actor FROM auth_events
WHERE event_type IN ('signup', 'purchase')""",
    "registry": """SELECT model_version, CASE WHEN p.event_id IS NOT NULL THEN 'production'
  WHEN f.event_id IS NOT NULL THEN 'staging' END AS deployment_status, f.actor AS owner, f.event_time AS registered_at,
  p.event_time AS promoted_at, p.actor AS approved_by,
  n - (f.event_id IS NOT NULL)::INT - (p.event_id IS NOT NULL)::INT AS refused
FROM (SELECT model_version, count(*) AS n FROM registry_log GROUP BY 1) a
LEFT JOIN (SELECT * FROM registry_log WHERE action = 'register' QUALIFY row_number() OVER (PARTITION BY model_version
  ORDER BY event_time, event_id) = 1) f USING (model_version)
LEFT JOIN (SELECT l.* FROM registry_log l JOIN (SELECT model_version, min(event_time) AS t FROM registry_log
    WHERE action = 'register' GROUP BY 1) x ON x.model_version = l.model_version AND l.event_time > x.t
  WHERE l.action = 'promote' QUALIFY row_number() OVER (PARTITION BY l.model_version
  ORDER BY l.event_time, l.event_id) = 1) p USING (model_version)""",
    "model_rows": f"SELECT *, {MODEL} AS model, CAST(event_time AS DATE) AS eval_date FROM labelled",
    "importances": f"""SELECT model, feature, {r('CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) / count(*) * 0.1', 4)} AS importance
FROM (SELECT model_of.model, u.* FROM ({unpivot('vectors', 'auth_event_id')}) u JOIN model_of USING (auth_event_id))
GROUP BY ALL""",
    "model_of": f"SELECT auth_event_id, {MODEL} AS model FROM auth_events",
    "model_drift": drift(unpivot("model_features", f"model, event_time >= {SPLIT} AS production"), "model, feature"),
    "model_features": f"SELECT *, {MODEL} AS model FROM features",
    "cards": f"""SELECT g.model_version, CASE WHEN g.model_version LIKE 'xgb%' THEN 'xgboost' WHEN g.model_version LIKE 'lgb%'
  THEN 'lightgbm' ELSE 'unknown' END AS model_type, 'v2.3.1' AS feature_version,
  CASE WHEN CAST(regexp_extract(g.model_version, '[0-9]+$') AS INT) % 2 = 0 THEN 0.8 ELSE 0.85 END AS threshold_decline,
  0.55 AS threshold_review, 0.35 AS threshold_step_up, a.auc_roc, a.auc_pr, c.precision, c.recall, c.f1, i.top_importances,
  g.deployment_status, g.approved_by, strftime(g.promoted_at, '%Y-%m-%d %H:%M:%S') AS deployed_at, g.refused AS refused_requests
FROM registry g LEFT JOIN ({ranks('SELECT * FROM model_rows', 'model')}) a ON a.model = g.model_version
LEFT JOIN ({rates('SELECT * FROM model_rows', 'model')}) c ON c.model = g.model_version
LEFT JOIN (SELECT model, string_agg(feature, ',' ORDER BY rk) AS top_importances FROM (SELECT *, row_number() OVER (
  PARTITION BY model ORDER BY importance DESC, feature) AS rk FROM importances) WHERE rk <= 10 GROUP BY 1) i
  ON i.model = g.model_version WHERE g.deployment_status IS NOT NULL""",
    "replay": f"""SELECT s.*, d.decision_type, l.is_fraud, l.last_received_at, l.first_received_at,
  CASE WHEN d.decision_type IS NOT NULL AND l.is_fraud IS NOT NULL THEN (d.decision_type IN ('approve', 'step_up')) <> l.is_fraud
  END AS decision_correct, {r('(epoch_us(l.first_received_at) - epoch_us(s.event_time)) / 1e6', 3)} AS time_to_label_seconds,
  {sigmoid(heuristic("'" + LGB + "'"))} AS wp
FROM scored s LEFT JOIN latest_decision d USING (auth_event_id) LEFT JOIN label_span l USING (auth_event_id)""",
    "label_span": """SELECT l.auth_event_id, l.is_fraud, l.label_received_at AS last_received_at, f.first_received_at FROM latest_label l
JOIN (SELECT auth_event_id, min(label_received_at) AS first_received_at FROM fraud_labels GROUP BY 1) f USING (auth_event_id)""",
    "fired": "SELECT auth_event_id, rule_id, rule_name FROM (" + CORE["rules_eval"] + ") WHERE fired",
})
_blend = "(0.7::DOUBLE * wp + 0.3::DOUBLE * rule_score)"
_drift_window = """CASE WHEN event_time >= TIMESTAMP '2024-02-03' - INTERVAL 120 DAY AND event_time < TIMESTAMP '2024-02-03' - INTERVAL 30 DAY
  THEN false WHEN event_time >= TIMESTAMP '2024-02-03' - INTERVAL 7 DAY AND event_time < TIMESTAMP '2024-02-03' THEN true END"""
FRAGMENTS["daily_long"] = "SELECT * FROM (" + unpivot("features", f"{_drift_window} AS production") + \
    ") WHERE production IS NOT NULL"
_mean = r("CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) / count(*) * 0.1", 4)


def feature_view(*names: str) -> str:
    return f"SELECT auth_event_id, {', '.join(names)} FROM features"


BODIES = {
    "model_eval": model_eval("SELECT * FROM labelled_models", "SELECT * FROM decisions", "model_version"),
    "model_eval_window": model_eval(
        f"SELECT *, channel AS segment FROM labelled_models WHERE {SELECTED}",
        f"""SELECT d.*, channel AS segment FROM decisions d JOIN (SELECT * FROM all_scores WHERE {SELECTED}) s
  ON d.auth_event_id = s.auth_event_id AND d.model_version = s.model_version""", "model_version, segment"),
    "eval_harness": "SELECT * FROM harness",
    "eval_compare": f"""SELECT metric, champion, challenger, {r('challenger - champion', 6)} AS delta,
  {ratio('(challenger - champion) * 100', 'champion', 4)} AS pct_change, improved,
  count(*) FILTER (improved) OVER () AS improvements,
  CASE WHEN count(*) FILTER (improved) OVER () >= count(*) OVER () * 0.7 THEN 'promote' ELSE 'hold' END AS recommendation
FROM (SELECT *, CASE WHEN metric LIKE 'false%' THEN challenger < champion ELSE challenger > champion END AS improved
  FROM harness_pairs)""",
    "eval_regression": f"""SELECT metric, champion AS baseline, challenger AS current,
  {r('abs((challenger - champion) / champion * 100)', 4)} AS change_pct,
  champion <> 0 AND challenger <> 0 AND (challenger - champion) / champion * 100 < -5 AS regressed
FROM harness_pairs WHERE metric IN ('auc_roc', 'precision', 'recall', 'f1')""",
    "drift_psi": "SELECT feature, psi FROM feature_drift",
    "drift_js": "SELECT feature, js FROM feature_drift",
    "drift_feature": "SELECT *, psi > 0.25 OR js > 0.1 AS alert FROM feature_drift",
    "drift_daily": f"""SELECT feature, {r('psi_smoothed', 6)} AS psi, {r('coalesce(t_sum / nullif(n_t, 0), 0)', 4)} AS train_mean,
  {r('coalesce(q_sum / nullif(n_q, 0), 0)', 4)} AS prod_mean, {ratio('prod_rows - n_q', 'greatest(prod_rows, 1)')} AS null_rate,
  {r('psi_smoothed', 6)} >= 0.25 AS alert FROM ({drift('SELECT * FROM daily_long', 'feature')})""",
    "shadow_experiment": f"""SELECT {r('CAST(sum(CAST(' + r('a', 6) + ' AS DECIMAL(18,6))) AS DOUBLE) / count(*)', 6)} AS champion_avg_score,
  {r('CAST(sum(CAST(' + r('b', 6) + ' AS DECIMAL(18,6))) AS DOUBLE) / count(*)', 6)} AS challenger_avg_score,
  {ratio('count(*) FILTER (a >= 0.55) * 100', 'count(*)')} AS champion_decline_pct,
  {ratio('count(*) FILTER (b >= 0.55) * 100', 'count(*)')} AS challenger_decline_pct,
  {ratio('count(*) FILTER ((a >= 0.55) = (b >= 0.55)) * 100', 'count(*)')} AS agreement_pct, count(*) AS n_events
FROM (SELECT x.raw_probability AS a, y.raw_probability AS b FROM all_scores x JOIN all_scores y
  ON x.auth_event_id = y.auth_event_id AND NOT x.shadow AND y.shadow)""",
    "j_online_offline": """SELECT auth_event_id, 'v2.3.1' AS feature_version FROM features""",
    "parity_event": f"""SELECT auth_event_id, count(*) FILTER (delta <= 0.01) AS n_matching, count(*) FILTER (delta > 0.01) AS n_mismatched,
  count(*) FILTER (offline IS NULL) AS n_missing, {r('max(delta)', 4)} AS max_delta,
  count(*) FILTER (delta > 0.01) = 0 AND count(*) FILTER (offline IS NULL) = 0 AS passed FROM parity GROUP BY 1""",
    "parity_report": f"""SELECT feature, count(*) AS n_checked, count(*) FILTER (delta > 0.01) AS mismatch_count,
  count(*) FILTER (offline IS NULL) AS missing_count,
  {r('coalesce(avg(delta) FILTER (delta > 0.01), 0)', 4)} AS mean_absolute_error,
  {r('coalesce(max(delta) FILTER (delta > 0.01), 0)', 4)} AS max_error FROM parity GROUP BY 1""",
    "parity_totals": """SELECT count(*) AS checked, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM (
SELECT auth_event_id, count(*) FILTER (delta > 0.01 OR offline IS NULL) = 0 AS ok FROM parity GROUP BY 1)""",
    "worst_mismatch": f"""SELECT auth_event_id, feature, {r('delta', 4)} AS delta FROM parity WHERE delta > 0.01
ORDER BY 3 DESC, 1, 2 LIMIT 20""",
    "metric_scoring": f"""SELECT CASE WHEN request_id % 2 = 0 THEN '{C.CHAMPION_VERSION}' ELSE '{LGB}' END AS model_version,
  {r('quantile_cont(latency_ms, 0.5)', 2)} AS p50_latency_ms, {r('quantile_cont(latency_ms, 0.95)', 2)} AS p95_latency_ms,
  {r('quantile_cont(latency_ms, 0.99)', 2)} AS p99_latency_ms, count(*) AS total_calls,
  count(*) FILTER (status <> 200) AS fallback_count, {ratio('count(*) FILTER (status <> 200)', 'count(*)', 4)} AS fallback_rate
FROM ops_metrics GROUP BY 1""",
    "metric_decisions": f"""SELECT decision_type, count(*) AS n, sum(count(*)) OVER () ::BIGINT AS total,
  {ratio("sum(count(*) FILTER (decision_type LIKE '%approve%' AND decision_type NOT LIKE '%decline%')) OVER ()", 'sum(count(*)) OVER ()', 4)} AS approval_rate,
  {ratio("sum(count(*) FILTER (decision_type LIKE '%decline%')) OVER ()", 'sum(count(*)) OVER ()', 4)} AS decline_rate,
  {ratio("sum(count(*) FILTER (decision_type LIKE '%review%')) OVER ()", 'sum(count(*)) OVER ()', 4)} AS review_rate
FROM decisions GROUP BY decision_type""",
    "metric_rules": "SELECT rule_name, count(*) AS fires FROM fired GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "metric_parity": """SELECT feature, count(*) AS failures FROM parity WHERE delta > 0.01 OR offline IS NULL GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
    "metric_copilot": f"""SELECT count(*) AS total_calls, count(*) FILTER (length(text) < 60) AS fallback_count,
  {ratio('count(*) FILTER (length(text) < 60)', 'count(*)', 4)} AS fallback_rate FROM conversations WHERE role = 'assistant'""",
    "metric_api": f"""SELECT coalesce(endpoint, 'total') AS endpoint, count(*) AS requests,
  {r('CAST(sum(CAST(latency_ms AS DECIMAL(20,4))) AS DOUBLE) / count(*)', 2)} AS avg_latency_ms,
  count(*) FILTER (status >= 400) AS error_count, {ratio('count(*) FILTER (status >= 400)', 'count(*)', 4)} AS error_rate
FROM ops_metrics GROUP BY ROLLUP (endpoint)""",
    "nearest_rank_pct": """SELECT endpoint, max(latency_ms) FILTER (rn = floor(n * 0.5::DOUBLE)) AS p50,
  max(latency_ms) FILTER (rn = floor(n * 0.95::DOUBLE)) AS p95, max(latency_ms) FILTER (rn = floor(n * 0.99::DOUBLE)) AS p99
FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY endpoint) AS n
  FROM ops_metrics) GROUP BY 1""",
    "fraud_type_profile": f"""SELECT event_type AS fraud_type, count(*) AS n, {ratio('count(*)', 'sum(count(*)) OVER ()')} AS share,
  {r('CAST(sum(billing_amount_usd) AS DOUBLE) / count(*)', 4)} AS avg_amount FROM stored_events GROUP BY 1""",
    "label_delay_profile": f"""SELECT count(*) AS n, {r('CAST(sum(CAST(d AS DECIMAL(20,4))) AS DOUBLE) / count(*)', 4)} AS mean_days, {r('median(d)', 4)} AS median_days,
  {r('max(d)', 4)} AS max_days, count(*) FILTER (d > 30) AS over_30, {ratio('count(*) FILTER (d > 30)', 'count(*)')} AS over_30_share
FROM (SELECT (epoch_us(label_received_at) - epoch_us(event_time)) / 8.64e10 AS d FROM fraud_labels
  JOIN auth_events USING (auth_event_id) WHERE is_fraud)""",
    "feature_separation": f"""SELECT feature, {r('a', 4)} AS fraud_mean, {r('b', 4)} AS legit_mean, {r('a / (b + 1e-9)', 4)} AS separation
FROM (SELECT feature, CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (f) AS DOUBLE) / count(*) FILTER (f) AS a,
  CAST(sum(CAST(value AS DECIMAL(20,4))) FILTER (NOT f) AS DOUBLE) / count(*) FILTER (NOT f) AS b
FROM ({unpivot('labelled', 'f')}) GROUP BY 1)""",
    "detection_rate": f"""SELECT event_type AS fraud_type, count(*) AS n, count(*) FILTER (raw_probability > 0.35) AS caught,
  {ratio('count(*) FILTER (raw_probability > 0.35)', 'count(*)')} AS rate FROM scored GROUP BY 1""",
    "fp_concentration": f"""SELECT channel, count(*) AS n, {ratio('count(*)', 'sum(count(*)) OVER ()')} AS share FROM labelled
WHERE NOT f AND p > 0.35 GROUP BY 1""",
    "ks_two_sample": f"""SELECT {r('max(abs(a / na - b / nb))', 6)} AS ks, any_value(na)::BIGINT AS n_a, any_value(nb)::BIGINT AS n_b FROM (
SELECT sum((event_time >= {SPLIT})::INT) OVER (ORDER BY raw_probability) AS a,
  sum((event_time < {SPLIT})::INT) OVER (ORDER BY raw_probability) AS b,
  CAST(sum((event_time >= {SPLIT})::INT) OVER () AS DOUBLE) AS na, CAST(sum((event_time < {SPLIT})::INT) OVER () AS DOUBLE) AS nb FROM scored)""",
    "model_registry": "SELECT * FROM registry",
    "model_health": f"""SELECT g.model_version, g.deployment_status, g.owner, e.auc_roc, e.eval_date, coalesce(d.n, 0) AS drift_alerts,
  CASE WHEN coalesce(d.n, 0) = 0 THEN 'healthy' WHEN d.n < 3 THEN 'degraded' ELSE 'critical' END AS health
FROM registry g LEFT JOIN (SELECT * FROM ({ranks('SELECT * FROM model_rows', 'model, eval_date')})
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY eval_date DESC) = 1) e ON e.model = g.model_version
LEFT JOIN (SELECT model, count(*) FILTER ({r('psi', 6)} > 0.25 OR {r('js', 6)} > 0.1) AS n FROM model_drift GROUP BY 1) d
  ON d.model = g.model_version WHERE g.deployment_status IS NOT NULL""",
    "top_importance": f"""SELECT feature, {_mean} AS importance FROM ({unpivot('vectors', '1 AS one')}) GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
    "model_card": "SELECT * FROM cards",
    "model_card_diff": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, (SELECT {e} FROM cards ORDER BY model_version LIMIT 1) AS version_a, "
        f"(SELECT {e} FROM cards ORDER BY model_version DESC LIMIT 1) AS version_b"
        for c, e in [(c, c) for c in ("model_type", "feature_version", "top_importances", "deployment_status",
                                      "approved_by", "deployed_at")]
        + [(c, f"printf('%.6f', {c})") for c in ("threshold_decline", "threshold_review", "threshold_step_up",
                                                 "auc_roc", "auc_pr", "precision", "recall", "f1")]
        + [("refused_requests", "CAST(refused_requests AS VARCHAR)")]
    ) + ") WHERE version_a IS DISTINCT FROM version_b",
    "w_customer_count_1h": feature_view("customer_txn_count_1h"),
    "w_customer_count_24h": feature_view("customer_txn_count_24h"),
    "w_customer_spend_24h": feature_view("customer_spend_24h"),
    "w_card_count_10m": feature_view("card_txn_count_10m"),
    "w_merchant_count_10m": feature_view("merchant_txn_count_10m"),
    "w_merchant_cb_rate_30d": feature_view("merchant_chargeback_rate_30d"),
    "w_device_count_1d": feature_view("device_txn_count_1d"),
    "w_device_accounts_30d": feature_view("device_account_count_30d"),
    "w_ip_accounts_7d": feature_view("ip_account_count_7d"),
    "w_ip_cards_7d": feature_view("ip_card_count_7d"),
    "features_stored": """SELECT auth_event_id, customer_txn_count_24h, merchant_chargeback_rate_30d, seconds_since_last_txn
FROM features WHERE event_time >= TIMESTAMP '2024-01-08' AND event_time < TIMESTAMP '2024-01-22'""",
    "w_amount_p95_sketch": """SELECT auth_event_id, quantile_disc(cents, 0.95) OVER (PARTITION BY customer_id ORDER BY day
    RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) / 100.0::DOUBLE AS customer_p95,
  quantile_disc(cents, 0.95) OVER (PARTITION BY merchant_id ORDER BY day
    RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) / 100.0::DOUBLE AS merchant_p95
FROM (SELECT *, epoch_us(event_time) // 86400000000 AS day, CAST(billing_amount_usd * 100 AS BIGINT) AS cents
  FROM stored_events)""",
    "w_amount_p95": feature_view("amount_vs_customer_p95_ratio", "amount_vs_merchant_p95_ratio"),
    "w_geo_home": feature_view("geo_distance_from_home_km"),
    "w_geo_last": feature_view("geo_distance_from_last_txn_km"),
    "w_seconds_since_last": feature_view("seconds_since_last_txn"),
    "j_backfill_anti": f"""SELECT auth_event_id, event_time AS as_of_time, 'v2.3.1' AS feature_version,
  DATE '2024-01-25' AS label_snapshot_date, {', '.join(C.FEATURES)} FROM features
WHERE event_time < TIMESTAMP '2024-01-24' AND auth_event_id % 7 <> 0""",
    "label_snapshot": """SELECT e.auth_event_id, DATE '2024-02-25' AS snapshot_date, l.label_source AS label_status,
  l.is_fraud AS is_fraud_snapshot, 30 AS maturity_days FROM auth_events e
JOIN (SELECT * FROM fraud_labels WHERE label_received_at <= TIMESTAMP '2024-02-25' QUALIFY row_number() OVER (
  PARTITION BY auth_event_id ORDER BY label_received_at DESC, label_id DESC) = 1) l USING (auth_event_id)
WHERE e.event_time < TIMESTAMP '2024-01-26' AND e.auth_event_id % 9 <> 0""",
    "replay_latest_label": "SELECT auth_event_id, first_received_at, is_fraud, last_received_at FROM label_span",
    "replay_decision": """SELECT r.auth_event_id, customer_id, auth_amount, customer_spend_24h, seconds_since_last_txn,
  calibrated_probability, risk_band, coalesce(f.rules, '') AS rules_fired, 0.55 AS threshold_review, decision_type, is_fraud,
  decision_correct, time_to_label_seconds, coalesce(t.n, 0) AS n_traces FROM replay r
LEFT JOIN (SELECT auth_event_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM fired GROUP BY 1) f USING (auth_event_id)
LEFT JOIN (SELECT conv_id AS auth_event_id, count(*) AS n FROM conversations GROUP BY 1) t USING (auth_event_id)""",
    "replay_compare": f"""SELECT auth_event_id, decision_type AS actual_decision, {r('wp', 6)} AS what_if_probability,
  {by_probability('wp', '0.60', '0.45', '0.30')} AS what_if_decision, CASE WHEN {_blend} >= 0.60 THEN 'hard_decline'
  WHEN {_blend} >= 0.45 OR high_rule_fired THEN 'manual_review' WHEN {_blend} >= 0.30 THEN 'step_up' ELSE 'approve' END AS blend_decision,
  {by_probability('wp', '0.60', '0.45', '0.30')} IS DISTINCT FROM decision_type AS decision_changed FROM replay""",
    "replay_batch": f"""SELECT *, {ratio('would_approve_count', 'total_replayed')} AS approval_rate,
  {ratio('false_positives', 'false_positives + true_negatives')} AS fpr, {ratio('false_negatives', 'false_negatives + true_positives')} AS fnr
FROM (SELECT count(*) AS total_replayed, count(decision_type) AS total_with_actual_decision,
  count(*) FILTER (decision_type <> w) AS decisions_changed, count(is_fraud) AS total_with_label,
  count(*) FILTER (w = 'approve') AS would_approve_count, count(*) FILTER (w = 'hard_decline') AS would_decline_count,
  count(*) FILTER (w IN ('manual_review', 'step_up')) AS would_review_count,
  count(*) FILTER (is_fraud AND w <> 'approve') AS true_positives, count(*) FILTER (NOT is_fraud AND w <> 'approve') AS false_positives,
  count(*) FILTER (NOT is_fraud AND w = 'approve') AS true_negatives, count(*) FILTER (is_fraud AND w = 'approve') AS false_negatives
FROM (SELECT *, {by_probability('wp')} AS w FROM replay))""",
    "risk_summary": f"""SELECT s.auth_event_id, model_version, calibrated_probability, risk_band,
  coalesce(d.decision_type, 'unknown') AS decision, array_to_string(reason_codes, ',') AS reason_codes, x.risk_factors
FROM scored s LEFT JOIN latest_decision d USING (auth_event_id) JOIN ({CORE['reason_explain']}) x USING (auth_event_id)""",
    "gather_context": """SELECT case_id, true AS has_transaction, 2 AS score_count, d.auth_event_id IS NOT NULL AS has_decision,
  coalesce(l.n, 0) AS label_count FROM cases c LEFT JOIN latest_decision d USING (auth_event_id)
LEFT JOIN (SELECT auth_event_id, count(*) AS n FROM fraud_labels GROUP BY 1) l USING (auth_event_id)""",
    "score_champion_shadow": """SELECT auth_event_id, model_version, shadow, fraud_probability, calibrated_probability, predicted_label,
  risk_band FROM all_scores""",
    "job_daily": """SELECT 'backfill' AS job, count(*) AS rows_written FROM auth_events WHERE event_time < TIMESTAMP '2024-02-02'
  AND auth_event_id % 7 <> 0
UNION ALL SELECT 'label_snapshot', count(DISTINCT auth_event_id) FROM auth_events e JOIN fraud_labels l USING (auth_event_id)
  WHERE e.event_time < TIMESTAMP '2024-01-27' AND auth_event_id % 9 <> 0 AND l.label_received_at <= TIMESTAMP '2024-02-03'
UNION ALL SELECT 'drift', count(DISTINCT feature) FROM daily_long
UNION ALL SELECT 'shadow', count(*) FROM (SELECT count(*) FROM all_scores
  WHERE event_time >= TIMESTAMP '2024-02-02' AND event_time < TIMESTAMP '2024-02-03')""",
}
ORACLES = {name: sql(body) for name, body in BODIES.items()}
_early = {
    "stored_events": FRAGMENTS["stored_events"] + " WHERE event_time < TIMESTAMP '2024-01-20'",
    "chargebacks": "SELECT * FROM (" + FRAGMENTS["chargebacks"] + ") WHERE chargeback_received_at < TIMESTAMP '2024-01-20'",
}
ORACLES["features_offline"] = sql(f"SELECT auth_event_id, {', '.join(C.FEATURES)} FROM features", _early)
_mature = BODIES["label_snapshot"].replace("is_fraud AS is_fraud_snapshot", "is_fraud").replace(
    " AND e.auth_event_id % 9 <> 0", "")
ORACLES["training_set"] = sql(f"""SELECT auth_event_id, is_fraud, {', '.join(C.FEATURES)},
  ('0x' || substr(md5(CAST(is_fraud::INT AS VARCHAR) || ':' || auth_event_id), 1, 8))::BIGINT % 5 = 0 AS is_test
FROM vectors JOIN ({_mature}) s USING (auth_event_id)""")
_tables = {"economics": "economics_table", "replay": "replay_rows", "model_card": "model_cards"}
_fields = {
    "economics": [(n, f"{n} < 0 OR {n} > 1" if n.endswith("_rate") else "false" if n == "net_fraud_savings_usd" else f"{n} < 0")
                  for n in ("total_transactions", "total_volume_usd", "fraud_transactions", "fraud_volume_usd",
                            "prevented_fraud_usd", "missed_fraud_usd", "false_positive_count", "false_positive_volume_usd",
                            "manual_review_count", "manual_review_cost_usd", "approval_rate", "decline_rate", "review_rate",
                            "challenge_rate", "fraud_basis_points", "net_fraud_savings_usd", "customer_friction_rate")],
    "replay": [("auth_event_id", "false"), ("rules_fired", "false"), ("decision_type", "decision_type = ''"),
               ("decision_correct", "false"), ("time_to_label_seconds", "time_to_label_seconds < 0")],
    "model_card": [("model_version", "model_version = ''"), ("model_type", "false"), ("feature_version", "false"),
                   ("threshold_decline", "threshold_decline < 0 OR threshold_decline > 1"),
                   ("auc_roc", "auc_roc < 0 OR auc_roc > 1"), ("top_importances", "false")],
}
ORACLES["contract_report"] = sql(" UNION ALL ".join(
    f"SELECT '{report}' AS report, '{name}' AS field, count(*) AS n_rows, count(*) FILTER ({name} IS NULL) AS n_null, "
    f"count(*) FILTER ({broken}) AS n_broken FROM {_tables[report]}"
    for report, fields in _fields.items() for name, broken in fields),
    {"economics_table": ECONOMICS_BODIES["economics_summary"], "replay_rows": BODIES["replay_decision"],
     "model_cards": BODIES["model_card"]})
