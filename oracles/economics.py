"""SQL checks: decisions, labels, economics, sweeps and the loss curve. Sweeps are checked by brute force."""

from __future__ import annotations

import oracles.core  # noqa: F401  (its fragments)
from oracles.base import AS_OF, FRAGMENTS, r, ratio, sql
from riskspark.plans.economics import SCREEN_SWEEP, SWEEP, threshold_triples

FRAGMENTS.update({
    "decisions": """SELECT auth_event_id, model_version, final_score, auth_event_id * 2 AS decision_id,
  event_time AS decision_time, decision AS decision_type FROM scored WHERE auth_event_id % 41 <> 0
UNION ALL SELECT auth_event_id, model_version, final_score, auth_event_id * 2 + 1, event_time + INTERVAL 1 HOUR,
  CASE WHEN auth_event_id % 40 = 0 THEN 'soft_decline' ELSE 'allow_with_monitoring' END
FROM scored WHERE auth_event_id % 20 = 0""",
    "latest_label": """SELECT auth_event_id, is_fraud, label_source, label_received_at FROM fraud_labels
QUALIFY row_number() OVER (PARTITION BY auth_event_id ORDER BY label_received_at DESC, label_id DESC) = 1""",
    "latest_decision": """SELECT auth_event_id, decision_type, decision_time FROM decisions
QUALIFY row_number() OVER (PARTITION BY auth_event_id ORDER BY decision_time DESC, decision_id DESC) = 1""",
    "decided": """SELECT s.*, coalesce(nullif(s.billing_amount_usd, 0), s.auth_amount, 0) AS amount_usd, d.decision_type,
  s.auth_event_id IN (SELECT auth_event_id FROM fraud_labels WHERE is_fraud) AS is_fraud,
  coalesce(n.a, 0) AS n_approved, coalesce(n.d, 0) AS n_declined, coalesce(n.r, 0) AS n_review, coalesce(n.s, 0) AS n_step_up
FROM scored s LEFT JOIN latest_decision d USING (auth_event_id) LEFT JOIN (SELECT auth_event_id,
  count(*) FILTER (decision_type IN ('approve', 'allow_with_monitoring')) AS a,
  count(*) FILTER (decision_type LIKE '%decline%') AS d, count(*) FILTER (decision_type = 'manual_review') AS r,
  count(*) FILTER (decision_type = 'step_up') AS s FROM decisions GROUP BY 1) n USING (auth_event_id)""",
    "scored_labelled": """SELECT s.auth_event_id, s.event_time, s.raw_probability AS probability,
  coalesce(nullif(s.billing_amount_usd, 0), s.auth_amount, 0) AS amount_usd, l.is_fraud
FROM scored s LEFT JOIN latest_label l USING (auth_event_id)""",
})


def business(table: str, groups: str = "") -> str:
    stop = "(decision_type IS NULL OR decision_type LIKE '%decline%' OR decision_type = 'manual_review')"
    fp = "(NOT is_fraud AND coalesce(decision_type LIKE '%decline%', false))"
    lead = f"{groups}, " if groups else ""
    tail = f" GROUP BY {groups}" if groups else ""
    return f"""SELECT {lead}n AS total_transactions, {r('volume', 2)} AS total_volume_usd, fraud_transactions,
  {r('fraud', 2)} AS fraud_volume_usd, {r('prevented', 2)} AS prevented_fraud_usd, {r('fraud - prevented', 2)} AS missed_fraud_usd,
  false_positive_count, {r('fp_usd', 2)} AS false_positive_volume_usd, reviews AS manual_review_count,
  CAST(reviews * 15 AS DOUBLE) AS manual_review_cost_usd, {ratio('approved', 'n')} AS approval_rate,
  {ratio('declined', 'n')} AS decline_rate, {ratio('reviews', 'n')} AS review_rate, {ratio('stepped', 'n')} AS challenge_rate,
  {ratio('fraud * 10000', 'volume')} AS fraud_basis_points,
  {r('prevented - fp_usd - reviews * 15', 2)} AS net_fraud_savings_usd,
  {ratio('declined + stepped + reviews', 'n')} AS customer_friction_rate
FROM (SELECT {lead}count(*) AS n, CAST(sum(amount_usd) AS DOUBLE) AS volume, count(*) FILTER (is_fraud) AS fraud_transactions,
  CAST(coalesce(sum(amount_usd) FILTER (is_fraud), 0) AS DOUBLE) AS fraud,
  CAST(coalesce(sum(amount_usd) FILTER (is_fraud AND {stop}), 0) AS DOUBLE) AS prevented,
  count(*) FILTER ({fp}) AS false_positive_count, CAST(coalesce(sum(amount_usd) FILTER ({fp}), 0) AS DOUBLE) AS fp_usd,
  CAST(sum(n_review) AS BIGINT) AS reviews, CAST(sum(n_approved) AS BIGINT) AS approved,
  CAST(sum(n_declined) AS BIGINT) AS declined, CAST(sum(n_step_up) AS BIGINT) AS stepped FROM {table}{tail})"""


def sweep(rows: str, thresholds: list[float]) -> str:
    listed = ", ".join(f"({t!r}::DOUBLE)" for t in thresholds)
    return f"""SELECT t.threshold, count(*) AS n, count(*) FILTER (p >= threshold AND f) AS tp,
  count(*) FILTER (p >= threshold AND NOT f) AS fp, count(*) FILTER (p < threshold AND f) AS fn,
  count(*) FILTER (p < threshold AND NOT f) AS tn,
  CAST(coalesce(sum(amount_usd) FILTER (p >= threshold AND f), 0) AS DOUBLE) AS prevented,
  CAST(coalesce(sum(amount_usd) FILTER (p < threshold AND f), 0) AS DOUBLE) AS missed,
  CAST(coalesce(sum(amount_usd) FILTER (p >= threshold AND NOT f), 0) AS DOUBLE) AS fp_usd
FROM (VALUES {listed}) t(threshold) CROSS JOIN
  (SELECT *, probability AS p, coalesce(is_fraud, false) AS f FROM {rows}) s GROUP BY t.threshold"""


FRAGMENTS["screen_sweep"] = sweep("scored_labelled", SCREEN_SWEEP)
FRAGMENTS["line_sweep"] = sweep("scored_lines", SWEEP)
FRAGMENTS["line_costs"] = f"""SELECT *, missed + fp_usd * 0.1::DOUBLE + (tp + fp) * 15.0::DOUBLE AS cost,
  {ratio('fn + tn', 'n')} AS approval, {ratio('fp', 'fp + tn')} AS fpr FROM line_sweep"""
FRAGMENTS["triples"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {d!r}::DOUBLE, {v!r}::DOUBLE, {s!r}::DOUBLE)" for i, (d, v, s) in enumerate(threshold_triples())
) + ") t(i, d, v, s)"
FRAGMENTS["line_groups"] = """SELECT probability AS p, count(*) AS n, CAST(coalesce(sum(amount_usd) FILTER (is_fraud), 0) AS DOUBLE) AS f,
  CAST(coalesce(sum(amount_usd) FILTER (NOT is_fraud), 0) AS DOUBLE) AS g FROM scored_lines GROUP BY 1"""
_economics = f"""SELECT threshold, {ratio('fn + tn', 'n')} AS approval_rate, {ratio('tp + fp', 'n')} AS decline_rate,
  {ratio('fp', 'fp + tn')} AS false_positive_rate, {ratio('fn', 'tp + fn')} AS missed_fraud_rate,
  {r('prevented - fp_usd - (tp + fp) * 15.0::DOUBLE', 2)} AS net_savings FROM screen_sweep"""
FRAGMENTS["screen_economics"] = _economics

_window = "event_time >= TIMESTAMP '2024-01-08' AND event_time < TIMESTAMP '2024-01-22'"
BODIES = {
    "economics_summary": business("decided"),
    "economics_by_segment": business(
        """(SELECT d.*, 'country' AS segment_by, coalesce(merchant_country_code, '_unknown') AS segment_value FROM decided d
UNION ALL SELECT d.*, 'channel', coalesce(channel, '_unknown') FROM decided d
UNION ALL SELECT d.*, 'auth_type', coalesce(auth_type, '_unknown') FROM decided d
UNION ALL SELECT d.*, 'mcc', m.mcc FROM decided d JOIN dim_merchant m USING (merchant_id)
UNION ALL SELECT d.*, 'risk_band', risk_band FROM decided d)""", "segment_by, segment_value"),
    "threshold_economics": "SELECT * FROM screen_economics",
    "threshold_optimize": f"""SELECT threshold, {r('prevented - cost', 2)} AS net_savings_usd, {r('prevented', 2)} AS prevented_fraud_usd,
  {r('missed', 2)} AS missed_fraud_usd, {r('fp_usd', 2)} AS fp_volume_usd, {r('cost', 2)} AS business_cost_usd,
  approval AS approval_rate, fpr AS false_positive_rate, {ratio('fn', 'fn + tp')} AS missed_fraud_rate,
  {ratio('tp', 'tp + fn')} AS fraud_caught_pct, tp + fp AS review_load, tp, fp, fn, tn,
  approval >= 0.9 AND fpr <= 0.05 AS meets_constraints, row_number() OVER (ORDER BY approval >= 0.9 AND fpr <= 0.05 DESC,
    {r('prevented - cost', 2)} DESC, threshold) = 1 AS is_optimal FROM line_costs""",
    "threshold_multi": f"""SELECT d AS decline_threshold, v AS review_threshold, s AS step_up_threshold, net_savings_usd FROM (
SELECT i, d, v, s, sum(CASE WHEN p < d AND p < v AND p < s THEN n ELSE 0 END) / sum(n) AS approval,
  {r('''sum(CASE WHEN p >= d OR p >= v THEN f ELSE 0 END) - (sum(CASE WHEN p < d AND p < v AND p < s THEN f ELSE 0 END)
  + sum(CASE WHEN p < d AND p < v AND p >= s THEN f ELSE 0 END) * 0.3 + sum(CASE WHEN p >= d OR p >= v THEN g ELSE 0 END) * 0.1
  + sum(CASE WHEN p < d AND p >= v THEN n ELSE 0 END) * 15)''', 2)} AS net_savings_usd
FROM triples CROSS JOIN line_groups GROUP BY i, d, v, s) WHERE approval >= 0.9 ORDER BY net_savings_usd DESC, i LIMIT 1""",
    "best_threshold_ui": """SELECT threshold AS optimal_threshold, net_savings FROM screen_economics
ORDER BY net_savings DESC, threshold LIMIT 1""",
    "loss_curve": f"""SELECT d AS decile, {r('coalesce(sum(amount_usd) FILTER (rank <= cut AND is_fraud), 0)', 2)} AS cumulative_fraud_caught_usd,
  count(*) FILTER (rank <= cut AND is_fraud = false) AS cumulative_false_positives,
  count(*) FILTER (rank <= cut) AS cumulative_review_load
FROM (SELECT *, row_number() OVER (ORDER BY probability DESC, auth_event_id) AS rank FROM scored_labelled) s
CROSS JOIN (SELECT d, floor((SELECT count(*) FROM scored_labelled) * (d / 10.0::DOUBLE)) AS cut FROM range(1, 11) t(d))
GROUP BY d""",
    "j_chargeback_event": """SELECT e.merchant_id, count(*) AS n_chargebacks, CAST(sum(c.chargeback_amount) AS DECIMAL(18,2)) AS amount
FROM chargebacks c JOIN stored_events e USING (auth_event_id) GROUP BY 1""",
    "j_merchant_mcc": "SELECT e.auth_event_id, m.mcc FROM stored_events e JOIN dim_merchant m USING (merchant_id)",
    "j_score_event": f"""SELECT auth_event_id, model_version, calibrated_probability, auth_amount FROM all_scores
WHERE NOT shadow AND event_time >= TIMESTAMP '2024-01-01' AND event_time < {AS_OF}""",
    "j_fraud_semi": """SELECT auth_event_id, customer_id, auth_amount FROM stored_events
WHERE auth_event_id IN (SELECT auth_event_id FROM fraud_labels WHERE is_fraud)""",
    "j_nonfraud_anti": """SELECT auth_event_id, customer_id, auth_amount FROM stored_events
WHERE auth_event_id NOT IN (SELECT auth_event_id FROM fraud_labels WHERE is_fraud)""",
    "j_decision_left": """SELECT e.auth_event_id, d.decision_type, d.decision_time FROM stored_events e
LEFT JOIN latest_decision d USING (auth_event_id)""",
    "j_label_asof": """SELECT e.auth_event_id, l.is_fraud, l.label_received_at FROM stored_events e JOIN (
SELECT * FROM fraud_labels WHERE label_received_at <= TIMESTAMP '2024-03-15' QUALIFY row_number() OVER (
  PARTITION BY auth_event_id ORDER BY label_received_at DESC, label_id DESC) = 1) l USING (auth_event_id)""",
    "j_champion_score": """SELECT auth_event_id, model_version, fraud_probability, calibrated_probability, risk_band
FROM all_scores QUALIFY row_number() OVER (PARTITION BY auth_event_id ORDER BY shadow, event_time, model_version) = 1""",
    "j_prev_txn_asof": """SELECT auth_event_id, prev_time, prev_ip FROM velocity""",
    "j_range_velocity": """SELECT a.auth_event_id, count(*) AS n_1h FROM stored_events a JOIN stored_events b
  ON a.customer_id = b.customer_id AND b.event_time BETWEEN a.event_time - INTERVAL 1 HOUR AND a.event_time
GROUP BY 1""",
    "j_threshold_cross": "SELECT threshold, tp, fp, fn, tn FROM line_sweep",
    "j_dim_star": """SELECT e.auth_event_id, d.emulator_flag, i.geo_country_code, h.home_country_code FROM stored_events e
LEFT JOIN dim_device d USING (device_id) LEFT JOIN dim_ip i USING (ip_address) LEFT JOIN dim_customer h USING (customer_id)""",
}
BODIES["economics_by_segment_window"] = BODIES["economics_by_segment"].replace(
    "FROM decided d", f"FROM (SELECT * FROM decided WHERE {_window}) d")
BODIES["loss_curve_window"] = BODIES["loss_curve"].replace(
    "FROM scored_labelled", f"FROM (SELECT * FROM scored_labelled WHERE {_window})")
ORACLES = {name: sql(body) for name, body in BODIES.items()}
