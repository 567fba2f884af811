"""SQL checks: sources, contracts, scalar expressions, scoring, searches and queues."""

from __future__ import annotations

from oracles.base import (
    AS_OF, FRAGMENTS, RULE_SQL, VECTOR, by_probability, heuristic, haversine, r, ratio, sigmoid, sql, band,
)
from riskspark import constants as C



def _json_number(name: str) -> str:
    """A feature as JSON text. Ratios and rates have four decimals, and below a thousandth they are written as 3.0E-4."""
    plain = f"CAST({name} AS VARCHAR)"
    if not name.endswith(("_ratio", "_rate_30d")):
        return plain
    return f"CASE WHEN {name} > 0 AND {name} < 0.001 THEN CAST(round({name} * 10000) AS INT) || '.0E-4' ELSE {plain} END"


FRAGMENTS.update({
    "model_versions": "SELECT * FROM (VALUES ('xgb-v4.2.0', false), ('lgb-v5.0.0-rc1', true)) v(model_version, shadow)",
    "all_scores": f"""SELECT * REPLACE ({r('fraud_probability', 6)} AS fraud_probability,
  {r('calibrated_probability', 6)} AS calibrated_probability), calibrated_probability AS raw_probability, calibrated_probability >= 0.55::DOUBLE AS predicted_label,
  {band('calibrated_probability')} AS risk_band FROM (SELECT *, {sigmoid('fraud_probability')} AS calibrated_probability
FROM (SELECT v.*, m.model_version, m.shadow, {heuristic('m.model_version')} AS fraud_probability
FROM vectors v CROSS JOIN model_versions m))""",
    "cases": """SELECT auth_event_id AS case_id, auth_event_id, CASE auth_event_id % 4 WHEN 1 THEN 'in_progress'
  WHEN 2 THEN 'closed' ELSE 'open' END AS case_status, queue_name, priority,
  'auto_review: score=' || printf('%.4f', floor(final_score * 10000 + 0.5) / 10000) AS created_reason,
  event_time AS created_at
FROM scored WHERE decision = 'manual_review'""",
    "audit_events": """SELECT auth_event_id * 2 AS audit_id, 'authorization' AS entity_type,
  CAST(auth_event_id AS VARCHAR) AS entity_id, 'decision_made' AS event_type, decision, event_time AS created_at FROM scored
UNION ALL SELECT auth_event_id * 2 + 1, 'case', CAST(auth_event_id AS VARCHAR), 'case_created', decision, event_time
FROM scored WHERE decision = 'manual_review'""",
})

_rules = " UNION ALL ".join(
    f"SELECT auth_event_id, '{i}' AS rule_id, '{n}' AS rule_name, '{s}' AS severity, ({c}) AS fired, "
    f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END AS contribution_score, CASE WHEN {c} THEN {t} ELSE '' END AS explanation "
    f"FROM vectors" for i, n, s, _, c, t in RULE_SQL)
_contributions = " UNION ALL ".join(
    f"SELECT auth_event_id, '{n}' AS feature, {r(f'{n} * 0.1::DOUBLE', 6)} AS contribution FROM vectors"
    for n in C.FEATURES)
_texts = "[" + ", ".join("'" + k + "'" for k in C.REASON_TEXTS) + "]", \
    "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in C.REASON_TEXTS.values()) + "]"
_auth_checks = [(f, "required", f"{f} IS NULL")
                for f in ("transaction_id", "account_id", "card_id", "customer_id", "merchant_id")] + [
    ("auth_type", "not allowed", "auth_type NOT IN ('card_present', 'card_not_present', 'recurring')"),
    ("channel", "not allowed", "channel NOT IN ('pos', 'web', 'mobile', 'api')"),
    ("auth_amount", "must be positive", "auth_amount IS NULL OR auth_amount <= 0"),
    ("currency_code", "must have 3 characters", "currency_code IS NULL OR length(currency_code) <> 3"),
    ("merchant_country_code", "must have 2 characters",
     "merchant_country_code IS NULL OR length(merchant_country_code) <> 2")]
_vector_checks = [(f, "must be at least 0", f"{f} < 0") for f in C.FEATURES if f != "proxy_vpn_tor_flag"] + [
    (f, "must be at most 1", f"{f} > 1") for f in C.UNIT_RANGE_FEATURES]


def _validated(table: str, checks) -> str:
    found = ", ".join(f"CASE WHEN {test} THEN '{field}: {message}' END" for field, message, test in checks)
    return (f"SELECT auth_event_id, errors = '' AS valid, errors FROM "
            f"(SELECT auth_event_id, concat_ws('; ', {found}) AS errors FROM {table})")


_lifecycle = """SELECT s.auth_event_id, s.transaction_id, s.event_time, l.step,
  coalesce(l.event_type, s.decision) AS event_type, 'system' AS actor_type, l.actor_id
FROM scored s CROSS JOIN (VALUES (0, 'auth_received', 'scoring_service'), (1, 'features_built', 'feature_service'),
  (2, 'rules_scored', 'rules_engine'), (3, 'model_scored', 'model_scorer'), (4, NULL, 'scoring_service'))
  l(step, event_type, actor_id)"""
FRAGMENTS["lifecycle"] = _lifecycle
_search = "auth_status = 'review' AND billing_amount_usd >= 20 AND event_time >= TIMESTAMP '2024-01-05'"
_context = """concat_ws(chr(10), 'Case ID: ' || c.case_id, 'Status: ' || c.case_status,
  'Amount: ' || s.auth_amount || ' ' || s.currency_code, 'Channel: ' || s.channel, 'Auth Type: ' || s.auth_type,
  'Fraud Probability: ' || printf('%.6f', s.fraud_probability), 'Risk Band: ' || s.risk_band,
  'Reason Codes: ' || array_to_string(s.reason_codes, ', '), 'Decision: ' || s.decision, l.label_text)"""
FRAGMENTS["label_lines"] = """SELECT auth_event_id, count(*) AS label_count, string_agg('Label: fraud=' ||
  CAST(is_fraud AS VARCHAR) || ', source=' || label_source, chr(10) ORDER BY label_received_at, label_id) AS label_text
FROM fraud_labels GROUP BY auth_event_id"""

BODIES = {
    "src_parquet": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "src_auth_events": "SELECT * FROM stored_events",
    "src_clearing": """SELECT e.auth_event_id, event_time + INTERVAL 1 DAY AS clearing_time, auth_amount AS clearing_amount,
  'settled' AS settlement_status, transaction_id, currency_code FROM auth_events e WHERE event_type = 'purchase'""",
    "src_chargeback": """SELECT 'case' AS record, CAST(chargeback_id AS VARCHAR) AS key, 'chargeback' AS event_type,
  chargeback_received_at AS event_time, chargeback_amount AS amount FROM chargebacks
UNION ALL SELECT 'lifecycle', CAST(auth_event_id AS VARCHAR), 'chargeback_received', chargeback_received_at, NULL
FROM chargebacks
UNION ALL SELECT 'audit', CAST(chargeback_id AS VARCHAR), 'chargeback_ingested', chargeback_received_at, NULL
FROM chargebacks""",
    "src_label": """SELECT label_id, auth_event_id, is_fraud, label_source, label_received_at,
  CAST(label_received_at AS DATE) AS effective_label_date,
  CASE WHEN label_source = 'investigator_confirmed' THEN 'investigator' ELSE 'system' END AS actor_type,
  CASE WHEN label_source = 'investigator_confirmed' THEN 'inv_' || (label_id % 7) ELSE 'label_service' END AS actor_id
FROM fraud_labels""",
    "upsert_customer": """SELECT coalesce(c.customer_id, u.user_id) AS customer_id,
  CASE WHEN c.customer_id IS NULL THEN 'US' ELSE c.home_country_code END AS home_country_code, c.home_region,
  CASE WHEN u.user_id IS NULL THEN 'pending' WHEN u.event_type = 'error' THEN 'rejected' ELSE 'verified' END AS kyc_status,
  CASE WHEN u.value > 100 THEN 'high' ELSE 'low' END AS risk_segment, u.ts AS updated_at
FROM dim_customer c FULL JOIN (SELECT * FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) u ON u.user_id = c.customer_id""",
    "upsert_device": """SELECT coalesce(d.device_id, u.device_id) AS device_id, coalesce(d.emulator_flag, false) AS emulator_flag,
  coalesce(d.rooted_jailbroken_flag, false) AS rooted_jailbroken_flag, u.fp AS device_fingerprint,
  CASE WHEN d.device_id IS NULL THEN u.event_time END AS first_seen_at, u.event_time AS last_seen_at
FROM dim_device d FULL JOIN (SELECT device_id, event_time, 'fp_' || (auth_event_id % 5) AS fp FROM auth_events
  WHERE device_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_time DESC, auth_event_id DESC) = 1) u
  ON u.device_id = d.device_id""",
    "sink_append": """SELECT entity_type, event_type, count(*) AS n FROM audit_events GROUP BY ALL
UNION ALL SELECT 'chargeback', 'chargeback_ingested', count(*) FROM chargebacks""",
    "lifecycle_log": "SELECT * FROM lifecycle",
    "contract_auth_event": _validated("auth_events", _auth_checks),
    "contract_feature_vector": _validated("vectors", _vector_checks),
    "contract_model_score": "SELECT auth_event_id, true AS valid, '' AS errors FROM scored WHERE "
                            "fraud_probability BETWEEN 0 AND 1 AND calibrated_probability BETWEEN 0 AND 1",
    "fx_to_usd": f"""SELECT auth_event_id, currency_code,
  {r('CAST(auth_amount AS DOUBLE) * coalesce(usd_rate, 1)', 6)} AS amount_usd
FROM auth_events e LEFT JOIN fx_rates f ON f.currency = upper(trim(coalesce(e.currency_code, 'USD')))""",
    "fx_cross_rate": f"""SELECT auth_event_id, currency_code, merchant_currency,
  {r('coalesce(b.usd_rate, 1) / coalesce(a.usd_rate, 1)', 6)} AS rate_ratio
FROM (SELECT *, CASE merchant_country_code WHEN 'GB' THEN 'gbp ' WHEN 'DE' THEN ' eur' WHEN 'US' THEN 'USD' END
  AS merchant_currency FROM auth_events) e LEFT JOIN fx_rates a ON a.currency = upper(trim(coalesce(e.currency_code, 'USD')))
LEFT JOIN fx_rates b ON b.currency = upper(trim(coalesce(e.merchant_currency, 'USD')))""",
    "geo_lookup": """SELECT 'ip' AS source, ip_address AS key, lat, lon FROM ip_places
UNION ALL SELECT 'home', CAST(customer_id AS VARCHAR), lat, lon FROM home_places""",
    "haversine_km": f"""SELECT auth_event_id, {r(haversine('h.lat', 'h.lon', 'i.lat', 'i.lon'), 3)} AS km
FROM stored_events e LEFT JOIN ip_places i USING (ip_address) LEFT JOIN home_places h USING (customer_id)""",
    "device_risk": "SELECT auth_event_id, device_id, device_risk_score FROM features",
    "ip_flags": "SELECT auth_event_id, ip_address, proxy_vpn_tor_flag FROM features",
    "scoring_vector": f"SELECT auth_event_id, {VECTOR} FROM features",
    "case_vector_store": """SELECT md5(CAST(vec_id AS VARCHAR)) AS point_id, vec_id AS case_id, label AS category,
  CAST(len(embedding) AS INTEGER) AS dimensions FROM embeddings""",
    # Null fields are left out, as array_to_string does.
    "feature_json": "SELECT auth_event_id, '{{' || array_to_string([{0}], ',') || '}}' AS feature_json FROM features".format(
        ", ".join(f"""'"{n}":' || {_json_number(n)}""" for n in C.FEATURES)),
    "json_vector": f"SELECT auth_event_id, {VECTOR} FROM features",
    "rules_eval": _rules,
    "rules_score": "SELECT auth_event_id, rule_score, high_rule_fired FROM scores",
    "heuristic_score": "SELECT auth_event_id, model_version, fraud_probability FROM all_scores",
    "calibrate_sigmoid": "SELECT auth_event_id, fraud_probability, calibrated_probability FROM scores",
    "risk_band": "SELECT auth_event_id, calibrated_probability, risk_band FROM scored",
    "reason_codes": "SELECT auth_event_id, array_to_string(reason_codes, ',') AS reason_codes FROM scored",
    "reason_explain": f"""SELECT auth_event_id, string_agg(coalesce({_texts[1]}[list_position({_texts[0]}, code)],
  'Risk indicator: ' || code), ' | ' ORDER BY i) AS risk_factors
FROM (SELECT auth_event_id, unnest(reason_codes) AS code, unnest(range(len(reason_codes))) AS i FROM scored)
GROUP BY auth_event_id""",
    "feature_contrib": _contributions,
    "blend_score": "SELECT auth_event_id, calibrated_probability, rule_score, final_score FROM scored",
    "decide": "SELECT auth_event_id, final_score, decision FROM scored",
    "auth_status": "SELECT auth_event_id, decision, auth_status FROM scored",
    "case_routing": """SELECT case_id, auth_event_id, 'open' AS case_status, queue_name, priority, created_reason, created_at
FROM cases""",
    "threshold_decision": f"""SELECT auth_event_id, model_version, CASE WHEN shadow THEN
  {by_probability('raw_probability', '0.60', '0.45', '0.30')} ELSE {by_probability('raw_probability')} END
  AS decision FROM all_scores""",
    "recommend_action": """SELECT c.case_id, s.calibrated_probability,
  CASE WHEN raw_probability >= 0.85 THEN 'CONFIRM_FRAUD' WHEN raw_probability >= 0.65 THEN 'ESCALATE'
    WHEN raw_probability >= 0.4 THEN 'GATHER_MORE_INFO' ELSE 'CLOSE_NOT_FRAUD' END AS recommendation,
  CASE WHEN raw_probability >= 0.85 THEN 0.9 WHEN raw_probability >= 0.65 THEN 0.7
    WHEN raw_probability >= 0.4 THEN 0.6 ELSE 0.8 END AS confidence
FROM cases c JOIN all_scores s ON s.auth_event_id = c.auth_event_id AND NOT s.shadow""",
    "case_context_text": f"""SELECT c.case_id, {_context} AS context_text FROM cases c JOIN scored s USING (auth_event_id)
LEFT JOIN label_lines l USING (auth_event_id)""",
    "search_transactions": f"""SELECT auth_event_id, customer_id, merchant_id, billing_amount_usd, auth_status, event_time,
  (SELECT count(*) FROM scored WHERE {_search}) AS total
FROM scored WHERE {_search} ORDER BY auth_event_id DESC LIMIT 50 OFFSET 10""",
    "audit_trail": """SELECT * FROM audit_events WHERE entity_type = 'case' ORDER BY created_at DESC, audit_id DESC
LIMIT 100""",
    "agent_traces": """SELECT conv_id AS case_id, turn AS step_index, role AS step_type, length(text) AS output_length
FROM conversations""",
    "features_get": f"""SELECT auth_event_id, {', '.join(C.FEATURES)} FROM features
WHERE auth_event_id IN (SELECT auth_event_id FROM chargebacks)""",
    "case_review": """SELECT c.case_id, coalesce(a.decision, c.case_status) AS case_status, a.action_time AS updated_at,
  a.action_time AS closed_at, a.reviewer_id, coalesce(n.n, 0) AS n_reviews
FROM cases c LEFT JOIN (SELECT auth_event_id AS case_id, label_received_at AS action_time, label_source AS reviewer_id,
    CASE WHEN is_fraud THEN 'resolved_fraud' ELSE 'resolved_not_fraud' END AS decision FROM fraud_labels
  QUALIFY row_number() OVER (PARTITION BY auth_event_id ORDER BY label_received_at DESC, label_id DESC) = 1) a
  USING (case_id)
LEFT JOIN (SELECT auth_event_id AS case_id, count(*) AS n FROM fraud_labels GROUP BY 1) n USING (case_id)""",
    "case_create": """SELECT auth_event_id AS case_id, auth_event_id, 'open' AS case_status, 'general' AS queue_name,
  'medium' AS priority, 'chargeback' AS created_reason, chargeback_received_at AS created_at
FROM chargebacks WHERE auth_event_id NOT IN (SELECT auth_event_id FROM cases)""",
    "features_online": f"SELECT auth_event_id, event_time AS feature_timestamp, {', '.join(C.FEATURES)} FROM features",
    "score_events": """SELECT auth_event_id, transaction_id, event_time, fraud_probability, calibrated_probability, risk_band,
  rule_score, final_score, decision, auth_status, queue_name, priority, model_version,
  array_to_string(reason_codes, ',') AS reason_codes FROM scored""",
    "case_queue": """SELECT case_id, queue_name, priority, created_at, rank FROM (SELECT *, CASE priority
  WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS rank FROM cases WHERE case_status = 'open')
ORDER BY rank, created_at, case_id LIMIT 50""",
    "page_keyset": """SELECT *, count(*) OVER () = 50 AS has_more, min(auth_event_id) OVER () AS next_cursor FROM (
SELECT auth_event_id, customer_id, auth_amount, event_time FROM stored_events
WHERE auth_event_id < (SELECT max(auth_event_id) FROM stored_events) ORDER BY auth_event_id DESC LIMIT 50)""",
    "recent_decisions": """SELECT auth_event_id, customer_id, billing_amount_usd, decision, risk_band, final_score FROM scored
ORDER BY auth_event_id DESC LIMIT 10""",
    "queue_summary": """SELECT queue_name, count(*) FILTER (case_status = 'open') AS open,
  count(*) FILTER (case_status = 'in_progress') AS in_progress, count(*) FILTER (case_status = 'closed') AS closed,
  count(*) FILTER (coalesce(case_status, '') NOT IN ('open', 'in_progress', 'closed')) AS other,
  count(*) AS total FROM cases GROUP BY queue_name""",
    "queue_age": f"""SELECT queue_name, count(*) FILTER (case_status = 'open') AS open_count,
  count(*) FILTER (case_status = 'in_progress') AS in_progress_count,
  {r("CAST(sum(age) FILTER (case_status <> 'closed') AS DOUBLE) / count(*) FILTER (case_status <> 'closed') / 3.6e9", 4)}
    AS avg_age_hours,
  {r("CAST(max(age) FILTER (case_status <> 'closed') AS DOUBLE) / 3.6e9", 4)} AS oldest_case_hours
FROM (SELECT *, epoch_us({AS_OF}) - epoch_us(created_at) AS age FROM cases) GROUP BY queue_name""",
    "ops_summary": f"""SELECT *, {ratio('total_declines', 'greatest(total_transactions, 1)')} AS decline_rate,
  {ratio('total_reviews', 'greatest(total_transactions, 1)')} AS review_rate FROM (
SELECT count(*) AS total_transactions, count(*) FILTER (decision IN ('decline', 'hard_decline')) AS total_declines,
  count(*) FILTER (decision = 'manual_review') AS total_reviews,
  (SELECT count(*) FROM fraud_labels WHERE is_fraud AND label_received_at >= {AS_OF} - INTERVAL 1 DAY) AS confirmed_fraud,
  (SELECT count(*) FROM cases WHERE case_status <> 'closed') AS open_cases
FROM scored WHERE event_time >= {AS_OF} - INTERVAL 1 DAY)""",
}
ORACLES = {name: sql(body) for name, body in BODIES.items()}
