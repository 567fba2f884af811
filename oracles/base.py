"""Named SQL fragments for the DuckDB checks. `sql(body)` puts every fragment the body mentions in front of it."""

from __future__ import annotations

import re

from riskspark import constants as C

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def r(expression: str, digits: int) -> str:
    """Round half up in plain double arithmetic, as the jobs do."""
    return f"(floor(CAST({expression} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits})"


def ratio(numerator: str, denominator: str, digits: int = 6) -> str:
    return r(f"coalesce(CAST({numerator} AS DOUBLE) / nullif(CAST({denominator} AS DOUBLE), 0), 0)", digits)


def values(rows, names: str) -> str:
    def literal(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


def haversine(lat1, lon1, lat2, lon2) -> str:
    chord = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
             f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2 * 6371.0 * atan2(sqrt({chord}), sqrt(1 - {chord})))"


def over(key: str, horizon: str) -> str:
    return (f"OVER (PARTITION BY {key} ORDER BY event_time RANGE BETWEEN INTERVAL {horizon} PRECEDING "
            "AND CURRENT ROW)")


def coordinates(table: str, country: str, place: str) -> str:
    return f"""SELECT d.*, coalesce(g1.lat, g2.lat) AS lat, coalesce(g1.lon, g2.lon) AS lon FROM {table} d
LEFT JOIN gazetteer g1 ON g1.country = trim(upper(coalesce({country}, '')))
  AND g1.place = substr(trim(upper(coalesce({place}, ''))), 1, 50)
LEFT JOIN gazetteer g2 ON g2.country = trim(upper(coalesce({country}, ''))) AND g2.place = ''"""


def heuristic(version: str) -> str:
    terms = []
    for name, weight, point in C.HEURISTIC_TERMS:
        level = f"({name} / CAST({point} AS DOUBLE))"
        shape = f"greatest(0.0::DOUBLE, 1.0::DOUBLE - {level})" if weight < 0 else f"least({level}, 1.0::DOUBLE)"
        terms.append(f"CAST({weight} AS DOUBLE) * {shape}")
    total = "0.0::DOUBLE"
    for term in terms:
        total = f"({total} + {term})"
    noise = f"(CAST(('0x' || substr(md5({version}), 1, 4))::INT AS DOUBLE) / 65535.0::DOUBLE * 0.02::DOUBLE)"
    return f"greatest(0.01::DOUBLE, least(0.99::DOUBLE, {total} + {noise}))"


def sigmoid(raw: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-5.0::DOUBLE * ({raw} - 0.5::DOUBLE))))"


def band(p: str) -> str:
    tests = " ".join(f"WHEN {p} >= {cut}::DOUBLE THEN '{name}'" for cut, name in C.RISK_BANDS)
    return f"(CASE {tests} ELSE '{C.LOWEST_BAND}' END)"


def by_probability(p: str, decline="0.85", review="0.55", step_up="0.35") -> str:
    return (f"(CASE WHEN {p} >= {decline}::DOUBLE THEN 'hard_decline' WHEN {p} >= {review}::DOUBLE "
            f"THEN 'manual_review' WHEN {p} >= {step_up}::DOUBLE THEN 'step_up' ELSE 'approve' END)")


RULE_SQL = [
    ("R001", "high_velocity_card_10m", "high", 0.3, "card_txn_count_10m >= 5",
     "'Card used ' || CAST(card_txn_count_10m AS BIGINT) || ' times in 10 minutes'"),
    ("R002", "multi_account_device_30d", "high", 0.3, "device_account_count_30d >= 3",
     "'Device linked to ' || CAST(device_account_count_30d AS BIGINT) || ' accounts in 30 days'"),
    ("R003", "vpn_proxy_tor", "medium", 0.15, "proxy_vpn_tor_flag >= 1", "'Transaction originated from VPN/proxy/Tor'"),
    ("R004", "amount_exceeds_3x_p95", "medium", 0.15, "amount_vs_customer_p95_ratio > 3.0",
     "'Amount is ' || printf('%.1f', floor(amount_vs_customer_p95_ratio * 10 + 0.5) / 10) || 'x customer''s p95'"),
    ("R005", "multi_card_ip_7d", "high", 0.3, "ip_card_count_7d >= 5",
     "'IP used with ' || CAST(ip_card_count_7d AS BIGINT) || ' different cards in 7 days'"),
    ("R006", "rapid_fire_under_30s", "high", 0.3, "coalesce(nullif(seconds_since_last_txn, 0) < 30, false)",
     "'Only ' || CAST(seconds_since_last_txn AS BIGINT) || 's since last transaction'"),
    ("R007", "emulator_rooted_device", "medium", 0.15, "device_risk_score >= 0.4::DOUBLE",
     "'Device risk score is ' || printf('%.2f', floor(device_risk_score * 100 + 0.5) / 100) || ' (emulator/rooted)'"),
    ("R008", "high_spend_24h", "low", 0.05, "customer_spend_24h > 5000",
     "'Customer spent $' || printf('%.0f', floor(customer_spend_24h + 0.5)) || ' in 24h'"),
]


def rule_score_sql() -> str:
    total = "0.0::DOUBLE"
    for rule in RULE_SQL:
        total = f"({total} + CASE WHEN {rule[4]} THEN {rule[3]}::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"least({r(total, 4)}, 1.0::DOUBLE)"


HIGH_FIRED = "(" + " OR ".join(rule[4] for rule in RULE_SQL if rule[2] == "high") + ")"

REASON_SQL = [
    ("HIGH_CARD_VELOCITY", "card_txn_count_10m >= 5"),
    ("MULTI_ACCOUNT_DEVICE", "device_account_count_30d >= 3"),
    ("MULTI_CARD_IP", "ip_card_count_7d >= 5"),
    ("VPN_PROXY_TOR", "proxy_vpn_tor_flag >= 1"),
    ("UNUSUAL_AMOUNT", "amount_vs_customer_p95_ratio > 3"),
    ("RAPID_FIRE", "nullif(seconds_since_last_txn, 0) < 30"),
    ("RISKY_DEVICE", "device_risk_score >= 0.4::DOUBLE"),
    ("FRAUD_RING_PROXIMITY", "graph_cluster_risk_score > 0.5"),
    ("GEO_ANOMALY", "geo_distance_from_home_km > 5000"),
    ("HIGH_RISK_MERCHANT", "merchant_chargeback_rate_30d > 0.05::DOUBLE"),
]
_reasons = "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in REASON_SQL) + \
    "], lambda x: x IS NOT NULL)"
REASON_CODES = f"(CASE WHEN len({_reasons}) = 0 THEN ['BASELINE_RISK'] ELSE list_slice({_reasons}, 1, 5) END)"

VECTOR = ", ".join(f"coalesce(CAST({name} AS DOUBLE), 0) AS {name}" for name in C.FEATURES)
OTHERS = "auth_event_id, transaction_id, event_time, customer_id, account_id, card_id, merchant_id, device_id, ip_address, auth_type, " \
    "channel, auth_amount, currency_code, merchant_country_code, billing_amount_usd, event_type"

FRAGMENTS = {
    "auth_events": """SELECT event_id AS auth_event_id, event_id AS transaction_id, ts AS event_time,
       user_id AS customer_id,
       user_id * 10 + event_id % 3 AS account_id,
       (user_id * 10 + event_id % 3) * 100 + event_id % 5 AS card_id,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS merchant_id,
       CASE WHEN event_id % 11 = 0 THEN NULL
            ELSE concat('dev_', CAST(CAST(floor(user_id / 4) AS BIGINT) AS VARCHAR(20))) END AS device_id,
       CASE WHEN event_id % 17 = 0 THEN NULL
            ELSE concat('10.0.', CAST(CAST(floor(user_id / 1536) AS BIGINT) AS VARCHAR(20)), '.',
                        CAST(CAST(floor(user_id / 6) AS BIGINT) % 256 AS VARCHAR(20))) END AS ip_address,
       CASE event_type WHEN 'click' THEN 'card_present' WHEN 'signup' THEN 'recurring'
            ELSE 'card_not_present' END AS auth_type,
       CASE event_id % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'web' WHEN 2 THEN 'mobile' ELSE 'api' END AS channel,
       CAST(value AS DECIMAL(18,2)) AS auth_amount,
       CASE event_id % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CAD'
            ELSE 'XYZ' END AS currency_code,
       CASE WHEN event_id % 97 = 0 THEN NULL
            ELSE CASE event_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'DE' END END AS merchant_country_code,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS billing_amount_usd,
       event_type
FROM events""",
    "stored_events": """SELECT * REPLACE (coalesce(nullif(billing_amount_usd, 0), auth_amount) AS billing_amount_usd),
       'pending' AS auth_status FROM auth_events""",
    "fraud_labels": """SELECT event_id * 2 AS label_id, event_id AS auth_event_id,
       (event_type = 'error' AND event_id % 4 = 0) AS is_fraud, 'confirmed_chargeback' AS label_source,
       ts + (7 + event_id % 53) * INTERVAL '1' DAY AS label_received_at
FROM events WHERE event_id % 10 < 8
UNION ALL
SELECT event_id * 2 + 1, event_id, (event_type = 'error'), 'investigator_confirmed',
       ts + (60 + event_id % 60) * INTERVAL '1' DAY
FROM events WHERE event_id % 20 = 0""",
    "chargebacks": """SELECT event_id AS chargeback_id, event_id AS auth_event_id,
       CAST(value AS DECIMAL(18,2)) AS chargeback_amount,
       ts + (1 + event_id % 10) * INTERVAL '1' DAY AS chargeback_received_at
FROM events WHERE event_type = 'error' AND event_id % 8 = 0""",
    "dim_customer": """SELECT c_custkey AS customer_id,
       CASE c_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR'
            ELSE 'ZZ' END AS home_country_code,
       CASE c_nationkey % 3 WHEN 0 THEN 'NYC' WHEN 1 THEN 'london' ELSE NULL END AS home_region
FROM customer""",
    "dim_device": """SELECT concat('dev_', CAST(g AS VARCHAR(20))) AS device_id, (g % 5 = 0) AS emulator_flag,
       (g % 7 = 0) AS rooted_jailbroken_flag
FROM (SELECT DISTINCT CAST(floor(user_id / 4) AS BIGINT) AS g FROM events) t WHERE g % 9 <> 1""",
    "dim_ip": """SELECT concat('10.0.', CAST(CAST(floor(g / 256) AS BIGINT) AS VARCHAR(20)), '.',
              CAST(g % 256 AS VARCHAR(20))) AS ip_address,
       CASE g % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'FR' ELSE 'JP' END AS geo_country_code,
       CASE g % 4 WHEN 0 THEN 'LA' WHEN 1 THEN 'London' WHEN 2 THEN 'paris ' ELSE NULL END AS geo_city,
       (g % 8 = 3) AS proxy_vpn_tor_flag
FROM (SELECT DISTINCT CAST(floor(user_id / 6) AS BIGINT) AS g FROM events) t WHERE g % 10 <> 9""",
    "dim_merchant": """SELECT m AS merchant_id,
       CASE m % 4 WHEN 0 THEN '5411' WHEN 1 THEN '5541' WHEN 2 THEN '6051' ELSE '7995' END AS mcc
FROM (SELECT DISTINCT CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS m FROM events) t WHERE m % 25 <> 0""",
    "scored_lines": """SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS auth_event_id,
       CAST((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 AS DOUBLE) / 1000 AS probability,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_usd,
       (l_returnflag = 'R' AND l_quantity > 45) AS is_fraud, l_linestatus AS segment
FROM lineitem""",
    "challenger_lines": """SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS auth_event_id,
       CAST((l_orderkey * 37 + l_partkey * 17 + l_linenumber * 7) % 1000 AS DOUBLE) / 1000 AS probability,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_usd,
       (l_returnflag = 'R' AND l_quantity > 45) AS is_fraud, l_linestatus AS segment
FROM lineitem""",
    "ops_metrics": """SELECT event_type AS endpoint,
       CASE WHEN event_id % 20 = 0 THEN 500 WHEN event_id % 20 = 1 THEN 404 ELSE 200 END AS status,
       value AS latency_ms, ts AS event_time, event_id AS request_id FROM events""",
    "fx_rates": values(C.FX_TO_USD.items(), "currency, usd_rate"),
    "gazetteer": values(C.GAZETTEER, "country, place, lat, lon"),
    "ip_places": coordinates("dim_ip", "geo_country_code", "geo_city"),
    "home_places": coordinates("dim_customer", "home_country_code", "home_region"),
    "ordered_events": """SELECT *, max(merchant_cb) OVER (PARTITION BY auth_event_id) AS unused FROM (
SELECT e.*, 0 AS merchant_cb FROM stored_events e)""",
    "velocity": f"""SELECT auth_event_id,
  count(*) {over('customer_id', '1 HOUR')} AS customer_txn_count_1h,
  count(*) {over('customer_id', '24 HOUR')} AS customer_txn_count_24h,
  sum(billing_amount_usd) {over('customer_id', '24 HOUR')} AS customer_spend_24h,
  count(*) {over('card_id', '10 MINUTE')} AS card_txn_count_10m,
  count(*) {over('merchant_id', '10 MINUTE')} AS merchant_txn_count_10m,
  CASE WHEN device_id IS NULL THEN 0 ELSE count(*) {over('device_id', '1 DAY')} END AS device_txn_count_1d,
  CASE WHEN device_id IS NULL THEN 0 ELSE count(DISTINCT account_id) {over('device_id', '30 DAY')} END
    AS device_account_count_30d,
  CASE WHEN ip_address IS NULL THEN 0 ELSE count(DISTINCT account_id) {over('ip_address', '7 DAY')} END
    AS ip_account_count_7d,
  CASE WHEN ip_address IS NULL THEN 0 ELSE count(DISTINCT card_id) {over('ip_address', '7 DAY')} END
    AS ip_card_count_7d,
  quantile_cont(CAST(billing_amount_usd AS DOUBLE), 0.95) {over('customer_id', '90 DAY')} AS customer_p95,
  quantile_cont(CAST(billing_amount_usd AS DOUBLE), 0.95) {over('merchant_id', '90 DAY')} AS merchant_p95,
  lag(event_time) OVER (PARTITION BY customer_id ORDER BY event_time, auth_event_id) AS prev_time,
  last_value(ip_address IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY event_time, auth_event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ip
FROM stored_events""",
    "merchant_rate": f"""SELECT auth_event_id, {r('n_cb / n_txn', 4)} AS merchant_chargeback_rate_30d,
       n_cb, n_txn FROM (
SELECT auth_event_id, is_event,
  CAST(sum(1 - is_event) {over('merchant_id', '30 DAY')} AS DOUBLE) AS n_cb,
  CAST(sum(is_event) {over('merchant_id', '30 DAY')} AS DOUBLE) AS n_txn
FROM (SELECT auth_event_id, merchant_id, event_time, 1 AS is_event FROM stored_events
      UNION ALL
      SELECT c.auth_event_id, e.merchant_id, c.chargeback_received_at, 0
      FROM chargebacks c JOIN stored_events e USING (auth_event_id)) u) w WHERE is_event = 1""",
    "features": f"""SELECT e.*,
  v.customer_txn_count_1h, v.customer_txn_count_24h, CAST(v.customer_spend_24h AS DECIMAL(18,2)) AS customer_spend_24h,
  v.card_txn_count_10m, v.merchant_txn_count_10m, m.merchant_chargeback_rate_30d, v.device_txn_count_1d,
  v.device_account_count_30d, v.ip_account_count_7d, v.ip_card_count_7d,
  {r(haversine('h.lat', 'h.lon', 'i.lat', 'i.lon'), 3)} AS geo_distance_from_home_km,
  CASE WHEN i.lat IS NOT NULL AND v.prev_ip = e.ip_address THEN 0.0
       ELSE {r(haversine('l.lat', 'l.lon', 'i.lat', 'i.lon'), 3)} END AS geo_distance_from_last_txn_km,
  (epoch_us(e.event_time) - epoch_us(v.prev_time)) // 1000000 AS seconds_since_last_txn,
  coalesce(CASE WHEN v.customer_p95 > 0 AND e.auth_amount <> 0
    THEN {r('CAST(e.auth_amount AS DOUBLE) / v.customer_p95', 4)} END, 0) AS amount_vs_customer_p95_ratio,
  coalesce(CASE WHEN v.merchant_p95 > 0 AND e.auth_amount <> 0
    THEN {r('CAST(e.auth_amount AS DOUBLE) / v.merchant_p95', 4)} END, 0) AS amount_vs_merchant_p95_ratio,
  coalesce(i.proxy_vpn_tor_flag, false) AS proxy_vpn_tor_flag,
  {r('''CASE WHEN e.device_id IS NULL THEN 0.0 WHEN d.device_id IS NULL THEN 0.5
     ELSE least(CASE WHEN d.emulator_flag THEN 0.4 ELSE 0.0 END
              + CASE WHEN d.rooted_jailbroken_flag THEN 0.3 ELSE 0.0 END, 1.0) END''', 4)} AS device_risk_score,
  CAST(0 AS DOUBLE) AS behavioral_risk_score, CAST(0 AS DOUBLE) AS graph_cluster_risk_score
FROM stored_events e JOIN velocity v USING (auth_event_id) JOIN merchant_rate m USING (auth_event_id)
LEFT JOIN dim_device d ON d.device_id = e.device_id
LEFT JOIN ip_places i ON i.ip_address = e.ip_address
LEFT JOIN ip_places l ON l.ip_address = v.prev_ip
LEFT JOIN home_places h ON h.customer_id = e.customer_id""",
    "vectors": f"SELECT {OTHERS}, {VECTOR} FROM features",
    "scores": f"""SELECT * REPLACE ({r('fraud_probability', 6)} AS fraud_probability,
  {r('calibrated_probability', 6)} AS calibrated_probability) FROM raw_scores""",
    "raw_scores": f"""SELECT *, {sigmoid('fraud_probability')} AS calibrated_probability FROM (
SELECT *, {rule_score_sql()} AS rule_score, {HIGH_FIRED} AS high_rule_fired,
  {heuristic("'" + C.CHAMPION_VERSION + "'")} AS fraud_probability, {REASON_CODES} AS reason_codes,
  '{C.CHAMPION_VERSION}' AS model_version FROM vectors)""",
    "scored": f"""SELECT * REPLACE ({r('fraud_probability', 6)} AS fraud_probability,
  {r('calibrated_probability', 6)} AS calibrated_probability, {r('final_score', 6)} AS final_score),
  calibrated_probability AS raw_probability, CASE decision WHEN 'approve' THEN 'approved' WHEN 'hard_decline' THEN 'declined' WHEN 'manual_review' THEN 'review'
    WHEN 'step_up' THEN 'challenged' ELSE 'pending' END AS auth_status,
  CASE WHEN decision = 'manual_review' THEN CASE WHEN final_score >= 0.8 THEN 'high_risk'
    WHEN final_score >= 0.6 THEN 'medium_risk' ELSE 'general' END END AS queue_name,
  CASE WHEN decision = 'manual_review' THEN CASE WHEN final_score >= 0.8 THEN 'critical'
    WHEN final_score >= 0.6 THEN 'high' ELSE 'medium' END END AS priority
FROM (SELECT *, CASE WHEN final_score >= 0.85::DOUBLE THEN 'hard_decline'
  WHEN final_score >= 0.55::DOUBLE OR high_rule_fired THEN 'manual_review'
  WHEN final_score >= 0.35::DOUBLE THEN 'step_up' ELSE 'approve' END AS decision
FROM (SELECT *, {band('calibrated_probability')} AS risk_band,
  0.7::DOUBLE * calibrated_probability + 0.3::DOUBLE * rule_score AS final_score FROM raw_scores))""",
}
del FRAGMENTS["ordered_events"]
_WORD = re.compile(r"[a-z_0-9]+")


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """WITH the fragments `body` needs, in dependency order."""
    fragments = {**FRAGMENTS, **(extra or {})}
    ordered: list[str] = []

    def need(text: str, inside: tuple[str, ...] = ()) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in fragments and word not in ordered and word not in inside:
                need(fragments[word], (*inside, word))
                ordered.append(word)

    need(body)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({fragments[name]})" for name in ordered) + "\n" + body
