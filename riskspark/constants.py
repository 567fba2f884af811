"""Feature names, thresholds, rates, coordinates and texts that results depend on."""

from __future__ import annotations

# --- fixed values: the 19-feature vector, in model order -------------------------------------------------------
FEATURES = [
    "customer_txn_count_1h",
    "customer_txn_count_24h",
    "customer_spend_24h",
    "card_txn_count_10m",
    "merchant_txn_count_10m",
    "merchant_chargeback_rate_30d",
    "device_txn_count_1d",
    "device_account_count_30d",
    "ip_account_count_7d",
    "ip_card_count_7d",
    "geo_distance_from_home_km",
    "geo_distance_from_last_txn_km",
    "seconds_since_last_txn",
    "amount_vs_customer_p95_ratio",
    "amount_vs_merchant_p95_ratio",
    "proxy_vpn_tor_flag",
    "device_risk_score",
    "behavioral_risk_score",
    "graph_cluster_risk_score",
]
COUNT_FEATURES = [
    "customer_txn_count_1h",
    "customer_txn_count_24h",
    "card_txn_count_10m",
    "merchant_txn_count_10m",
    "device_txn_count_1d",
    "device_account_count_30d",
    "ip_account_count_7d",
    "ip_card_count_7d",
    "seconds_since_last_txn",
]
UNIT_RANGE_FEATURES = [
    "merchant_chargeback_rate_30d",
    "device_risk_score",
    "behavioral_risk_score",
    "graph_cluster_risk_score",
]
# Older stored JSON used other keys for these features.
FEATURE_ALIASES = {
    "geo_distance_from_home_km": "distance_from_home_km",
    "geo_distance_from_last_txn_km": "distance_from_last_txn_km",
    "amount_vs_customer_p95_ratio": "vs_customer_p95",
    "amount_vs_merchant_p95_ratio": "vs_merchant_p95",
    "device_risk_score": "risk_score",
}

# --- fixed values: versions, thresholds and costs ---------------------------------------------------------------
FEATURE_VERSION = "v2.3.1"
CHAMPION_VERSION = "xgb-v4.2.0"
SHADOW_VERSIONS = ["lgb-v5.0.0-rc1"]
RULE_SET_VERSION = "rules-v3.1.0"
THRESHOLD_DECLINE = 0.85
THRESHOLD_REVIEW = 0.55
THRESHOLD_STEP_UP = 0.35
MODEL_WEIGHT = 0.7
RULES_WEIGHT = 0.3
REVIEW_COST_USD = 15.0
FALSE_POSITIVE_COST = 0.1
MISSED_FRAUD_COST = 1.0
MIN_APPROVAL_RATE = 0.90
MAX_FALSE_POSITIVE_RATE = 0.05
STEP_UP_MISS_SHARE = 0.3

# --- fixed values: US dollars per unit of currency ----------------------------------------------------------------
FX_TO_USD = {
    "USD": 1.0,
    "EUR": 1.08,
    "GBP": 1.27,
    "CAD": 0.74,
    "AUD": 0.65,
    "JPY": 0.0067,
    "CHF": 1.12,
    "INR": 0.012,
    "BRL": 0.20,
    "MXN": 0.058,
    "NGN": 0.00065,
    "RUB": 0.011,
    "CNY": 0.14,
}

# --- fixed values: country, place, latitude, longitude; an empty place is the country's centre --------------------
GAZETTEER = [
    ("US", "", 39.8283, -98.5795),
    ("US", "NYC", 40.7128, -74.0060),
    ("US", "NY", 43.2994, -74.2179),
    ("US", "LA", 34.0522, -118.2437),
    ("US", "CA", 36.7783, -119.4179),
    ("US", "CHICAGO", 41.8781, -87.6298),
    ("US", "IL", 40.6331, -89.3985),
    ("US", "TX", 31.9686, -99.9018),
    ("US", "FL", 27.6648, -81.5158),
    ("GB", "", 55.3781, -3.4360),
    ("GB", "LONDON", 51.5074, -0.1278),
    ("UK", "", 55.3781, -3.4360),
    ("UK", "LONDON", 51.5074, -0.1278),
    ("DE", "", 51.1657, 10.4515),
    ("DE", "BERLIN", 52.5200, 13.4050),
    ("FR", "", 46.2276, 2.2137),
    ("FR", "PARIS", 48.8566, 2.3522),
    ("ES", "", 40.4637, -3.7492),
    ("ES", "MADRID", 40.4168, -3.7038),
    ("IT", "", 41.8719, 12.5674),
    ("IT", "ROME", 41.9028, 12.4964),
    ("NL", "", 52.1326, 5.2913),
    ("NL", "AMSTERDAM", 52.3676, 4.9041),
    ("CA", "", 56.1304, -106.3468),
    ("CA", "TORONTO", 43.6532, -79.3832),
    ("CA", "ON", 51.2538, -85.3232),
    ("AU", "", -25.2744, 133.7751),
    ("AU", "SYDNEY", -33.8688, 151.2093),
    ("IN", "", 20.5937, 78.9629),
    ("IN", "MUMBAI", 19.0760, 72.8777),
    ("CN", "", 35.8617, 104.1954),
    ("CN", "BEIJING", 39.9042, 116.4074),
    ("JP", "", 36.2048, 138.2529),
    ("JP", "TOKYO", 35.6762, 139.6503),
    ("BR", "", -14.2350, -51.9253),
    ("BR", "SAO PAULO", -23.5505, -46.6333),
    ("MX", "", 23.6345, -102.5528),
    ("MX", "MEXICO CITY", 19.4326, -99.1332),
]
EARTH_RADIUS_KM = 6371.0

# --- fixed values: heuristic weights and saturation points ----------------------------------------------------------
HEURISTIC_TERMS = [
    ("card_txn_count_10m", 0.12, 5.0),
    ("device_account_count_30d", 0.15, 3.0),
    ("ip_card_count_7d", 0.10, 5.0),
    ("customer_txn_count_1h", 0.08, 10.0),
    ("proxy_vpn_tor_flag", 0.12, 1.0),
    ("device_risk_score", 0.10, 1.0),
    ("amount_vs_customer_p95_ratio", 0.08, 3.0),
    ("seconds_since_last_txn", -0.05, 60.0),
    ("graph_cluster_risk_score", 0.10, 1.0),
    ("merchant_chargeback_rate_30d", 0.10, 0.05),
]
SEVERITY_WEIGHTS = {"high": 0.3, "medium": 0.15, "low": 0.05}
OTHER_SEVERITY_WEIGHT = 0.1

# --- fixed values: probability bands, highest first ------------------------------------------------------------------
RISK_BANDS = [(0.85, "critical"), (0.65, "high"), (0.40, "medium"), (0.20, "low")]
LOWEST_BAND = "minimal"

# --- fixed values: reason-code texts -----------------------------------------------------------------------------------
REASON_TEXTS = {
    "HIGH_CARD_VELOCITY": "Card used an unusually high number of times in a short window",
    "MULTI_ACCOUNT_DEVICE": "Device is linked to multiple distinct accounts",
    "MULTI_CARD_IP": "IP address used with multiple different cards",
    "VPN_PROXY_TOR": "Transaction routed through anonymizing proxy",
    "UNUSUAL_AMOUNT": "Transaction amount significantly exceeds customer's typical spend",
    "RAPID_FIRE": "Very short time gap between consecutive transactions",
    "RISKY_DEVICE": "Device shows indicators of emulation or rooting",
    "FRAUD_RING_PROXIMITY": "Account is connected to other suspicious entities in graph",
    "BASELINE_RISK": "Standard risk level — no specific anomaly detected",
}

# --- fixed values: recommendations by probability ------------------------------------------------------------------------
RECOMMENDATIONS = [
    (0.85, "CONFIRM_FRAUD", 0.9),
    (0.65, "ESCALATE", 0.7),
    (0.40, "GATHER_MORE_INFO", 0.6),
]
DEFAULT_RECOMMENDATION = ("CLOSE_NOT_FRAUD", 0.8)

# --- fixed values: enumerations of the authorization contract ---------------------------------------------------------------
AUTH_TYPES = ["card_present", "card_not_present", "recurring"]
CHANNELS = ["pos", "web", "mobile", "api"]
ENTRY_MODES = ["chip", "swipe", "tap", "keyed"]

# --- fixed values: decision to stored status ------------------------------------------------------------------------------------
AUTH_STATUS = {
    "approve": "approved",
    "allow_with_monitoring": "approved",
    "decline": "declined",
    "hard_decline": "declined",
    "soft_decline": "declined",
    "manual_review": "review",
    "step_up": "challenged",
}
CLOSING_STATUSES = ["resolved_fraud", "resolved_not_fraud", "closed"]

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
