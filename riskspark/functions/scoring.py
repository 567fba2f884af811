"""Rules, heuristic score, bands, reason codes, decisions and routing as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.functions.numeric import rnd


@dataclass(frozen=True)
class Rule:
    """A rule: the condition and the explanation are columns over the 19-feature vector."""

    rule_id: str
    name: str
    severity: str
    condition: Column | str
    explanation: Column | str

    def fired(self) -> Column:
        condition = F.expr(self.condition) if isinstance(self.condition, str) else self.condition
        return F.coalesce(condition, F.lit(False))

    def text(self) -> Column:
        text = F.expr(self.explanation) if isinstance(self.explanation, str) else self.explanation
        return F.when(self.fired(), text).otherwise(F.lit(""))


# --- fixed values: the default rule set --------------------------------------------------------------------------
DEFAULT_RULES = [
    Rule("R001", "high_velocity_card_10m", "high", "card_txn_count_10m >= 5",
         "concat('Card used ', cast(card_txn_count_10m as bigint), ' times in 10 minutes')"),
    Rule("R002", "multi_account_device_30d", "high", "device_account_count_30d >= 3",
         "concat('Device linked to ', cast(device_account_count_30d as bigint), ' accounts in 30 days')"),
    Rule("R003", "vpn_proxy_tor", "medium", "proxy_vpn_tor_flag >= 1",
         "'Transaction originated from VPN/proxy/Tor'"),
    Rule("R004", "amount_exceeds_3x_p95", "medium", "amount_vs_customer_p95_ratio > 3.0D",
         "concat('Amount is ', format_string('%.1f', floor(amount_vs_customer_p95_ratio * 10D + 0.5D) / 10D), 'x customer\\'s p95')"),
    Rule("R005", "multi_card_ip_7d", "high", "ip_card_count_7d >= 5",
         "concat('IP used with ', cast(ip_card_count_7d as bigint), ' different cards in 7 days')"),
    Rule("R006", "rapid_fire_under_30s", "high", "nullif(seconds_since_last_txn, 0D) < 30",
         "concat('Only ', cast(seconds_since_last_txn as bigint), 's since last transaction')"),
    Rule("R007", "emulator_rooted_device", "medium", "device_risk_score >= 0.4D",
         "concat('Device risk score is ', format_string('%.2f', floor(device_risk_score * 100D + 0.5D) / 100D), ' (emulator/rooted)')"),
    Rule("R008", "high_spend_24h", "low", "customer_spend_24h > 5000",
         "concat('Customer spent $', format_string('%.0f', cast(floor(customer_spend_24h + 0.5D) as double)), ' in 24h')"),
]


def severity_weight(severity: str) -> float:
    return C.SEVERITY_WEIGHTS.get(severity, C.OTHER_SEVERITY_WEIGHT)


def as_number(name: str, kind: str = "double") -> Column:
    """A feature as a number: null gives 0, booleans give 0 or 1."""
    return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind))


def rule_rows(rules: list[Rule] = DEFAULT_RULES) -> Column:
    """One struct per rule, in rule order; explode for one row per (event, rule)."""
    return F.array(*[
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.name).alias("rule_name"),
            F.lit(rule.severity).alias("severity"),
            rule.fired().alias("fired"),
            F.when(rule.fired(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("contribution_score"),
            rule.text().alias("explanation"),
        )
        for rule in rules
    ])


def rules_score(rules: list[Rule] = DEFAULT_RULES) -> Column:
    total = F.lit(0.0)
    for rule in rules:
        total = total + F.when(rule.fired(), F.lit(severity_weight(rule.severity))).otherwise(F.lit(0.0))
    return F.least(rnd(total, 4), F.lit(1.0))


def high_rule_fired(rules: list[Rule] = DEFAULT_RULES) -> Column:
    fired = F.lit(False)
    for rule in rules:
        if rule.severity == "high":
            fired = fired | rule.fired()
    return fired


def version_noise(version: Column) -> Column:
    """A constant per model version in [0, .02], from the first four hex digits of its md5."""
    return F.conv(F.substring(F.md5(version), 1, 4), 16, 10).cast("double") / F.lit(65535.0) * F.lit(0.02)


def heuristic_score(version: Column) -> Column:
    total = F.lit(0.0)
    for name, weight, point in C.HEURISTIC_TERMS:
        level = as_number(name) / F.lit(point)
        if weight < 0:
            term = F.lit(weight) * F.greatest(F.lit(0.0), F.lit(1.0) - level)
        else:
            term = F.lit(weight) * F.least(level, F.lit(1.0))
        total = total + term
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), total + version_noise(version)))


def calibrate_sigmoid(raw: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-5.0) * (raw - F.lit(0.5))))


def risk_band(probability: Column) -> Column:
    band = None
    for cut, name in C.RISK_BANDS:
        test = probability >= F.lit(cut)
        band = F.when(test, F.lit(name)) if band is None else band.when(test, F.lit(name))
    return band.otherwise(F.lit(C.LOWEST_BAND))


# --- fixed values: reason codes in order ---------------------------------------------------------------------------
REASONS = [
    ("HIGH_CARD_VELOCITY", "card_txn_count_10m >= 5"),
    ("MULTI_ACCOUNT_DEVICE", "device_account_count_30d >= 3"),
    ("MULTI_CARD_IP", "ip_card_count_7d >= 5"),
    ("VPN_PROXY_TOR", "proxy_vpn_tor_flag >= 1"),
    ("UNUSUAL_AMOUNT", "amount_vs_customer_p95_ratio > 3"),
    ("RAPID_FIRE", "nullif(seconds_since_last_txn, 0D) < 30"),
    ("RISKY_DEVICE", "device_risk_score >= 0.4D"),
    ("FRAUD_RING_PROXIMITY", "graph_cluster_risk_score > 0.5D"),
    ("GEO_ANOMALY", "geo_distance_from_home_km > 5000"),
    ("HIGH_RISK_MERCHANT", "merchant_chargeback_rate_30d > 0.05D"),
]
MAX_REASONS = 5


def reason_codes() -> Column:
    found = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(code)) for code, test in REASONS]))
    return F.when(F.size(found) == 0, F.array(F.lit("BASELINE_RISK"))).otherwise(F.slice(found, 1, MAX_REASONS))


def reason_texts(codes: Column) -> Column:
    texts = F.create_map(*[F.lit(item) for pair in C.REASON_TEXTS.items() for item in pair])
    return F.transform(codes, lambda code: F.coalesce(texts[code], F.concat(F.lit("Risk indicator: "), code)))


def blend(model: Column, rules: Column) -> Column:
    return F.lit(C.MODEL_WEIGHT) * model + F.lit(C.RULES_WEIGHT) * rules


def decide(score: Column, high_fired: Column) -> Column:
    return (
        F.when(score >= F.lit(C.THRESHOLD_DECLINE), F.lit("hard_decline"))
        .when((score >= F.lit(C.THRESHOLD_REVIEW)) | high_fired, F.lit("manual_review"))
        .when(score >= F.lit(C.THRESHOLD_STEP_UP), F.lit("step_up"))
        .otherwise(F.lit("approve"))
    )


def decide_by_probability(
    probability: Column,
    decline: Column | float = C.THRESHOLD_DECLINE,
    review: Column | float = C.THRESHOLD_REVIEW,
    step_up: Column | float = C.THRESHOLD_STEP_UP,
) -> Column:
    """The what-if decision: thresholds only, rules ignored."""
    return (
        F.when(probability >= decline, F.lit("hard_decline"))
        .when(probability >= review, F.lit("manual_review"))
        .when(probability >= step_up, F.lit("step_up"))
        .otherwise(F.lit("approve"))
    )


def auth_status(decision: Column) -> Column:
    statuses = F.create_map(*[F.lit(item) for pair in C.AUTH_STATUS.items() for item in pair])
    return F.coalesce(statuses[decision], F.lit("pending"))


# The score cuts of queues and priorities, and their names.
def case_queue_name(score: Column) -> Column:
    return F.when(score >= 0.8, F.lit("high_risk")).when(score >= 0.6, F.lit("medium_risk")).otherwise(F.lit("general"))


def case_priority(score: Column) -> Column:
    return F.when(score >= 0.8, F.lit("critical")).when(score >= 0.6, F.lit("high")).otherwise(F.lit("medium"))
