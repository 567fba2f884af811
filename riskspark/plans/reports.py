"""Agreed shapes of the report tables and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskspark.operators.contracts import table_report
from riskspark.plans import economics, evaluation, replay
from riskspark.plans.lake import Lake

# --- fixed values: report fields and types ---------------------------------------------------------------------------
ECONOMICS = {
    "total_transactions": "bigint", "total_volume_usd": "double", "fraud_transactions": "bigint",
    "fraud_volume_usd": "double", "prevented_fraud_usd": "double", "missed_fraud_usd": "double",
    "false_positive_count": "bigint", "false_positive_volume_usd": "double", "manual_review_count": "bigint",
    "manual_review_cost_usd": "double", "approval_rate": "double", "decline_rate": "double", "review_rate": "double",
    "challenge_rate": "double", "fraud_basis_points": "double", "net_fraud_savings_usd": "double",
    "customer_friction_rate": "double",
}
REPLAY = {
    "auth_event_id": "bigint", "rules_fired": "array<string>", "decision_type": "string", "decision_correct": "boolean",
    "time_to_label_seconds": "double",
}
MODEL_CARD = {
    "model_version": "string", "model_type": "string", "feature_version": "string", "threshold_decline": "double",
    "auc_roc": "double", "top_importances": "string",
}


#: SQL texts that are true where a value breaks the contract; null counts as missing, not as broken.
RULES = {
    "economics": {name: f"{name} < 0 or {name} > 1" if name.endswith("_rate") else f"{name} < 0"
                  for name in ECONOMICS if name != "net_fraud_savings_usd"},
    "replay": {"time_to_label_seconds": "time_to_label_seconds < 0", "decision_type": "decision_type = ''"},
    "model_card": {"threshold_decline": "threshold_decline < 0 or threshold_decline > 1",
                   "auc_roc": "auc_roc < 0 or auc_roc > 1", "model_version": "model_version = ''"},
}


def contract_report(lake: Lake) -> DataFrame:
    """The rows of the economics, replay and model-card tables against their contracts."""
    return (
        table_report(economics.summary(lake), ECONOMICS, RULES["economics"], "economics")
        .unionByName(table_report(replay.replay_decisions(lake), REPLAY, RULES["replay"], "replay"))
        .unionByName(table_report(evaluation.model_cards(lake), MODEL_CARD, RULES["model_card"], "model_card"))
    )
