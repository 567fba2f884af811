"""Scores, decisions, cases and lifecycle rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.functions import scoring as S
from riskspark.functions.numeric import rnd


def vectorized(features: DataFrame) -> DataFrame:
    """Replace the 19 features by their model-input form, keeping all other columns."""
    return features.withColumns({
        name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in C.FEATURES})


def score_events(features: DataFrame, rules: list[S.Rule] = S.DEFAULT_RULES,
                 version: str = C.CHAMPION_VERSION) -> DataFrame:
    """Rules, model, blend, decision and routing for every event, in one projection over the feature rows."""
    scored = vectorized(features).withColumns({
        "rule_score": S.rules_score(rules),
        "high_rule_fired": S.high_rule_fired(rules),
        "fraud_probability": S.heuristic_score(F.lit(version)),
        "reason_codes": S.reason_codes(),
        "model_version": F.lit(version),
    })
    scored = scored.withColumn("calibrated_probability", S.calibrate_sigmoid(F.col("fraud_probability")))
    scored = scored.withColumns({
        "risk_band": S.risk_band(F.col("calibrated_probability")),
        "final_score": S.blend(F.col("calibrated_probability"), F.col("rule_score")),
    })
    scored = scored.withColumn("decision", S.decide(F.col("final_score"), F.col("high_rule_fired")))
    # Whatever is decided is decided on unrounded scores, which go along; only what is put out has six decimals.
    return scored.withColumns({
        "raw_probability": F.col("calibrated_probability"),
        "auth_status": S.auth_status(F.col("decision")),
        "queue_name": F.when(F.col("decision") == "manual_review", S.case_queue_name(F.col("final_score"))),
        "priority": F.when(F.col("decision") == "manual_review", S.case_priority(F.col("final_score"))),
    }).withColumns({c: rnd(F.col(c), 6) for c in ("fraud_probability", "calibrated_probability", "final_score")})
