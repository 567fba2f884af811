"""Views over scored events: rule rows, per-model scores, explanations, contributions and case texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.functions import scoring as S
from riskspark.functions.money import with_usd_rate
from riskspark.functions.numeric import rnd
from riskspark.operators.merge import latest
from riskspark.plans.lake import Lake


def fx_to_usd(lake: Lake) -> DataFrame:
    rated = with_usd_rate(lake.raw_auth_events, lake.rates, "currency_code", "usd_rate")
    return rated.select("auth_event_id", "currency_code",
                        rnd(F.col("auth_amount").cast("double") * F.col("usd_rate"), 6).alias("amount_usd"))


def fx_cross_rate(lake: Lake) -> DataFrame:
    """Rate ratio between the event currency and the currency of the merchant's country."""
    local = F.when(F.col("merchant_country_code") == "GB", "gbp ").when(
        F.col("merchant_country_code") == "DE", " eur").when(F.col("merchant_country_code") == "US", "USD")
    pairs = lake.raw_auth_events.withColumn("merchant_currency", local)
    rated = with_usd_rate(with_usd_rate(pairs, lake.rates, "currency_code", "from_rate"),
                          lake.rates, "merchant_currency", "to_rate")
    return rated.select("auth_event_id", "currency_code", "merchant_currency",
                        rnd(F.col("to_rate") / F.col("from_rate"), 6).alias("rate_ratio"))


def rules_long(scored: DataFrame, rules: list[S.Rule] = S.DEFAULT_RULES) -> DataFrame:
    return scored.select("auth_event_id", F.explode(S.rule_rows(rules)).alias("r")).select("auth_event_id", "r.*")


def model_scores(vectors: DataFrame, champion: str = C.CHAMPION_VERSION,
                 shadows: list[str] | None = None) -> DataFrame:
    """One row per (event, active model): the model list is a short literal array, so this is an explode, no join."""
    versions = [champion, *(C.SHADOW_VERSIONS if shadows is None else shadows)]
    listed = F.array(*[
        F.struct(F.lit(v).alias("model_version"), F.lit(v != champion).alias("shadow")) for v in versions])
    rows = vectors.withColumn("_m", F.explode(listed)).withColumns({
        "model_version": F.col("_m.model_version"), "shadow": F.col("_m.shadow")}).drop("_m")
    scored = rows.withColumn("fraud_probability", S.heuristic_score(F.col("model_version")))
    scored = scored.withColumn("calibrated_probability", S.calibrate_sigmoid(F.col("fraud_probability")))
    # Labels, bands and later decisions come from unrounded scores.
    return scored.withColumns({
        "raw_probability": F.col("calibrated_probability"),
        "predicted_label": F.col("calibrated_probability") >= F.lit(C.THRESHOLD_REVIEW),
        "risk_band": S.risk_band(F.col("calibrated_probability")),
        "score_time": F.col("event_time"),
    }).withColumns({c: rnd(F.col(c), 6) for c in ("fraud_probability", "calibrated_probability")})


def champion_scores(scores: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The first non-shadow score of an event, else its first score."""
    return latest(scores, ["auth_event_id"], ["shadow", "score_time", "model_version"],
                  ["model_version", "fraud_probability", "calibrated_probability", "risk_band", *also], first=True)


def feature_contributions(vectors: DataFrame, importances: dict[str, float] | None = None) -> DataFrame:
    """Additive contribution per feature: importance times value, or a tenth of the value without importances."""
    pairs = []
    for name in C.FEATURES:
        weight = importances.get(name, 0.0) if importances else 0.1
        pairs += [F.lit(name), rnd(F.col(name) * F.lit(weight), 6)]
    return vectors.select("auth_event_id", F.stack(F.lit(len(C.FEATURES)), *pairs).alias("feature", "contribution"))


def cases(scored: DataFrame) -> DataFrame:
    """Review cases. Their status in the test data follows the case id."""
    status = F.when(F.col("auth_event_id") % 4 == 1, "in_progress").when(
        F.col("auth_event_id") % 4 == 2, "closed").otherwise("open")
    return routed_cases(scored).withColumn("case_status", status)


def routed_cases(scored: DataFrame) -> DataFrame:
    """A case for every event sent to manual review, with its queue and priority."""
    return scored.where("decision = 'manual_review'").select(
        F.col("auth_event_id").alias("case_id"), "auth_event_id", F.lit("open").alias("case_status"), "queue_name",
        "priority", F.concat(F.lit("auto_review: score="), F.format_string("%.4f", rnd(F.col("final_score"), 4)))
        .alias("created_reason"), F.col("event_time").alias("created_at"))


def recommend(probability: Column) -> tuple[Column, Column]:
    action = confidence = None
    for cut, name, sure in C.RECOMMENDATIONS:
        test = probability >= F.lit(cut)
        action = F.when(test, name) if action is None else action.when(test, F.lit(name))
        confidence = F.when(test, F.lit(sure)) if confidence is None else confidence.when(test, F.lit(sure))
    return (action.otherwise(F.lit(C.DEFAULT_RECOMMENDATION[0])),
            confidence.otherwise(F.lit(C.DEFAULT_RECOMMENDATION[1])))


def recommendations(scored: DataFrame) -> DataFrame:
    champion = champion_scores(model_scores(scored), ("raw_probability",)).select(
        "auth_event_id", "calibrated_probability", "raw_probability")
    action, confidence = recommend(F.col("raw_probability"))
    return cases(scored).select("case_id", "auth_event_id").join(champion, "auth_event_id").select(
        "case_id", "calibrated_probability", action.alias("recommendation"), confidence.alias("confidence"))


def label_lines(labels: DataFrame) -> DataFrame:
    """Per event its labels in order of receipt as one text (an event has a handful of labels)."""
    line = F.concat(F.lit("Label: fraud="), F.col("is_fraud").cast("string"), F.lit(", source="),
                    F.col("label_source"))
    ordered = F.sort_array(F.collect_list(F.struct("label_received_at", "label_id", line.alias("line"))))
    return labels.groupBy("auth_event_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("label_text"),
        F.count("*").alias("label_count"))


def case_texts(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """The narrative an investigator reads, one per case."""
    about = scored.select(
        "auth_event_id", "auth_amount", "currency_code", "channel", "auth_type", "fraud_probability", "risk_band",
        "reason_codes", "decision")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Case ID: "), F.col("case_id")), F.concat(F.lit("Status: "), F.col("case_status")),
        F.concat(F.lit("Amount: "), F.col("auth_amount"), F.lit(" "), F.col("currency_code")),
        F.concat(F.lit("Channel: "), F.col("channel")), F.concat(F.lit("Auth Type: "), F.col("auth_type")),
        F.concat(F.lit("Fraud Probability: "), F.format_string("%.6f", "fraud_probability")),
        F.concat(F.lit("Risk Band: "), F.col("risk_band")),
        F.concat(F.lit("Reason Codes: "), F.array_join("reason_codes", ", ")),
        F.concat(F.lit("Decision: "), F.col("decision")), F.col("label_text"))
    return cases(scored).select("case_id", "auth_event_id", "case_status").join(about, "auth_event_id").join(
        label_lines(labels), "auth_event_id", "left").select("case_id", text.alias("context_text"))
