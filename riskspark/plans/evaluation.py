"""Model evaluation, comparison, drift, parity, governance and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark import constants as C
from riskspark.functions.numeric import micros, ratio, rnd
from riskspark.operators import curves, drift, quantiles
from riskspark.operators.merge import latest
from riskspark.plans import economics
from riskspark.plans import scoring_views as views
from riskspark.plans.decisions import vectorized
from riskspark.plans.lake import Lake

DRIFT_SPLIT = "2024-01-16 00:00:00"
CHALLENGER = C.SHADOW_VERSIONS[0]


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def labelled_scores(lake: Lake, groups: dict[str, Column], scores: DataFrame | None = None) -> DataFrame:
    """Scores of all active models, or the given ones, on events with a label, with the latest verdict."""
    label = economics.latest_label(lake.labels).select("auth_event_id", "is_fraud")
    return (lake.model_scores if scores is None else scores).select(
        "auth_event_id", F.col("raw_probability").alias("probability"),
        F.col("billing_amount_usd").alias("amount_usd"), *[c.alias(n) for n, c in groups.items()],
    ).join(label, "auth_event_id")


def model_eval(lake: Lake, start: str | None = None, end: str | None = None, segment: Column | None = None,
               population: Column | None = None) -> DataFrame:
    """Per model: ranking metrics, rates at the review cut and the decision mix.

    Optionally of the scores made from `start` to `end`, both included, on events that meet the condition `population`, and
    per value of `segment` (null is the segment 'none'). The mix is that of the decisions the model took on these events; a
    model without labelled scores among them has no row.
    """
    scores = lake.model_scores
    if start is not None:
        scores = scores.where(F.col("score_time").between(_at(start), _at(end)))
    if population is not None:
        scores = scores.where(population)
    names = {"model_version": F.col("model_version")}
    decisions = lake.decisions
    if segment is not None:
        names["segment"] = F.coalesce(segment.cast("string"), F.lit("none"))
    if start is not None or segment is not None or population is not None:
        decisions = decisions.join(
            scores.select("auth_event_id", *[c.alias(n) for n, c in names.items()]), ["auth_event_id", "model_version"])
    groups = list(names)
    ordered = curves.scores_in_order(labelled_scores(lake, names, scores), groups)
    ranks = curves.ranking_metrics(ordered, groups)
    rates = curves.confusion(ordered, groups, C.THRESHOLD_DECLINE, C.THRESHOLD_REVIEW).select(
        *groups, "sample_size", F.col("precision").alias("precision_at_review"),
        F.col("recall").alias("recall_at_review"), "false_positive_rate", "false_negative_rate")
    n = F.greatest(F.count("*"), F.lit(1))
    kind = F.col("decision_type")
    mix = decisions.groupBy(*groups).agg(
        ratio(F.count_if(kind == "approve"), n).alias("approval_rate"),
        ratio(F.count_if(kind.isin("decline", "hard_decline")), n).alias("decline_rate"),
        ratio(F.count_if(kind == "manual_review"), n).alias("review_rate"))
    return rates.join(ranks, groups).join(mix, groups, "left").fillna(
        0.0, ["approval_rate", "decline_rate", "review_rate"])


def eval_harness(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """Full metric set per model for all rows and per segment."""
    rows = champion.withColumn("model_version", F.lit(C.CHAMPION_VERSION)).unionByName(
        challenger.withColumn("model_version", F.lit(CHALLENGER)))
    rows = rows.withColumn("segment", F.explode(F.array(F.lit("all"), F.col("segment"))))
    groups = ["model_version", "segment"]
    ordered = curves.scores_in_order(rows, groups)
    return curves.ranking_metrics(ordered, groups).join(
        curves.confusion(ordered, groups, C.THRESHOLD_DECLINE, C.THRESHOLD_REVIEW), groups)


COMPARED = ["auc_roc", "auc_pr", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate"]
LOWER_IS_BETTER = ["false_positive_rate", "false_negative_rate"]
REGRESSION_METRICS = ["auc_roc", "precision", "recall", "f1"]


def _metric_pairs(results: DataFrame, metrics: list[str], old: str, new: str) -> DataFrame:
    pairs = [item for m in metrics for item in (F.lit(m), F.col(m))]
    long = results.select("model_version", F.stack(F.lit(len(metrics)), *pairs).alias("metric", "value"))
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("model_version") == old, F.col("value"))).alias("champion"),
        F.max(F.when(F.col("model_version") == new, F.col("value"))).alias("challenger"))


def eval_compare(results: DataFrame, old: str, new: str) -> DataFrame:
    """Metric by metric: delta, change in percent, improved; promote if at least 70 % improved."""
    pairs = _metric_pairs(results, COMPARED, old, new).where("champion is not null and challenger is not null")
    delta = F.col("challenger") - F.col("champion")
    better = F.when(F.col("metric").isin(LOWER_IS_BETTER), delta < 0).otherwise(delta > 0)
    rows = pairs.select(
        "metric", "champion", "challenger", rnd(delta, 6).alias("delta"),
        ratio(delta * 100, F.col("champion"), 4).alias("pct_change"), better.alias("improved"))
    verdict = rows.agg(F.count_if("improved").alias("improvements"), F.count("*").alias("_n")).select(
        "improvements",
        F.when(F.col("improvements") >= F.col("_n") * 0.7, "promote").otherwise("hold").alias("recommendation"))
    return rows.crossJoin(F.broadcast(verdict))


def eval_regression(results: DataFrame, baseline: str, current: str, max_drop_pct: float = 5.0) -> DataFrame:
    pairs = _metric_pairs(results, REGRESSION_METRICS, baseline, current)
    change = (F.col("challenger") - F.col("champion")) / F.nullif(F.col("champion"), F.lit(0.0)) * 100
    judged = (F.col("champion") != 0) & (F.col("challenger") != 0)
    return pairs.select(
        "metric", F.col("champion").alias("baseline"), F.col("challenger").alias("current"),
        rnd(F.abs(change), 4).alias("change_pct"),
        F.coalesce(judged & (change < -max_drop_pct), F.lit(False)).alias("regressed"))


def feature_drift(features: DataFrame, groups: list[str] | None = None) -> DataFrame:
    groups = groups or []
    sides = features.withColumn("production", F.col("event_time") >= _at(DRIFT_SPLIT))
    table = drift.binned_features(sides, C.FEATURES, groups, "production")
    psi, js = rnd(drift.psi_clipped(), 6), rnd(drift.jensen_shannon(), 6)
    return table.select(
        *groups, "feature", psi.alias("psi"), js.alias("js"),
        rnd(F.coalesce(1 - F.col("n_prod") / F.nullif(F.col("prod_rows"), F.lit(0)), F.lit(0.0)), 6).alias("null_rate"),
        drift.mean("train_sum", "n_train").alias("train_mean"), drift.mean("prod_sum", "n_prod").alias("prod_mean"),
        ((psi > 0.25) | (js > 0.1)).alias("alert"))


def daily_drift(offline: DataFrame, online: DataFrame, run_date: str) -> DataFrame:
    """The scheduled job: offline rows of [d-120, d-30) against online rows of [d-7, d)."""
    day = _at(run_date)

    def back(days: int) -> Column:
        return day - F.make_dt_interval(F.lit(days))

    time = F.col("event_time")
    train = offline.where((time >= back(120)) & (time < back(30))).withColumn("production", F.lit(False))
    prod = online.where((time >= back(7)) & (time < day)).withColumn("production", F.lit(True))
    table = drift.binned_features(train.unionByName(prod), C.FEATURES, [], "production")
    psi = rnd(drift.psi_smoothed(), 6)
    return table.select(
        "feature", psi.alias("psi"), drift.mean("train_sum", "n_train").alias("train_mean"),
        drift.mean("prod_sum", "n_prod").alias("prod_mean"),
        ratio(F.col("prod_rows") - F.col("n_prod"), F.greatest("prod_rows", F.lit(1))).alias("null_rate"),
        (psi >= 0.25).alias("alert"))


def shadow_experiment(scores: DataFrame, champion: str = C.CHAMPION_VERSION, challenger: str = CHALLENGER,
                      start: str | None = None, end: str | None = None) -> DataFrame:
    """Both models on the same events, optionally those of [start, end): mean scores, shares at the review cut, agreement."""
    if start is not None:
        scores = scores.where((F.col("event_time") >= _at(start)) & (F.col("event_time") < _at(end)))
    p = F.col("raw_probability")
    both = scores.groupBy("auth_event_id").agg(
        F.max(F.when(F.col("model_version") == champion, p)).alias("a"),
        F.max(F.when(F.col("model_version") == challenger, p)).alias("b"))
    up_a, up_b, n = F.col("a") >= C.THRESHOLD_REVIEW, F.col("b") >= C.THRESHOLD_REVIEW, F.count("*")

    def average(column: str) -> Column:
        return rnd(F.sum(rnd(F.col(column), 6).cast("decimal(18,6)")).cast("double") / n, 6)

    return both.agg(
        average("a").alias("champion_avg_score"), average("b").alias("challenger_avg_score"),
        ratio(F.count_if(up_a) * 100, n).alias("champion_decline_pct"),
        ratio(F.count_if(up_b) * 100, n).alias("challenger_decline_pct"),
        ratio(F.count_if(up_a == up_b) * 100, n).alias("agreement_pct"), n.alias("n_events"))


# --- parity -------------------------------------------------------------------------------------------------------


def offline_store(lake: Lake) -> DataFrame:
    """The offline feature store of the test data: recomputed features under their older JSON names. Every 100th event
    has a shifted spend and every 250th lacks a risk score."""
    e = F.col("auth_event_id")
    items = []
    for name in C.FEATURES:
        value = F.col(name).cast("double")
        if name == "customer_spend_24h":
            value = F.when(e % 100 == 0, value + 1).otherwise(value)
        if name == "device_risk_score":
            value = F.when(e % 250 != 0, value)
        items.append(value.alias(C.FEATURE_ALIASES.get(name, name)))
    return vectorized(lake.feature_events).select(
        e, F.lit(C.FEATURE_VERSION).alias("feature_version"), F.to_json(F.struct(*items)).alias("feature_json"))


def online_offline(lake: Lake) -> DataFrame:
    online = vectorized(lake.feature_events).withColumn("feature_version", F.lit(C.FEATURE_VERSION))
    return online.select("auth_event_id", "feature_version", *C.FEATURES).join(
        offline_store(lake), ["auth_event_id", "feature_version"])


def _offline(name: str) -> Column:
    """A feature in the parsed offline row, by its own name or its older one; null where missing."""
    return F.coalesce(*[F.col("_m")[k] for k in (name, C.FEATURE_ALIASES.get(name, name))])


def parity_long(joined: DataFrame) -> DataFrame:
    """(event, feature, online, offline, delta)."""
    parsed = joined.withColumn("_m", F.from_json("feature_json", "map<string,double>"))
    items = []
    for name in C.FEATURES:
        items += [F.lit(name), F.col(name), _offline(name)]
    return parsed.select(
        "auth_event_id", F.stack(F.lit(len(C.FEATURES)), *items).alias("feature", "online", "offline")
    ).withColumn("delta", F.abs(F.col("online") - F.col("offline")))


def parity_events(joined: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per event, found in its row: features that agree, differ and are missing offline, and the largest difference."""
    parsed = joined.withColumn("_m", F.from_json("feature_json", "map<string,double>"))
    offline = parsed.select("auth_event_id", F.array(*[_offline(n) for n in C.FEATURES]).alias("_off"),
                            F.array(*[F.col(n).cast("double") for n in C.FEATURES]).alias("_on"))
    deltas = offline.select("auth_event_id", "_off", F.zip_with("_on", "_off", lambda a, b: F.abs(a - b)).alias("_d"))

    def count(column: str, test) -> Column:
        return F.size(F.filter(column, test)).cast("bigint")

    return deltas.select(
        "auth_event_id", count("_d", lambda d: d <= tolerance).alias("n_matching"),
        count("_d", lambda d: d > tolerance).alias("n_mismatched"),
        count("_off", lambda v: v.isNull()).alias("n_missing"), rnd(F.array_max("_d"), 4).alias("max_delta"),
    ).withColumn("passed", (F.col("n_mismatched") == 0) & (F.col("n_missing") == 0))


def parity_report(long: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per feature: mismatches, mean and largest error, missing values, share of agreeing events."""
    off = F.col("delta") > tolerance
    error = F.sum(F.when(off, F.col("delta").cast(drift.EXACT))).cast("double")
    return long.groupBy("feature").agg(
        F.count("*").alias("n_checked"), F.count_if(off).alias("mismatch_count"),
        F.count_if(F.col("offline").isNull()).alias("missing_count"),
        rnd(F.coalesce(error / F.nullif(F.count_if(off), F.lit(0)), F.lit(0.0)), 4).alias("mean_absolute_error"),
        rnd(F.coalesce(F.max(F.when(off, F.col("delta"))), F.lit(0.0)), 4).alias("max_error"))


def parity_totals(joined: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Events checked, passed and failed, over all of them: one row."""
    return parity_events(joined, tolerance).agg(
        F.count("*").alias("checked"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def worst_mismatches(long: DataFrame, limit: int = 20, tolerance: float = 0.01) -> DataFrame:
    return long.where(F.col("delta") > tolerance).select(
        "auth_event_id", "feature", rnd(F.col("delta"), 4).alias("delta")).orderBy(
        F.col("delta").desc(), "auth_event_id", "feature").limit(limit)


# --- operational metrics ----------------------------------------------------------------------------------------------


def metric_scoring(metrics: DataFrame) -> DataFrame:
    """Latency quantiles, calls and fallbacks per model; a call without a 200 status fell back."""
    rows = metrics.withColumn("model_version", F.when(F.col("request_id") % 2 == 0, C.CHAMPION_VERSION).otherwise(
        F.lit(CHALLENGER)))
    points = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    found = quantiles.quantiles(rows, F.col("latency_ms"), points, ["model_version"])
    counts = rows.groupBy("model_version").agg(
        F.count("*").alias("total_calls"), F.count_if(F.col("status") != 200).alias("fallback_count"))
    return counts.join(found, "model_version").select(
        "model_version", *[rnd(F.col(p), 2).alias(p) for p in points], "total_calls", "fallback_count",
        ratio(F.col("fallback_count"), F.col("total_calls"), 4).alias("fallback_rate"))


def metric_decisions(decisions: DataFrame) -> DataFrame:
    """Counts per decision type beside the overall approve, decline and review rates."""
    kind = F.lower("decision_type")
    counts = decisions.groupBy("decision_type").agg(F.count("*").alias("n"))
    k = F.lower("decision_type")
    n = F.sum("n")

    def share(test: Column) -> Column:
        return ratio(F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)), n, 4)

    overall = counts.agg(
        n.alias("total"), share(k.contains("approve") & ~k.contains("decline")).alias("approval_rate"),
        share(kind.contains("decline")).alias("decline_rate"), share(kind.contains("review")).alias("review_rate"))
    return counts.crossJoin(F.broadcast(overall))


def top_rules(scored: DataFrame, limit: int = 10) -> DataFrame:
    return views.rules_long(scored).where("fired").groupBy("rule_name").agg(F.count("*").alias("fires")).orderBy(
        F.col("fires").desc(), "rule_name").limit(limit)


def metric_parity(long: DataFrame, limit: int = 10, tolerance: float = 0.01) -> DataFrame:
    return long.where((F.col("delta") > tolerance) | F.col("offline").isNull()).groupBy("feature").agg(
        F.count("*").alias("failures")).orderBy(F.col("failures").desc(), "feature").limit(limit)


def metric_copilot(traces: DataFrame) -> DataFrame:
    """Assistant answers are calls; a very short answer is a fallback."""
    answers = traces.where("step_type = 'assistant'")
    fallback = F.count_if(F.length("output") < 60)
    return answers.agg(F.count("*").alias("total_calls"), fallback.alias("fallback_count"),
                       ratio(fallback, F.count("*"), 4).alias("fallback_rate"))


def metric_api(metrics: DataFrame) -> DataFrame:
    """Per endpoint and in total (null endpoint): requests, mean latency, errors and error rate."""
    n, errors = F.count("*"), F.count_if(F.col("status") >= 400)
    return metrics.rollup("endpoint").agg(
        n.alias("requests"),
        rnd(F.sum(F.col("latency_ms").cast(drift.EXACT)).cast("double") / n, 2).alias("avg_latency_ms"),
        errors.alias("error_count"), ratio(errors, n, 4).alias("error_rate")).select(
        F.coalesce("endpoint", F.lit("total")).alias("endpoint"), "requests", "avg_latency_ms", "error_count",
        "error_rate")


def nearest_rank(metrics: DataFrame) -> DataFrame:
    return quantiles.nearest_ranks(metrics, F.col("latency_ms"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["endpoint"])


# --- profiles ------------------------------------------------------------------------------------------------------------


def fraud_type_profile(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("billing_amount_usd").cast("double").alias("_usd"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        F.col("event_type").alias("fraud_type"), "n", ratio(F.col("n"), F.col("_total")).alias("share"),
        rnd(F.col("_usd") / F.col("n"), 4).alias("avg_amount"))


def label_delay_profile(lake: Lake) -> DataFrame:
    """Days from event to fraud label: mean, median, largest, and how many take longer than 30 days."""
    delays = lake.labels.where("is_fraud").join(lake.auth_events.select("auth_event_id", "event_time"), "auth_event_id")
    day = ((micros(F.col("label_received_at")) - micros(F.col("event_time"))) / F.lit(8.64e10))
    rows = delays.select(day.alias("days"))
    n = F.count("*")
    figures = rows.agg(
        n.alias("n"), rnd(F.sum(F.col("days").cast(drift.EXACT)).cast("double") / n, 4).alias("mean_days"),
        rnd(F.max("days"), 4).alias("max_days"), F.count_if(F.col("days") > 30).alias("over_30"),
        ratio(F.count_if(F.col("days") > 30), n).alias("over_30_share"))
    median = quantiles.quantiles(rows, F.col("days"), {"median_days": 0.5})
    return figures.crossJoin(median.select(rnd(F.col("median_days"), 4).alias("median_days")))


def feature_separation(lake: Lake) -> DataFrame:
    """Per feature: mean of fraud over mean of genuine events, by the latest label."""
    label = economics.latest_label(lake.labels).select("auth_event_id", "is_fraud")
    rows = vectorized(lake.feature_events).select("auth_event_id", *C.FEATURES).join(label, "auth_event_id")
    long = drift.long_features(rows, C.FEATURES, ["is_fraud"])
    f = F.col("is_fraud")

    def average(test: Column) -> Column:
        return F.sum(F.when(test, F.col("value").cast(drift.EXACT))).cast("double") / F.count_if(test)

    means = long.groupBy("feature").agg(average(f).alias("a"), average(~f).alias("b"))
    return means.select("feature", rnd(F.col("a"), 4).alias("fraud_mean"), rnd(F.col("b"), 4).alias("legit_mean"),
                        rnd(F.col("a") / (F.col("b") + F.lit(1e-9)), 4).alias("separation"))


def detection_rate(scored: DataFrame) -> DataFrame:
    caught = F.count_if(F.col("raw_probability") > C.THRESHOLD_STEP_UP)
    return scored.groupBy(F.col("event_type").alias("fraud_type")).agg(
        F.count("*").alias("n"), caught.alias("caught"), ratio(caught, F.count("*")).alias("rate"))


def false_positive_concentration(lake: Lake) -> DataFrame:
    """Share of each channel in the genuine events scored above the step-up cut."""
    label = economics.latest_label(lake.labels).where(~F.col("is_fraud")).select("auth_event_id")
    wrong = lake.scored_events.where(F.col("raw_probability") > C.THRESHOLD_STEP_UP).join(label, "auth_event_id")
    counts = wrong.groupBy("channel").agg(F.count("*").alias("n"))
    # One row per channel.
    return counts.select("channel", "n", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def ks_two_sample(scored: DataFrame) -> DataFrame:
    return drift.ks_statistic(scored, F.col("raw_probability"), F.col("event_time") >= _at(DRIFT_SPLIT))


# --- governance ----------------------------------------------------------------------------------------------------------------


def model_name(customer: Column) -> Column:
    """The model a registry event of the test data is about."""
    family = F.element_at(F.array(F.lit("xgb"), F.lit("lgb"), F.lit("nn")), (customer % 3 + 1).cast("int"))
    return F.concat(family, F.lit("-m"), customer % 20)


def registry_log(lake: Lake) -> DataFrame:
    """Register, promote and other requests derived from the event stream."""
    action = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "purchase", "promote")
    return lake.events.withColumn("action", action).where("action is not null").select(
        model_name(F.col("user_id")).alias("model_version"), "action", F.col("ts").alias("event_time"), "event_id",
        F.concat(F.lit("owner_"), F.col("user_id")).alias("actor"))


def model_registry(log: DataFrame) -> DataFrame:
    """Registry state: the first registration opens a model in staging, the first promotion after it puts the model
    into production, every other request is refused. Positions, not a row-by-row fold, decide."""
    position = F.struct("event_time", "event_id")
    first = log.where("action = 'register'").groupBy("model_version").agg(
        F.min(F.struct("event_time", "event_id", "actor")).alias("r")).select(
        "model_version", F.struct("r.event_time", "r.event_id").alias("_at"), F.col("r.event_time").alias("registered_at"),
        F.col("r.actor").alias("owner"))
    after = log.join(first.select("model_version", "_at"), "model_version", "left").groupBy("model_version").agg(
        F.min(F.when((F.col("action") == "promote") & (position > F.col("_at")),
                     F.struct("event_time", "event_id", "actor"))).alias("p"), F.count("*").alias("requests"))
    done = F.col("p").isNotNull()
    return after.join(first, "model_version", "left").select(
        "model_version",
        F.when(done, "production").when(F.col("registered_at").isNotNull(), "staging").alias("deployment_status"),
        "owner", "registered_at", F.col("p.event_time").alias("promoted_at"), F.col("p.actor").alias("approved_by"),
        (F.col("requests") - F.when(F.col("registered_at").isNotNull(), 1).otherwise(0)
         - F.when(done, 1).otherwise(0)).alias("refused"))


def model_performance(lake: Lake, groups: dict[str, Column]) -> DataFrame:
    """Champion-score metrics of the events of each registered model."""
    label = economics.latest_label(lake.labels).select("auth_event_id", "is_fraud")
    rows = lake.scored_events.select(
        "auth_event_id", F.col("raw_probability").alias("probability"),
        F.col("billing_amount_usd").alias("amount_usd"), *[c.alias(n) for n, c in groups.items()]).join(
        label, "auth_event_id")
    names = list(groups)
    ordered = curves.scores_in_order(rows, names)
    return curves.ranking_metrics(ordered, names).join(
        curves.confusion(ordered, names, C.THRESHOLD_DECLINE, C.THRESHOLD_REVIEW), names)


def model_health(lake: Lake) -> DataFrame:
    """Registered models with their latest daily evaluation and drift alerts: healthy, degraded (< 3) or critical."""
    name = model_name(F.col("customer_id"))
    daily = model_performance(lake, {"model_version": name, "eval_date": F.to_date("event_time")})
    last = latest(daily, ["model_version"], ["eval_date"], ["eval_date", "auc_roc"])
    alerts = feature_drift(lake.feature_events.withColumn("model_version", name), ["model_version"]).groupBy(
        "model_version").agg(F.count_if("alert").alias("drift_alerts"))
    n = F.coalesce("drift_alerts", F.lit(0))
    return model_registry(registry_log(lake)).where("deployment_status is not null").select(
        "model_version", "deployment_status", "owner").join(last, "model_version", "left").join(
        alerts, "model_version", "left").select(
        "model_version", "deployment_status", "owner", "auc_roc", "eval_date", n.alias("drift_alerts"),
        F.when(n == 0, "healthy").when(n < 3, "degraded").otherwise("critical").alias("health"))


def mean_contributions(vectors: DataFrame, groups: list[str]) -> DataFrame:
    """Mean contribution per feature as an importance table."""
    long = drift.long_features(vectors, C.FEATURES, groups)
    return long.groupBy(*groups, "feature").agg(
        rnd(F.sum(F.col("value").cast(drift.EXACT)).cast("double") / F.count("*") * 0.1, 4).alias("importance"))


def top_importance(lake: Lake, limit: int = 10) -> DataFrame:
    return mean_contributions(vectorized(lake.feature_events), []).orderBy(
        F.col("importance").desc(), "feature").limit(limit)


def model_cards(lake: Lake) -> DataFrame:
    """One card per registered model: type, thresholds with their fallbacks, performance, importances, promotion."""
    name = model_name(F.col("customer_id"))
    performance = model_performance(lake, {"model_version": name}).select(
        "model_version", "auc_roc", "auc_pr", "precision", "recall", "f1")
    weights = mean_contributions(vectorized(lake.feature_events).withColumn("model_version", name), ["model_version"])
    order = Window.partitionBy("model_version").orderBy(F.col("importance").desc(), "feature")
    # At most 19 rows per model.
    top = weights.withColumn("_rank", F.row_number().over(order)).where("_rank <= 10").groupBy("model_version").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "feature"))), lambda r: r["feature"]),
                     ",").alias("top_importances"))
    number = F.regexp_extract("model_version", "([0-9]+)$", 1).cast("int")
    own = F.when(number % 2 == 0, F.lit(0.8))
    registry = model_registry(registry_log(lake)).where("deployment_status is not null")
    return registry.join(performance, "model_version", "left").join(top, "model_version", "left").select(
        "model_version",
        F.when(F.col("model_version").startswith("xgb"), "xgboost").when(
            F.col("model_version").startswith("lgb"), "lightgbm").otherwise("unknown").alias("model_type"),
        F.lit(C.FEATURE_VERSION).alias("feature_version"),
        F.coalesce(own, F.lit(C.THRESHOLD_DECLINE)).alias("threshold_decline"),
        F.lit(C.THRESHOLD_REVIEW).alias("threshold_review"), F.lit(C.THRESHOLD_STEP_UP).alias("threshold_step_up"),
        "auc_roc", "auc_pr", "precision", "recall", "f1", "top_importances", "deployment_status", "approved_by",
        F.date_format("promoted_at", "yyyy-MM-dd HH:mm:ss").alias("deployed_at"), F.col("refused").alias("refused_requests"))


def model_card_diff(cards: DataFrame, version_a: Column | str | None = None, version_b: str | None = None) -> DataFrame:
    """Fields that differ between two cards; without names, between the first and the last model by name."""
    fields = [c for c in cards.columns if c != "model_version"]
    kinds = dict(cards.dtypes)

    def text(name: str) -> Column:
        return F.format_string("%.6f", name) if kinds[name] == "double" else F.col(name).cast("string")

    pairs = [item for c in fields for item in (F.lit(c), F.when(F.col(c).isNotNull(), text(c)))]
    long = cards.select("model_version", F.stack(F.lit(len(fields)), *pairs).alias("field", "value"))
    ends = cards.agg(F.min("model_version").alias("_a"), F.max("model_version").alias("_b"))
    if version_a is not None:
        ends = ends.select(F.lit(version_a).alias("_a"), F.lit(version_b).alias("_b"))
    return long.crossJoin(F.broadcast(ends)).groupBy("field").agg(
        F.max(F.when(F.col("model_version") == F.col("_a"), F.col("value"))).alias("version_a"),
        F.max(F.when(F.col("model_version") == F.col("_b"), F.col("value"))).alias("version_b"),
    ).where(~F.col("version_a").eqNullSafe(F.col("version_b")))
