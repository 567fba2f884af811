"""The 19 point-in-time features of every authorization event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.constants import DAY, FEATURES, HOUR, MINUTE
from riskspark.functions.geo import haversine_km, with_coordinates
from riskspark.functions.numeric import micros, rnd
from riskspark.operators import ranges, sketches
from riskspark.operators.skew import with_groups

P95_HORIZON = 90 * DAY
# --- fixed values: horizons per entity ------------------------------------------------------------------------------
CUSTOMER_SHORT, CUSTOMER_LONG = HOUR, DAY
CARD_SHORT = 10 * MINUTE
MERCHANT_SHORT, MERCHANT_LONG = 10 * MINUTE, 30 * DAY
DEVICE_SHORT, DEVICE_ACCOUNTS = DAY, 30 * DAY
IP_MEMBERS = 7 * DAY

# An entity is one string: a letter for its kind, then its key.
CUSTOMER, CARD, MERCHANT, DEVICE, IP = "c", "k", "m", "d", "i"
ENTITY_KEYS = {
    CUSTOMER: "customer_id", CARD: "card_id", MERCHANT: "merchant_id", DEVICE: "device_id", IP: "ip_address",
}
# Three running measures serve every kind:
#            m1                    m2                    m3
# customer   events in 1 h         events in 24 h        cents in 24 h
# card       events in 10 min
# merchant   events in 10 min      events in 30 d        chargebacks in 30 d
# device     events in 1 d         accounts in 30 d
# address    cards in 7 d          accounts in 7 d
MEASURES = ["m1", "m2", "m3"]
TOTALS = {
    "customer_txn_count_1h": (CUSTOMER, "m1"), "customer_txn_count_24h": (CUSTOMER, "m2"),
    "customer_spend_24h": (CUSTOMER, "m3"), "card_txn_count_10m": (CARD, "m1"), "merchant_txn_count_10m": (MERCHANT, "m1"),
    "merchant_chargeback_rate_30d": (MERCHANT, "m3"), "device_txn_count_1d": (DEVICE, "m1"),
    "device_account_count_30d": (DEVICE, "m2"), "ip_account_count_7d": (IP, "m2"), "ip_card_count_7d": (IP, "m1"),
}
#: Features that count distinct members: kind of entity, measure, member.
MEMBERS = {
    "device_account_count_30d": (DEVICE, "m2", "account_id"), "ip_account_count_7d": (IP, "m2", "account_id"),
    "ip_card_count_7d": (IP, "m1", "card_id"),
}
P95 = {"amount_vs_customer_p95_ratio": (CUSTOMER, "customer_p95"), "amount_vs_merchant_p95_ratio": (MERCHANT, "merchant_p95")}
PREVIOUS = ["geo_distance_from_last_txn_km", "seconds_since_last_txn"]
DIMENSIONS = ["geo_distance_from_home_km", "geo_distance_from_last_txn_km", "proxy_vpn_tor_flag", "device_risk_score"]


def entity_of(kind: str) -> str:
    return f"concat('{kind}', {ENTITY_KEYS[kind]})"


def _timed(events: DataFrame) -> DataFrame:
    return events.select(
        "auth_event_id", *ENTITY_KEYS.values(), "account_id", micros(F.col("event_time")).alias("t"),
        (F.col("billing_amount_usd") * 100).cast("bigint").alias("cents"))


def _stacked(rows: list[list[str]], names: list[str]) -> str:
    return f"stack({len(rows)}, {', '.join(', '.join(row) for row in rows)}) as ({', '.join(names)})"


def entity_rows(events: DataFrame, kinds: list[str] = list(ENTITY_KEYS)) -> DataFrame:
    """One narrow row per (event, entity of these kinds it touches)."""
    stack = _stacked([[entity_of(kind)] for kind in kinds], ["entity"])
    return _timed(events).selectExpr("auth_event_id", "t", stack).where("entity is not null")


def _event_changes(events: DataFrame, entities: list[str]) -> DataFrame:
    """Events of one entity at one time collapse to a count; the count is a gain now and a loss when each horizon of
    the entity's kind has passed."""
    stack = _stacked([[entity_of(kind)] for kind in entities], ["entity"])
    at_time = _timed(events).selectExpr(stack, "t", "cents").where("entity is not null").groupBy("entity", "t").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))
    kinds = {
        CUSTOMER: (CUSTOMER_SHORT, CUSTOMER_LONG), CARD: (CARD_SHORT, None), MERCHANT: (MERCHANT_SHORT, MERCHANT_LONG),
        DEVICE: (DEVICE_SHORT, None),
    }

    def horizon(which: int) -> str:
        cases = " ".join(f"when '{k}' then {spans[which]}L" for k, spans in kinds.items() if spans[which])
        return f"case kind {cases} end"

    spend = f"if(kind = '{CUSTOMER}', cents, 0L)"
    rows = [
        ["t", f"if(kind = '{IP}', 0L, n)", f"if({horizon(1)} is null, 0L, n)", spend, "true"],
        [f"t + {horizon(0)} + 1L", "-n", "0L", "0L", "false"],
        [f"t + {horizon(1)} + 1L", "0L", "-n", f"-{spend}", "false"],
    ]
    kinded = at_time.selectExpr("entity", "substring(entity, 1, 1) as kind", "t", "n", "cents")
    return kinded.selectExpr("entity", _stacked(rows, ["t", *MEASURES, "here"])).where("t is not null")


def _member_changes(events: DataFrame, members: list[tuple[str, str, str]], hot: DataFrame | None = None) -> DataFrame:
    """Gains and losses for distinct members (kind of entity, measure, column)."""
    rows = [[entity_of(kind), f"'{measure}'", column] for kind, measure, column in members]
    pairs = _timed(events).selectExpr(_stacked(rows, ["entity", "measure", "member"]), "t").where("entity is not null")
    horizon = F.when(F.col("entity").startswith(DEVICE), F.lit(DEVICE_ACCOUNTS)).otherwise(F.lit(IP_MEMBERS))
    changes = ranges.live_members(pairs, ["entity", "measure"], "member", horizon, "n", hot)
    return changes.selectExpr(
        "entity", "t", "if(measure = 'm1', n, 0L) as m1", "if(measure = 'm2', n, 0L) as m2", "0L as m3",
        "false as here")


def _chargeback_changes(events: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """Chargebacks by the merchant of their authorization, counted from receipt."""
    merchants = events.selectExpr("auth_event_id", f"{entity_of(MERCHANT)} as entity")
    rows = chargebacks.select("auth_event_id", micros(F.col("chargeback_received_at")).alias("t")).join(
        merchants, "auth_event_id").where("entity is not null")
    changes = ranges.expiring(rows, F.col("t") + F.lit(MERCHANT_LONG + 1), {"m3": F.lit(1)}, ["entity"])
    return changes.selectExpr("entity", "t", "0L as m1", "0L as m2", "cast(m3 as bigint) as m3", "false as here")


def velocity_totals(events: DataFrame, chargebacks: DataFrame, names: list[str] = FEATURES,
                    hot: DataFrame | None = None) -> DataFrame:
    """The running measures that these features need, of each entity at every time at which it has an event."""
    kinds = [k for k in ENTITY_KEYS if any(TOTALS[n][0] == k for n in names if n in TOTALS)]
    changes = _event_changes(events, kinds)
    if members := [MEMBERS[n] for n in names if n in MEMBERS]:
        changes = changes.unionByName(_member_changes(events, members, hot))
    if "merchant_chargeback_rate_30d" in names:
        changes = changes.unionByName(_chargeback_changes(events, chargebacks))
    return ranges.running_totals(changes, ["entity"], MEASURES, keep=["here"], hot=hot).where("here").drop("here")


def amount_p95(events: DataFrame, hot: DataFrame | None = None, kinds: tuple[str, ...] = (CUSTOMER, MERCHANT)) -> DataFrame:
    """95th percentile of the amount over the last 90 days per entity of these kinds: (entity, t, quantile)."""
    stack = _stacked([[entity_of(kind)] for kind in kinds], ["entity"])
    rows = _timed(events).where("cents is not null").selectExpr(stack, "t", "cents as value").where(
        "entity is not null")
    return ranges.range_quantile(rows, "entity", P95_HORIZON, 0.95, hot).withColumn(
        "quantile", F.col("quantile") / 100)


def amount_p95_sketched(events: DataFrame, k: int = sketches.K) -> DataFrame:
    """The 95th percentile of the amount over the 90 whole days before the day of each event, for its customer and its
    merchant, from one sketch per entity and day: (auth_event_id, customer_p95, merchant_p95), null without amounts then.

    The exact feature ends at the event itself. This form ends at midnight, so that days can be stored as sketches.
    """
    stack = _stacked([[entity_of(kind)] for kind in (CUSTOMER, MERCHANT)], ["entity"])
    rows = _timed(events).selectExpr("auth_event_id", "t", "cents", stack)
    touched = rows.where("entity is not null")
    by_day = sketches.slice_sketches(touched, ["entity"], "t", "cents", DAY, k)
    days = sketches.moving_quantiles(by_day, ["entity"], P95_HORIZON // DAY, {"p95": 0.95}, k).drop("n")
    placed = touched.select("auth_event_id", "entity", sketches.slice_of(F.col("t"), DAY).alias("slice"))
    found = with_groups(placed, days, ["entity", "slice"], "rows")
    of = lambda kind: F.max(F.when(F.col("entity").startswith(kind), F.col("p95"))) / 100
    return events.select("auth_event_id").join(found.groupBy("auth_event_id").agg(
        of(CUSTOMER).alias("customer_p95"), of(MERCHANT).alias("merchant_p95")), "auth_event_id", "left")


def entity_kinds(names: list[str]) -> list[str]:
    """The kinds of entities whose timelines these features need."""
    asked = {TOTALS[n][0] for n in names if n in TOTALS} | {P95[n][0] for n in names if n in P95}
    return [k for k in ENTITY_KEYS if k in asked]


def velocity_features(events: DataFrame, chargebacks: DataFrame, hot: DataFrame | None = None,
                      names: list[str] = FEATURES) -> DataFrame:
    """One row per event with those counts, rates and percentiles of its entities that `names` need; features that share no
    timeline with them are not computed."""
    totals, p95 = [n for n in names if n in TOTALS], [n for n in names if n in P95]
    found = entity_rows(events, entity_kinds(names))
    if totals:
        found = found.join(velocity_totals(events, chargebacks, totals, hot), ["entity", "t"], "left")
    if p95:
        found = found.join(amount_p95(events, hot, tuple(P95[n][0] for n in p95)), ["entity", "t"], "left")

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("entity").startswith(kind), F.col(column)))

    def feature(name: str) -> Column:
        kind, column = TOTALS[name]
        if name == "customer_spend_24h":
            return (F.coalesce(of(kind, column), F.lit(0)).cast("decimal(20,0)") / 100).cast("decimal(18,2)").alias(name)
        if name == "merchant_chargeback_rate_30d":
            return F.coalesce(rnd(of(kind, column) / of(kind, "m2"), 4), F.lit(0.0)).alias(name)
        return F.coalesce(of(kind, column), F.lit(0)).cast("bigint").alias(name)

    return found.groupBy("auth_event_id").agg(
        *[feature(n) for n in totals], *[of(P95[n][0], "quantile").alias(P95[n][1]) for n in p95])


def previous_events(events: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Per event of a customer: the time of the previous event and the last address seen before it."""
    rows = events.where(F.col("customer_id").isNotNull()).select(
        "auth_event_id", F.expr(f"{entity_of(CUSTOMER)} as entity"), micros(F.col("event_time")).alias("t"), "ip_address")
    return ranges.with_previous(rows, "entity", "t", "auth_event_id", {"ip_address": "prev_ip"}, hot=hot)


def device_risk(device_id: Column, known: Column, emulator: Column, rooted: Column) -> Column:
    """0 without a device, 0.5 for an unknown one, else points for emulation and rooting."""
    points = F.when(emulator, F.lit(0.4)).otherwise(F.lit(0.0)) + F.when(rooted, F.lit(0.3)).otherwise(F.lit(0.0))
    return rnd(
        F.when(device_id.isNull(), F.lit(0.0)).when(known.isNull(), F.lit(0.5)).otherwise(F.least(points, F.lit(1.0))),
        4)


def with_dimensions(
    events: DataFrame, customers: DataFrame, devices: DataFrame, ips: DataFrame, places: DataFrame
) -> DataFrame:
    """Left joins to device, address and customer. Spark broadcasts a dimension when its size allows it."""
    device = devices.withColumnRenamed("device_id", "_device")
    ip = with_coordinates(ips, places, "geo_country_code", "geo_city").select(
        F.col("ip_address").alias("_ip"), "proxy_vpn_tor_flag", F.col("lat").alias("ip_lat"),
        F.col("lon").alias("ip_lon"))
    home = with_coordinates(customers, places, "home_country_code", "home_region").select(
        F.col("customer_id").alias("_customer"), F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon"))
    return (
        events.join(device, F.col("device_id") == F.col("_device"), "left")
        .join(ip, F.col("ip_address") == F.col("_ip"), "left")
        .join(home, F.col("customer_id") == F.col("_customer"), "left")
        .withColumn("device_risk_score", device_risk(
            F.col("device_id"), F.col("_device"), F.col("emulator_flag"), F.col("rooted_jailbroken_flag")))
        .withColumn("proxy_vpn_tor_flag", F.coalesce("proxy_vpn_tor_flag", F.lit(False)))
        .withColumn("geo_distance_from_home_km", rnd(
            haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("ip_lat"), F.col("ip_lon")), 3))
    )


def event_features(
    events: DataFrame, chargebacks: DataFrame, customers: DataFrame, devices: DataFrame, ips: DataFrame,
    places: DataFrame, hot_rows: int = ranges.HOT_ROWS, names: list[str] = FEATURES,
) -> DataFrame:
    """Events with the named features (all 19) as of their own time: frames are [t - horizon, t] and never see the future.
    Only the timelines, dimensions and joins that these features need are in the plan.

    Entities with more than `hot_rows` events are found first; their timelines are cut into slices.
    """
    any_of = lambda group: any(n in group for n in names)
    kinds = entity_kinds(names)
    if any_of(PREVIOUS) and CUSTOMER not in kinds:
        kinds = [CUSTOMER, *kinds]
    hot = ranges.hot_keys(entity_rows(events, kinds), "entity", hot_rows) if kinds else None
    joined, amount = events, F.col("auth_amount").cast("double")
    if any_of(DIMENSIONS):
        joined = with_dimensions(joined, customers, devices, ips, places)
    if any_of(PREVIOUS):
        joined = joined.join(
            previous_events(events, hot).select("auth_event_id", "t", "prev_t", "prev_ip"), "auth_event_id", "left")
    if "geo_distance_from_last_txn_km" in names:
        joined = joined.join(with_coordinates(ips, places, "geo_country_code", "geo_city").select(
            F.col("ip_address").alias("_last_ip"), F.col("lat").alias("last_lat"), F.col("lon").alias("last_lon")),
            F.col("prev_ip") == F.col("_last_ip"), "left")
    if any_of(TOTALS) or any_of(P95):
        # An event without any of these entities has no row there: nothing was counted.
        joined = joined.join(velocity_features(events, chargebacks, hot, names), "auth_event_id", "left").withColumns(
            {n: F.coalesce(n, F.lit(0)) for n in names if n in TOTALS})

    def against(p95: str) -> Column:
        return F.coalesce(
            F.when((F.col(p95) > 0) & (amount != 0), rnd(amount / F.col(p95), 4)), F.lit(0.0))

    derived = {
        "geo_distance_from_last_txn_km": lambda: F.when(
            F.col("ip_lat").isNotNull() & (F.col("prev_ip") == F.col("ip_address")), F.lit(0.0)).otherwise(
            rnd(haversine_km(F.col("last_lat"), F.col("last_lon"), F.col("ip_lat"), F.col("ip_lon")), 3)),
        "seconds_since_last_txn": lambda: F.expr("(t - prev_t) div 1000000"),
        "amount_vs_customer_p95_ratio": lambda: against("customer_p95"),
        "amount_vs_merchant_p95_ratio": lambda: against("merchant_p95"),
        "behavioral_risk_score": lambda: F.lit(0.0),
        "graph_cluster_risk_score": lambda: F.lit(0.0),
    }
    return joined.withColumns({n: column() for n, column in derived.items() if n in names}).select(*events.columns, *names)


def scoring_vector(features: DataFrame, *keep: str) -> DataFrame:
    """The model input: all 19 features as doubles, null as 0, flags as 0 or 1."""
    return features.select(*keep, *[
        F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name) for name in FEATURES])
