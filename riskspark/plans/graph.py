"""The entity graph of authorization events: nodes, edges, neighbourhood risk and rings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.functions.numeric import ratio, rnd
from riskspark.operators import graph as G
from riskspark.plans.decisions import score_events
from riskspark.plans.economics import within
from riskspark.plans.lake import Lake
from riskspark.session import checkpoint_dir

MAX_WEIGHT = 50.0
RISKY = 0.5
RING_NODES = 50
RISK_TYPE = "decimal(20,4)"


def _node(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def edges(events: DataFrame) -> DataFrame:
    """Account-device, account-address and device-address pairs with their number of events, at most 50."""
    account, device, ip = _node("account", "account_id"), _node("device", "device_id"), _node("ip", "ip_address")
    pairs = events.select(F.stack(
        F.lit(3), F.lit("account_device"), account, device, F.lit("account_ip"), account, ip,
        F.lit("device_ip"), device, ip).alias("edge_type", "src", "dst"))
    return pairs.where("src is not null and dst is not null").groupBy("src", "dst", "edge_type").agg(
        F.least(F.count("*").cast("double"), F.lit(MAX_WEIGHT)).alias("weight"))


def edge_type_profile(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("edge_type").agg(
        F.count("*").alias("n"),
        rnd(F.sum(F.col("weight").cast(RISK_TYPE)).cast("double") / F.count("*"), 4).alias("avg_weight"))


def sightings(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges seen in events, six entity kinds, with first and last time and the number of sightings."""
    account, device, ip = _node("account", "account_id"), _node("device", "device_id"), _node("ip", "ip_address")
    card, merchant = _node("card", "card_id"), _node("merchant", "merchant_id")
    email = _node("email", "email") if "email" in events.columns else F.lit(None).cast("string")
    seen = [F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen")]
    nodes = events.select("event_time", F.stack(F.lit(6), account, device, ip, email, card, merchant).alias("node"))
    node_rows = nodes.where("node is not null").groupBy("node").agg(*seen)
    links = events.select("event_time", F.stack(
        F.lit(6), F.lit("account_device"), account, device, F.lit("account_ip"), account, ip,
        F.lit("device_ip"), device, ip, F.lit("account_email"), account, email, F.lit("account_card"), account, card,
        F.lit("device_merchant"), device, merchant).alias("edge_type", "src", "dst"))
    edge_rows = links.where("src is not null and dst is not null").groupBy("src", "dst", "edge_type").agg(
        F.count("*").cast("double").alias("weight"), *seen)
    return node_rows, edge_rows


def merge_sightings(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union and re-aggregate: weights add up, first and last times widen."""
    weight = [F.sum("weight").alias("weight")] if "weight" in stored.columns else []
    return stored.unionByName(new).groupBy(*keys).agg(
        *weight, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def upsert(lake: Lake, split: str = "2024-01-20 00:00:00") -> DataFrame:
    """The graph stored before a time merged with what came later."""
    at = F.lit(split).cast("timestamp_ntz")
    old_nodes, old_edges = sightings(lake.auth_events.where(F.col("event_time") < at))
    new_nodes, new_edges = sightings(lake.auth_events.where(F.col("event_time") >= at))
    nodes = merge_sightings(old_nodes, new_nodes, ["node"])
    links = merge_sightings(old_edges, new_edges, ["src", "dst", "edge_type"])
    return links.unionByName(nodes.select(
        F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("node").alias("edge_type"),
        F.lit(None).cast("double").alias("weight"), "first_seen", "last_seen"))


def growing_components(lake: Lake, splits: tuple[str, ...] = ("2024-01-10", "2024-01-20")) -> DataFrame:
    """(node, component) of the graph, stored for the events before the first time and grown by those after each."""
    path = f"{checkpoint_dir(lake.spark)}/components-{uuid.uuid4().hex}"
    times = [None, *splits, None]
    for k, (start, end) in enumerate(zip(times[:-1], times[1:], strict=True)):
        links = edges(within(lake.auth_events, start, end))
        seen = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        if k == 0:
            G.store_components(path, lake.graph_nodes.select("node"), links)
        else:
            G.grow_components(path, seen, links)
    return G.stored_components(lake.spark, path)


def set_node_risk(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Nodes with new risk values where given, the old value (0 when none) elsewhere."""
    new = updates.select("node", F.col("risk").alias("_risk"))
    return nodes.join(new, "node", "left").withColumn("risk", F.coalesce("_risk", "risk", F.lit(0.0))).drop("_risk")


def nodes(lake: Lake) -> DataFrame:
    """Every account, device and address with its type and risk: fraud share, device risk, proxy use."""
    plain = lake.auth_events.select(F.stack(
        F.lit(3), _node("account", "account_id"), _node("device", "device_id"), _node("ip", "ip_address")).alias(
        "node")).where("node is not null").distinct().withColumns(
        {"node_type": F.substring_index("node", ":", 1), "risk": F.lit(0.0)})
    fraud = lake.labels.groupBy("auth_event_id").agg(F.bool_or("is_fraud").alias("is_fraud"))
    accounts = lake.auth_events.select("auth_event_id", "account_id").join(fraud, "auth_event_id", "left").groupBy(
        "account_id").agg(ratio(F.count_if("is_fraud") * 4, F.count("*"), 4).alias("risk")).select(
        _node("account", "account_id").alias("node"), F.least("risk", F.lit(1.0)).alias("risk"))
    devices = lake.devices.select(_node("device", "device_id").alias("node"), rnd(
        F.when(F.col("emulator_flag"), 0.4).otherwise(0.1) + F.when(F.col("rooted_jailbroken_flag"), 0.3).otherwise(0.0),
        4).alias("risk"))
    ips = lake.ips.select(_node("ip", "ip_address").alias("node"), F.when(
        F.col("proxy_vpn_tor_flag"), 0.6).otherwise(0.1).alias("risk"))
    return set_node_risk(plain, accounts.unionByName(devices).unionByName(ips))


def node_weights(node_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """What each node adds to a neighbourhood: itself, its type, its risk, and whether it is a mule-like account.

    Mule-like: an account with at least two devices or addresses that each touch at least three accounts.
    """
    kinds = node_rows.select(F.col("node").alias("b"), "node_type")
    accounts_at = pairs.join(kinds, "b").where("node_type = 'account'").groupBy("a").agg(F.count("*").alias("accounts"))
    shared = accounts_at.where("accounts >= 3").select(F.col("a").alias("b")).join(kinds, "b").where(
        "node_type in ('device', 'ip')").select("b")
    mules = pairs.join(shared, "b", "left_semi").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("shared"))
    kind = F.col("node_type")
    return node_rows.join(mules, "node", "left").select(
        "node", F.lit(1).alias("n_nodes"), (kind == "account").cast("int").alias("n_accounts"),
        (kind == "device").cast("int").alias("n_devices"), (kind == "ip").cast("int").alias("n_ips"),
        (kind == "email").cast("int").alias("n_emails"), (F.col("risk") > RISKY).cast("int").alias("n_risky"),
        F.col("risk").cast(RISK_TYPE).alias("risk"),
        ((kind == "account") & (F.coalesce("shared", F.lit(0)) >= 2)).cast("int").alias("n_mules"))


def synthetic(accounts: Column, devices: Column, emails: Column) -> Column:
    return (accounts >= 3) & (devices >= 2) & (emails <= 1)


def mule(accounts: Column, mules: Column) -> Column:
    return (accounts >= 4) & (mules >= 1)


def account_hops(lake: Lake, hub_degree: int | None = None) -> DataFrame:
    """Totals within two hops of every account."""
    roots = lake.graph_nodes.where("node_type = 'account'").select(F.col("node").alias("root"))
    return G.two_hop_totals(lake.graph_pairs, node_weights(lake.graph_nodes, lake.graph_pairs), roots, hub_degree)


def account_risk(lake: Lake, hub_degree: int | None = None) -> DataFrame:
    """Per account: cluster within two hops (the account included), risky members, mean risk of the others, patterns."""
    own = node_weights(lake.graph_nodes, lake.graph_pairs).select(
        F.col("node").alias("root"), F.col("n_risky").alias("own_risky"), F.col("n_mules").alias("own_mules"))
    around = account_hops(lake, hub_degree).join(own, "root")
    members = F.col("n_accounts") + 1
    return around.select(
        F.substring_index("root", ":", -1).cast("bigint").alias("account_id"), (F.col("n_nodes") + 1).alias("cluster_size"),
        (F.col("n_risky") + F.col("own_risky")).alias("risky_neighbor_count"),
        ratio(F.col("risk"), F.col("n_nodes"), 4).alias("hop2_risk_score"),
        synthetic(members, F.col("n_devices"), F.col("n_emails")).alias("synthetic_identity"),
        mule(members, F.col("n_mules") + F.col("own_mules")).alias("mule_pattern"))


def graph_risk(lake: Lake) -> DataFrame:
    """Account risk with the component it belongs to."""
    named = lake.graph_components.select(
        F.col("component").alias("cluster_id"), F.substring_index("node", ":", -1).alias("_id"),
        F.substring_index("node", ":", 1).alias("_kind")).where("_kind = 'account'")
    return lake.graph_risk.join(named, F.col("account_id") == F.col("_id").cast("bigint"), "left").drop("_id", "_kind")


def expand_busiest(lake: Lake, hops: int = 3) -> DataFrame:
    """Expansion of the account with most events: cumulative node lists per hop, and how many nodes they reach."""
    busiest = lake.auth_events.groupBy("account_id").agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), "account_id").limit(1).select(_node("account", "account_id").alias("root"))
    return cumulative_hops(G.expand(lake.graph_pairs, busiest, hops), lake.graph_nodes, hops)


def cumulative_hops(reached: DataFrame, node_rows: DataFrame, hops: int) -> DataFrame:
    lists = reached.join(node_rows, "node").withColumn(
        "within", F.explode(F.filter(F.sequence(F.lit(1), F.lit(hops)), lambda h: h >= F.col("hop"))))
    totals = lists.groupBy("root").agg(
        F.count("*").alias("total_reachable"), F.count_if(F.col("within") == hops).alias("distinct_reachable"))
    return lists.join(totals, "root").select(
        F.col("root").alias("center_node"), "within", "node", "node_type", "risk", "total_reachable",
        "distinct_reachable")


def component_totals(lake: Lake) -> DataFrame:
    weights = node_weights(lake.graph_nodes, lake.graph_pairs)
    names = [c for c in weights.columns if c != "node"]
    return lake.graph_components.join(weights, "node").groupBy("component").agg(*[F.sum(n).alias(n) for n in names])


def rings(lake: Lake, min_size: int = 3) -> DataFrame:
    """Components that look like rings, with a score and their first 50 nodes by id."""
    totals = component_totals(lake).where((F.col("n_nodes") >= min_size) & (F.col("n_accounts") >= 2))
    average = F.col("risk").cast("double") / F.col("n_nodes")
    score = (
        F.when((F.col("n_accounts") >= 3) & (F.col("n_devices") >= 1), F.lit(0.3)).otherwise(F.lit(0.0))
        + F.when(F.col("n_ips") >= 1, F.lit(0.2)).otherwise(F.lit(0.0)) + average * F.lit(0.5))
    found = totals.withColumn("ring_score", rnd(score, 6)).where("ring_score > 0.3D")
    order = Window.partitionBy("component").orderBy("node")
    # Spark keeps only the first 50 nodes per component before the shuffle.
    names = lake.graph_components.withColumn("_i", F.row_number().over(order)).where(
        F.col("_i") <= RING_NODES).groupBy("component").agg(
        F.array_join(F.sort_array(F.collect_list("node")), ",").alias("nodes"))
    return found.join(names, "component").select(
        F.col("component").alias("cluster_id"), F.col("n_nodes").alias("node_count"),
        F.col("n_accounts").alias("account_count"), F.col("n_devices").alias("shared_devices"),
        F.col("n_ips").alias("shared_ips"), rnd(average, 6).alias("avg_risk_score"),
        F.least("ring_score", F.lit(1.0)).alias("ring_score"), "nodes")


def top_rings(lake: Lake, limit: int = 20) -> DataFrame:
    return rings(lake).drop("nodes").orderBy(F.col("ring_score").desc(), "cluster_id").limit(limit)


def cluster_analysis(lake: Lake) -> DataFrame:
    """Per component: nodes, edges, share of risky nodes and the pattern it shows."""
    totals = component_totals(lake)
    links = lake.graph_pairs.where("a < b").join(
        lake.graph_components, F.col("a") == F.col("node")).groupBy("component").agg(F.count("*").alias("edge_count"))
    pattern = F.when(mule(F.col("n_accounts"), F.col("n_mules")), "mule").when(
        synthetic(F.col("n_accounts"), F.col("n_devices"), F.col("n_emails")), "synthetic_identity").otherwise("none")
    return totals.join(links, "component", "left").select(
        F.col("component").alias("cluster_id"), F.col("n_nodes").alias("node_count"),
        F.coalesce("edge_count", F.lit(0)).alias("edge_count"), ratio(F.col("n_risky"), F.col("n_nodes")).alias("risky_share"),
        F.col("n_risky").alias("high_risk_nodes"), pattern.alias("pattern_type"))


def cluster_feature(lake: Lake) -> DataFrame:
    """Events re-scored with the graph risk of their account in the feature vector."""
    risk = lake.graph_risk.select("account_id", "hop2_risk_score")
    joined = lake.feature_events.join(risk, "account_id", "left").withColumn(
        "graph_cluster_risk_score", F.coalesce("hop2_risk_score", F.lit(0.0))).drop("hop2_risk_score")
    return score_events(joined).select(
        "auth_event_id", "graph_cluster_risk_score", "fraud_probability", "calibrated_probability", "final_score",
        "decision")
