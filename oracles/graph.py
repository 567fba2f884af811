"""SQL checks: the entity graph. Neighbourhoods and components are checked by listing all reachable pairs."""

from __future__ import annotations

import oracles.evaluation  # noqa: F401  (its fragments)
from oracles.base import FRAGMENTS, HIGH_FIRED, heuristic, r, ratio, rule_score_sql, sigmoid, sql
from riskspark import constants as C

_pairs = {
    "account_device": ("'account:' || account_id", "'device:' || device_id"),
    "account_ip": ("'account:' || account_id", "'ip:' || ip_address"),
    "device_ip": ("'device:' || device_id", "'ip:' || ip_address"),
    "account_card": ("'account:' || account_id", "'card:' || card_id"),
    "device_merchant": ("'device:' || device_id", "'merchant:' || merchant_id"),
}


def _links(kinds):
    return " UNION ALL ".join(f"SELECT event_time, '{k}' AS edge_type, {_pairs[k][0]} AS src, {_pairs[k][1]} AS dst "
                              f"FROM stored_events" for k in kinds)


_nodes = ("'account:' || account_id", "'device:' || device_id", "'ip:' || ip_address", "'card:' || card_id",
          "'merchant:' || merchant_id")
FRAGMENTS.update({
    "graph_edges": f"""SELECT src, dst, edge_type, least(CAST(count(*) AS DOUBLE), 50.0) AS weight
FROM ({_links(['account_device', 'account_ip', 'device_ip'])}) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3""",
    "graph_pairs": "SELECT src AS a, dst AS b FROM graph_edges UNION SELECT dst, src FROM graph_edges",
    "graph_nodes": f"""SELECT node, split_part(node, ':', 1) AS node_type, coalesce(risk, 0) AS risk FROM (
SELECT DISTINCT unnest(['account:' || account_id, 'device:' || device_id, 'ip:' || ip_address]) AS node FROM stored_events)
LEFT JOIN (SELECT 'account:' || account_id AS node, least({ratio("count(*) FILTER (f) * 4", "count(*)", 4)}, 1.0) AS risk
  FROM (SELECT account_id, auth_event_id IN (SELECT auth_event_id FROM fraud_labels WHERE is_fraud) AS f FROM stored_events)
  GROUP BY 1
  UNION ALL SELECT 'device:' || device_id, {r("CASE WHEN emulator_flag THEN 0.4 ELSE 0.1 END + CASE WHEN rooted_jailbroken_flag THEN 0.3 ELSE 0.0 END", 4)}
  FROM dim_device
  UNION ALL SELECT 'ip:' || ip_address, CASE WHEN proxy_vpn_tor_flag THEN 0.6 ELSE 0.1 END FROM dim_ip) USING (node)
WHERE node IS NOT NULL""",
    "mule_nodes": """SELECT a AS node FROM graph_pairs WHERE a LIKE 'account:%' AND b NOT LIKE 'account:%' AND b IN (
  SELECT a FROM graph_pairs WHERE b LIKE 'account:%' GROUP BY a HAVING count(*) >= 3) GROUP BY a HAVING count(*) >= 2""",
    "two_hops": """SELECT a AS root, b AS node FROM graph_pairs WHERE a LIKE 'account:%'
UNION SELECT p.a, q.b FROM graph_pairs p JOIN graph_pairs q ON q.a = p.b WHERE p.a LIKE 'account:%' AND q.b <> p.a""",
    "reach": """SELECT node, node AS root FROM graph_nodes UNION SELECT p.b, reach.root FROM reach JOIN graph_pairs p ON p.a = reach.node""",
    "comps": "SELECT node, min(root) AS component FROM reach GROUP BY node",
    "hop_totals": """SELECT n.node AS root, count(m.node) AS n_nodes, count(*) FILTER (m.node_type = 'account') AS n_accounts,
  count(*) FILTER (m.node_type = 'device') AS n_devices, count(*) FILTER (m.node_type = 'ip') AS n_ips,
  count(*) FILTER (m.risk > 0.5) AS n_risky, coalesce(CAST(sum(CAST(m.risk AS DECIMAL(20,4))) AS DOUBLE), 0) AS risk,
  count(*) FILTER (m.node IN (SELECT node FROM mule_nodes)) AS n_mules, any_value(n.risk) AS own
FROM graph_nodes n LEFT JOIN two_hops t ON t.root = n.node LEFT JOIN graph_nodes m ON m.node = t.node
WHERE n.node_type = 'account' GROUP BY 1""",
    "account_risk": f"""SELECT CAST(substr(root, 9) AS BIGINT) AS account_id, n_nodes + 1 AS cluster_size,
  n_risky + (own > 0.5)::INT AS risky_neighbor_count, {ratio('risk', 'n_nodes', 4)} AS hop2_risk_score,
  n_accounts + 1 >= 3 AND n_devices >= 2 AS synthetic_identity,
  n_accounts + 1 >= 4 AND n_mules + (root IN (SELECT node FROM mule_nodes))::INT >= 1 AS mule_pattern FROM hop_totals""",
    "comp_totals": """SELECT component, count(*) AS n_nodes, count(*) FILTER (node_type = 'account') AS n_accounts,
  count(*) FILTER (node_type = 'device') AS n_devices, count(*) FILTER (node_type = 'ip') AS n_ips,
  count(*) FILTER (risk > 0.5) AS n_risky, CAST(sum(CAST(risk AS DECIMAL(20,4))) AS DOUBLE) AS risk,
  count(*) FILTER (node IN (SELECT node FROM mule_nodes)) AS n_mules, array_to_string(list_sort(list(node))[1:50], ',') AS nodes
FROM comps JOIN graph_nodes USING (node) GROUP BY 1""",
    "ring_rows": f"""SELECT component AS cluster_id, n_nodes AS node_count, n_accounts AS account_count, n_devices AS shared_devices,
  n_ips AS shared_ips, {r('risk / n_nodes', 6)} AS avg_risk_score, least(s, 1.0) AS ring_score, nodes FROM (
SELECT *, {r('''CASE WHEN n_accounts >= 3 AND n_devices >= 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN n_ips >= 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + risk / n_nodes * 0.5::DOUBLE''', 6)} AS s
FROM comp_totals WHERE n_nodes >= 3 AND n_accounts >= 2) WHERE s > 0.3""",
    "busiest": """SELECT 'account:' || account_id AS root FROM stored_events GROUP BY account_id
ORDER BY count(*) DESC, account_id LIMIT 1""",
    "hops": """SELECT root AS node, 0 AS hop FROM busiest UNION SELECT p.b, hops.hop + 1 FROM hops JOIN graph_pairs p
ON p.a = hops.node WHERE hops.hop < 3""",
    "near": "SELECT node, min(hop) AS hop FROM hops GROUP BY 1 HAVING min(hop) > 0",
    "risky_vectors": """SELECT v.* REPLACE (coalesce(a.hop2_risk_score, 0) AS graph_cluster_risk_score)
FROM vectors v LEFT JOIN account_risk a USING (account_id)""",
})
BODIES = {
    "graph_edges": "SELECT * FROM graph_edges",
    "edge_type_profile": f"SELECT edge_type, count(*) AS n, {r('avg(weight)', 4)} AS avg_weight FROM graph_edges GROUP BY 1",
    "graph_upsert": f"""SELECT src, dst, edge_type, CAST(count(*) AS DOUBLE) AS weight, min(event_time) AS first_seen,
  max(event_time) AS last_seen FROM ({_links(_pairs)}) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT node, NULL, 'node', NULL, min(event_time), max(event_time)
FROM (SELECT event_time, unnest([{', '.join(_nodes)}]) AS node FROM stored_events) WHERE node IS NOT NULL GROUP BY 1""",
    "graph_node_risk": "SELECT * FROM graph_nodes",
    "graph_components": "SELECT * FROM comps",
    "graph_components_grown": "SELECT * FROM comps",
    "graph_khop": "SELECT root, n_nodes, n_accounts, n_devices, n_ips FROM hop_totals",
    "graph_risk": """SELECT a.*, c.component AS cluster_id FROM account_risk a JOIN comps c ON c.node = 'account:' || a.account_id""",
    "graph_synthetic": "SELECT account_id, synthetic_identity FROM account_risk",
    "graph_mule": "SELECT account_id, mule_pattern FROM account_risk",
    "graph_rings": "SELECT * FROM ring_rows",
    "top_rings": "SELECT * EXCLUDE (nodes) FROM ring_rows ORDER BY ring_score DESC, cluster_id LIMIT 20",
    "graph_expand": """SELECT (SELECT root FROM busiest) AS center_node, w.within, node, node_type, risk,
  (SELECT sum(4 - hop) FROM near)::BIGINT AS total_reachable, (SELECT count(*) FROM near) AS distinct_reachable
FROM near JOIN graph_nodes USING (node) JOIN range(1, 4) w(within) ON w.within >= near.hop""",
    "graph_cluster_analysis": f"""SELECT t.component AS cluster_id, n_nodes AS node_count, coalesce(e.n, 0) AS edge_count,
  {ratio('n_risky', 'n_nodes')} AS risky_share, n_risky AS high_risk_nodes,
  CASE WHEN n_accounts >= 4 AND n_mules >= 1 THEN 'mule' WHEN n_accounts >= 3 AND n_devices >= 2 THEN 'synthetic_identity'
    ELSE 'none' END AS pattern_type
FROM comp_totals t LEFT JOIN (SELECT component, count(*) AS n FROM graph_pairs JOIN comps ON comps.node = a WHERE a < b GROUP BY 1) e
  USING (component)""",
    "graph_cluster_feature": f"""SELECT auth_event_id, graph_cluster_risk_score, {r('fraud_probability', 6)} AS fraud_probability,
  {r('calibrated_probability', 6)} AS calibrated_probability, {r('final_score', 6)} AS final_score, CASE WHEN final_score >= 0.85 THEN 'hard_decline' WHEN final_score >= 0.55 OR high THEN 'manual_review'
    WHEN final_score >= 0.35 THEN 'step_up' ELSE 'approve' END AS decision FROM (
SELECT *, 0.7::DOUBLE * calibrated_probability + 0.3::DOUBLE * rule_score AS final_score FROM (
SELECT *, {sigmoid('fraud_probability')} AS calibrated_probability FROM (
SELECT auth_event_id, graph_cluster_risk_score, {heuristic("'" + C.CHAMPION_VERSION + "'")} AS fraud_probability,
  {rule_score_sql()} AS rule_score, {HIGH_FIRED} AS high FROM risky_vectors)))""",
    "j_txn_360": """SELECT e.auth_event_id, e.customer_id, e.auth_amount, 2 AS n_scores,
  (SELECT string_agg(risk_band, ',' ORDER BY shadow) FROM all_scores s WHERE s.auth_event_id = e.auth_event_id) AS bands,
  f.rules AS fired_rules, d.decision_type, l.labels, y.life AS lifecycle, a.cluster_size, a.hop2_risk_score AS graph_risk
FROM stored_events e LEFT JOIN (SELECT auth_event_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM fired GROUP BY 1) f
  USING (auth_event_id) LEFT JOIN latest_decision d USING (auth_event_id)
LEFT JOIN (SELECT auth_event_id, string_agg(label_source, ',' ORDER BY label_received_at, label_id) AS labels
  FROM fraud_labels GROUP BY 1) l USING (auth_event_id)
LEFT JOIN (SELECT auth_event_id, string_agg(event_type, ',' ORDER BY step) AS life FROM lifecycle GROUP BY 1) y USING (auth_event_id)
LEFT JOIN account_risk a USING (account_id)""",
}
ORACLES = {name: sql(body) for name, body in BODIES.items()}
