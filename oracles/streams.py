"""SQL checks: similarity and streaming results, which must equal the batch answer over the same files."""

from __future__ import annotations

import oracles.graph  # noqa: F401  (its fragments)
from oracles.base import r, sql
from oracles.core import BODIES as CORE
from riskspark.constants import FEATURES

_counts = [f for f in FEATURES if "_count_" in f]
BODIES = {
    "similar_cases": f"""WITH long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings), profile AS (SELECT label, i, avg(x) AS x FROM long GROUP BY ALL),
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM long GROUP BY 1), pnorms AS (SELECT label, sqrt(sum(x * x)) AS n FROM profile GROUP BY 1),
scores AS (SELECT p.label AS query_id, l.vec_id, any_value(l.label) AS category, {r('sum(p.x * l.x) / any_value(n.n) / any_value(q.n)', 6)} AS score
  FROM long l JOIN profile p USING (i) JOIN norms n USING (vec_id) JOIN pnorms q ON q.label = p.label GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
  vec_id AS case_id, category, score FROM scores
QUALIFY rank <= 5""",
    "similar_to_cases": f"""WITH long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings), norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM long GROUP BY 1),
scores AS (SELECT q.vec_id AS query_id, l.vec_id, any_value(l.label) AS category, {r('sum(q.x * l.x) / any_value(n.n) / any_value(m.n)', 6)} AS score
  FROM long q JOIN long l USING (i) JOIN norms n ON n.vec_id = l.vec_id JOIN norms m ON m.vec_id = q.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
  vec_id AS case_id, category, score FROM scores
QUALIFY rank <= 5""",
    "st_ingest": f"SELECT auth_event_id, errors FROM ({CORE['contract_auth_event']})",
    "st_velocity": f"SELECT auth_event_id, {', '.join(_counts)} FROM vectors",
    "st_score": "SELECT auth_event_id, calibrated_probability, final_score, decision FROM scored",
    "st_ops_tumbling": """SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, endpoint, count(*) AS n,
  count(*) FILTER (status >= 400) AS errors FROM ops_metrics GROUP BY ALL""",
    "st_ops_sliding": """SELECT time_bucket(INTERVAL 1 MINUTE, event_time) - k * INTERVAL 1 MINUTE AS window_start, count(*) AS n,
  count(*) FILTER (status <> 200) AS fallbacks, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
  quantile_disc(latency_ms, 0.99) AS p99 FROM ops_metrics CROSS JOIN range(5) t(k) GROUP BY 1""",
    "st_rule_topk": """SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, rule_name, count(*) AS fires,
  row_number() OVER (PARTITION BY window_start ORDER BY count(*) DESC, rule_name) AS rank
FROM fired JOIN stored_events USING (auth_event_id) GROUP BY 1, 2 QUALIFY rank <= 10""",
    "st_label_join": """SELECT auth_event_id, customer_id, label_id, is_fraud,
  (epoch_us(label_received_at) - epoch_us(event_time)) // 1000000 AS delay_seconds
FROM auth_events JOIN fraud_labels USING (auth_event_id)
WHERE label_received_at BETWEEN event_time AND event_time + INTERVAL 120 DAY""",
    "st_late": "SELECT count(*) AS applied, 0 AS dropped FROM auth_events",
}
ORACLES = {name: sql(body) if not body.startswith("WITH") else body for name, body in BODIES.items()}
