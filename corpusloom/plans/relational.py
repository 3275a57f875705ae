"""Queries of the relational core: one SQL text that both engines run, or one for each.

Sums are cast to bigint, ranks too; every ORDER BY that decides something has a tie-break and says where nulls go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import standins

SHARED: dict[str, str] = {
    # Dashboard roll-up: partial sums by entity and day before the only shuffle; the dictionary is broadcast.
    "dashboard_summary": """
SELECT s.entity_id, e.canonical_name, CAST(scored_at AS DATE) AS day, count(*) AS mentions,
  count(*) FILTER (WHERE label = 'positive') AS positive_count, count(*) FILTER (WHERE label = 'negative') AS negative_count,
  count(*) FILTER (WHERE label = 'neutral') AS neutral_count, round(avg(score_positive - score_negative), 4) AS avg_polarity
FROM scores s JOIN entities e ON s.entity_id = e.entity_id
WHERE confidence >= 0.6 AND scored_at >= CAST('2023-11-02' AS DATE) AND scored_at < CAST('2024-02-01' AS DATE)
GROUP BY s.entity_id, e.canonical_name, CAST(scored_at AS DATE)""",
    "entity_highlights_topn": """
SELECT entity_id, polarity, doc_id, event_id, confidence, CAST(rn AS BIGINT) AS rn FROM (
  SELECT s.entity_id, label AS polarity, s.doc_id, event_id, confidence,
    row_number() OVER (PARTITION BY s.entity_id, label ORDER BY confidence DESC, scored_at DESC NULLS LAST, event_id) AS rn
  FROM scores s JOIN raw_texts r ON s.doc_id = r.doc_id
  WHERE s.entity_id IS NOT NULL AND label IN ('positive', 'negative') AND confidence >= 0.7 AND scored_at >= CAST('2024-01-01' AS DATE)) x
WHERE rn <= 5""",
    "highlights_read": """
SELECT entity_id, label AS polarity, doc_id, confidence, scored_at FROM scores
WHERE entity_id = 3 AND label = 'positive' ORDER BY label, scored_at DESC NULLS LAST, event_id LIMIT 10""",
    "national_index_monthly": """
SELECT CAST(date_trunc('month', scored_at) AS DATE) AS month, count(*) AS n, round(avg(score_positive - score_negative), 4) AS index_value
FROM scores WHERE entity_id IS NULL GROUP BY CAST(date_trunc('month', scored_at) AS DATE)""",
    "national_index_yearly": """
SELECT CAST(date_trunc('year', scored_at) AS DATE) AS year, count(*) AS n, round(avg(score_positive - score_negative), 4) AS index_value
FROM scores WHERE entity_id IS NULL GROUP BY CAST(date_trunc('year', scored_at) AS DATE)""",
    "entity_yearly": """
SELECT entity_id, CAST(date_trunc('year', scored_at) AS DATE) AS year, count(*) AS n, round(avg(score_positive - score_negative), 4) AS polarity
FROM scores WHERE entity_id IS NOT NULL GROUP BY entity_id, CAST(date_trunc('year', scored_at) AS DATE)""",
    "entity_ranking_7d": """
SELECT entity_id, n, score, CAST(dense_rank() OVER (ORDER BY score DESC) AS BIGINT) AS rank FROM (
  SELECT entity_id, count(*) AS n, round(avg(score_positive - score_negative), 4) AS score FROM scores
  WHERE entity_id IS NOT NULL AND confidence >= 0.6 AND scored_at >= CAST('2024-01-24' AS DATE) AND scored_at < CAST('2024-01-31' AS DATE) GROUP BY entity_id) x""",
    "entity_timeseries": """
SELECT entity_id, CAST(scored_at AS DATE) AS day, count(*) AS n, round(avg(score_positive - score_negative), 4) AS polarity
FROM scores WHERE entity_id IS NOT NULL AND scored_at >= CAST('2024-01-17' AS DATE) GROUP BY entity_id, CAST(scored_at AS DATE)""",
    "entity_hotness": """
SELECT entity_id, count(*) FILTER (WHERE scored_at >= CAST('2024-01-24' AS DATE)) AS mentions_7d, count(*) AS mentions_30d
FROM scores WHERE entity_id IS NOT NULL AND scored_at >= CAST('2024-01-01' AS DATE) AND scored_at < CAST('2024-01-31' AS DATE) GROUP BY entity_id""",
    "spike_alert_3sigma": """
SELECT entity_id, day, n, round(mean, 4) AS mean, round(sd, 4) AS sd, n > mean + 3 * sd AS spike FROM (
  SELECT entity_id, day, n, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd FROM (
    SELECT entity_id, CAST(scored_at AS DATE) AS day, count(*) AS n FROM scores WHERE entity_id IS NOT NULL GROUP BY entity_id, CAST(scored_at AS DATE)) d
  WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) x""",
    "trend_week_over_week": """
SELECT entity_id, week, polarity, round(polarity - lag(polarity) OVER (PARTITION BY entity_id ORDER BY week), 4) AS change,
  coalesce(polarity - lag(polarity) OVER (PARTITION BY entity_id ORDER BY week) < -0.1, false) AS drop_alert FROM (
  SELECT entity_id, CAST(date_trunc('week', scored_at) AS DATE) AS week, round(avg(score_positive - score_negative), 4) AS polarity
  FROM scores WHERE entity_id IS NOT NULL GROUP BY entity_id, CAST(date_trunc('week', scored_at) AS DATE)) x""",
    "head_to_head": """
SELECT CAST(date_trunc('week', scored_at) AS DATE) AS week, round(avg(CASE WHEN entity_id = 1 THEN score_positive - score_negative END), 4) AS left_polarity,
  round(avg(CASE WHEN entity_id = 2 THEN score_positive - score_negative END), 4) AS right_polarity, count(*) FILTER (WHERE entity_id = 1) AS left_n, count(*) FILTER (WHERE entity_id = 2) AS right_n
FROM scores WHERE entity_id IN (1, 2) GROUP BY CAST(date_trunc('week', scored_at) AS DATE)""",
    "content_type_by_source": """
SELECT source, CASE WHEN length(text) >= 500 THEN 'FULLTEXT' ELSE 'SNIPPET' END AS content_type, lang, count(*) AS n
FROM raw_texts WHERE source NOT LIKE 'src1%' GROUP BY source, CASE WHEN length(text) >= 500 THEN 'FULLTEXT' ELSE 'SNIPPET' END, lang""",
    "text_length_stats": """
SELECT lang, CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len, CAST(round(avg(length(text))) AS BIGINT) AS avg_len
FROM raw_texts WHERE length(text) > 0 GROUP BY lang""",
    "text_length_buckets": """
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN length(text) < 300 THEN 'a <300' WHEN length(text) < 500 THEN 'b 300-499' WHEN length(text) < 1000 THEN 'c 500-999'
  WHEN length(text) <= 20000 THEN 'd 1000-20000' ELSE 'e >20000' END AS bucket FROM raw_texts) x GROUP BY bucket""",
    "label_percentages": """
SELECT label, n, round(100.0 * n / sum(n) OVER (), 2) AS pct FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM scores GROUP BY label) x""",
    "per_entity_breakdown": """
SELECT entity_id, n, round(pos, 1) AS pos_pct, round(neg, 1) AS neg_pct, avg_confidence, greatest(pos, neg) > 70 AS biased FROM (
  SELECT entity_id, count(*) AS n, 100e0 * count(*) FILTER (WHERE label = 'positive') / count(*) AS pos, 100e0 * count(*) FILTER (WHERE label = 'negative') / count(*) AS neg,
    round(avg(confidence), 4) AS avg_confidence FROM scores WHERE entity_id IS NOT NULL GROUP BY entity_id HAVING count(*) >= 3) x""",
    "entropy_stats": """
SELECT count(*) AS n, round(avg(confidence), 4) AS mean_confidence, round(avg(h), 4) AS mean_entropy, round(100 * avg(CASE WHEN h > 0.95 * ln(3) THEN 1e0 ELSE 0e0 END), 2) AS uncertain_pct FROM (
  SELECT confidence, -(CASE WHEN score_negative > 1e-9 THEN score_negative * ln(score_negative) ELSE 0 END + CASE WHEN score_neutral > 1e-9 THEN score_neutral * ln(score_neutral) ELSE 0 END
    + CASE WHEN score_positive > 1e-9 THEN score_positive * ln(score_positive) ELSE 0 END) AS h FROM scores) x""",
    "confidence_calibration": """
SELECT bin, count(*) AS n, round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END), 4) AS accuracy, bin = 'd' AND avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) < 0.8 AS overconfident FROM (
  SELECT CASE WHEN confidence < 0.5 THEN 'a' WHEN confidence < 0.7 THEN 'b' WHEN confidence < 0.85 THEN 'c' ELSE 'd' END AS bin, (quality = 1) = (label = 'positive') AS correct
  FROM scores s JOIN labels l ON s.doc_id = l.doc_id) x GROUP BY bin""",
    "finetune_join_audit": """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN length(r.text) < 300 THEN 'article_short' WHEN s.confidence IS NULL THEN 'score_missing' WHEN length(r.title) < 50 THEN 'context_short' ELSE 'kept' END AS reason
  FROM raw_texts r LEFT JOIN (SELECT doc_id, max(confidence) AS confidence FROM scores WHERE entity_id = 3 GROUP BY doc_id) s ON r.doc_id = s.doc_id) x GROUP BY reason""",
    "insert_if_absent": """
SELECT CAST(sum(CASE WHEN h.text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(n.c) - sum(CASE WHEN h.text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicate
FROM (SELECT text, count(*) AS c FROM raw_texts WHERE doc_id % 4 <> 0 GROUP BY text) n LEFT JOIN (SELECT DISTINCT text FROM raw_texts WHERE doc_id % 4 = 0) h ON n.text = h.text""",
    "retry_state": """
SELECT event_id, CAST(attempts AS BIGINT) AS attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN attempts >= 3 THEN 'max_retries_exceeded' ELSE 'media_timeout' END AS reason
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempts FROM events WHERE event_type = 'error') x""",
    "constraint_violations": """
SELECT rule, count(*) AS n FROM (
  SELECT 'confidence_range' AS rule FROM scores WHERE NOT (confidence BETWEEN 0 AND 1)
  UNION ALL SELECT 'label_enum' FROM scores WHERE label NOT IN ('negative', 'neutral', 'positive')
  UNION ALL SELECT 'entity_null' FROM scores WHERE entity_id IS NULL
  UNION ALL SELECT 'document_reference' FROM scores s LEFT JOIN raw_texts r ON s.doc_id = r.doc_id WHERE r.doc_id IS NULL
  UNION ALL SELECT 'low_confidence' FROM scores WHERE confidence < 0.4) x GROUP BY rule""",
    "public_view": """
SELECT doc_id, title, lang, source FROM raw_texts WHERE length(text) >= 500""",
    "dialogue_neighbours": """
SELECT conv_id, turn, role, lag(role, 2) OVER w AS two_before, lag(role) OVER w AS before, lead(role) OVER w AS after, CAST(length(lead(text) OVER w) AS BIGINT) AS next_len
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "join_types": """
SELECT 'inner' AS kind, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'left', count(*) FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'right', count(*) FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey
UNION ALL SELECT 'full', count(*) FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey
UNION ALL SELECT 'semi', count(*) FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')
UNION ALL SELECT 'anti', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
    "set_operations": """
SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) b
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) c
UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) d""",
    "grouping_sets": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "rollup_orders": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "distinct_counts": """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""",
    "window_frames": """
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rnk, CAST(ntile(3) OVER w AS BIGINT) AS third
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "topk_orders": """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50""",
    "offset_page": """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200""",
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS DATE) GROUP BY l_returnflag, l_linestatus""",
    "regional_revenue": """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= CAST('1996-01-01' AS DATE) GROUP BY r_name, n_name""",
    "scalar_subquery": """
SELECT p_partkey, p_brand, p_retailprice FROM part p WHERE p_retailprice > (SELECT 1.2 * avg(p_retailprice) FROM part)""",
    "feed_counts": """
SELECT entity_type, count(*) AS n, count(*) FILTER (WHERE active) AS active_n FROM (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN 'person' ELSE 'party' END AS entity_type, entity_id % 4 <> 1 AS active FROM entities) x GROUP BY entity_type""",
    "dictionary_left_join": """
SELECT e.entity_id, e.canonical_name, count(t.term) AS aliases, min(t.term) AS first_alias FROM entities e LEFT JOIN terms t ON e.entity_id = t.entity_id AND NOT t.canonical GROUP BY e.entity_id, e.canonical_name""",
    "retention_keep_6_months": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders
WHERE o_orderdate >= CAST('2001-02-01' AS DATE) GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "delete_insert_scores": """
SELECT entity_id, doc_id, confidence FROM scores s WHERE event_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM scores n WHERE n.event_id % 10 = 0 AND n.doc_id = s.doc_id AND n.entity_id IS NOT DISTINCT FROM s.entity_id)
UNION ALL SELECT entity_id, doc_id, max(confidence) FROM scores WHERE event_id % 10 = 0 GROUP BY entity_id, doc_id""",
}

#: Spark, then the other engine.
PAIRS: dict[str, tuple[str, str]] = {
    "hourly_rollup": (
        "SELECT CAST(date_trunc('hour', scored_at) AS TIMESTAMP_NTZ) AS hour, label, count(*) AS n, round(avg(confidence), 4) AS avg_confidence FROM scores GROUP BY 1, 2",
        "SELECT date_trunc('hour', scored_at) AS hour, label, count(*) AS n, round(avg(confidence), 4) AS avg_confidence FROM scores GROUP BY 1, 2",
    ),
    "metadata_json_extract": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.missing') AS missing, array_contains(json_object_keys(props), 'k') AS has_k FROM events WHERE get_json_object(props, '$.k') <> '5'",
        "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing, list_contains(json_keys(props), 'k') AS has_k FROM events WHERE props->>'$.k' <> '5'",
    ),
    "metadata_json_group": (
        "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1",
        "SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1",
    ),
    "metadata_json_merge": (
        "SELECT event_id, to_json(map_from_entries(array_sort(map_entries(map_concat(map_filter(from_json(props, 'map<string,string>'), (k, v) -> k NOT IN ('seen', 'type')), map('seen', 'yes', 'type', event_type)))))) AS merged FROM events",
        "SELECT event_id, '{\"k\":\"' || (props->>'$.k') || '\",\"seen\":\"yes\",\"type\":\"' || event_type || '\"}' AS merged FROM events",
    ),
    "seeded_sample": (
        "SELECT doc_id, left(text, 40) AS preview FROM raw_texts ORDER BY md5(concat(CAST(doc_id AS STRING), '42')), doc_id LIMIT 25",
        "SELECT doc_id, left(text, 40) AS preview FROM raw_texts ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id LIMIT 25",
    ),
    "stratified_sample": (
        "SELECT label, event_id, CAST(rn AS BIGINT) AS rn FROM (SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(event_id AS STRING), '42')), event_id) AS rn FROM scores) x WHERE rn <= 20",
        "SELECT label, event_id, CAST(rn AS BIGINT) AS rn FROM (SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id) AS rn FROM scores) x WHERE rn <= 20",
    ),
    "tumbling_counts": (
        "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY window(ts, '1 hour'), event_type",
        "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    ),
    "sliding_counts": (
        "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, count(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')",
        "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(h) AS start FROM events, (VALUES (0), (1)) AS v(h)) x GROUP BY start",
    ),
    "session_activity": (
        "SELECT user_id, CAST(session_window.start AS TIMESTAMP_NTZ) AS start, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')",
        "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events) x) y GROUP BY user_id, s",
    ),
    "time_functions": (
        "SELECT o_orderkey, trunc(o_orderdate, 'MM') AS month, add_months(CAST(o_orderdate AS DATE), 3) AS later, date_format(o_orderdate, 'yyyy_MM') AS part, unix_timestamp(o_orderdate) - unix_timestamp(date_trunc('day', o_orderdate)) AS seconds FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS later, strftime(o_orderdate, '%Y_%m') AS part, CAST(epoch(o_orderdate) - epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS seconds FROM orders",
    ),
    "string_functions": (
        "SELECT c_custkey, split_part(c_name, '#', 2) AS number, ltrim('0', split_part(c_name, '#', 2)) AS bare, translate(c_mktsegment, 'AEIOU', 'aeiou') AS vowels, regexp_replace(lower(c_name), '[^a-z0-9]+', '_') AS slug, left(sha2(c_name, 256), 32) AS id, concat_ws('|', c_name, c_mktsegment) AS both FROM customer",
        "SELECT c_custkey, split_part(c_name, '#', 2) AS number, ltrim(split_part(c_name, '#', 2), '0') AS bare, translate(c_mktsegment, 'AEIOU', 'aeiou') AS vowels, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') AS slug, left(sha256(c_name), 32) AS id, concat_ws('|', c_name, c_mktsegment) AS both FROM customer",
    ),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: standins.sql(spark, sf_dir, text)


QUERIES = {name: _query(text) for name, text in SHARED.items()} | {name: _query(a) for name, (a, _) in PAIRS.items()}
ORACLES = {name: f"{standins.DUCK}\n{text}" for name, text in SHARED.items()} | {name: f"{standins.DUCK}\n{b}" for name, (_, b) in PAIRS.items()}
