"""Ranking, recall, KPI, statistics, evaluation, vector and clustering queries."""

from __future__ import annotations

from memloom.operators import cluster, dedup, rank, vectors
from memloom.functions import text as t
from memloom.functions.dialect import SPARK
from memloom.plans.base import Registry, table
from memloom.plans.relational import NODES, PAIRS, USES
from pyspark.sql import functions as F

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
q = R.sql

#: Recall candidates: an event is a candidate of its user's query; value / 200 is its score.
CAND = "cand AS (SELECT user_id AS query, event_id AS id, event_type AS source, least(CAST(1 AS DOUBLE), value / CAST(200 AS DOUBLE)) AS score, ts FROM {events})"
NOW = "(SELECT max(ts) FROM {events})"


def days(d, a, b):
    return f"(({d.epoch(a)} - {d.epoch(b)}) / 86400)"


# --- ranking
q("rnk01_filter_by_score", lambda d: f"WITH {CAND}, f AS (SELECT query, id, score, score * (0.5 + 0.5 * exp(-greatest({days(d, NOW, 'ts')}, 0) / 30)) AS fused FROM cand WHERE score >= 0.2) SELECT query, id, round(score, 6) AS base_score, round(fused, 6) AS final_score, CAST(row_number() OVER (PARTITION BY query ORDER BY fused DESC, id) AS BIGINT) AS rank FROM f".replace("row_number()", "row_number()"))
q("rnk03_time_score", lambda d: f"SELECT event_id, round(CASE WHEN event_type = 'error' THEN 0.5 ELSE exp(-greatest({days(d, NOW, 'ts')}, 0) / 30) END, 6) AS time_score FROM {{events}}")
q("rnk04_score_span", lambda d: f"WITH {CAND}, r AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY query) AS n, count(CASE WHEN score > 0 THEN 1 END) OVER (PARTITION BY query) AS pos, max(score) OVER (PARTITION BY query) - min(CASE WHEN score > 0 THEN score END) OVER (PARTITION BY query) AS span FROM cand) SELECT query, id, round(span, 6) AS span FROM r WHERE rn <= CASE WHEN n <= 3 OR pos < 2 THEN n WHEN span > 0.9 THEN 3 WHEN span > 0.7 THEN greatest(3, least(5, n)) ELSE n END")
q("rnk05_rerank_scores", lambda d: f"SELECT session, node, pos, round(1.0 / pos, 6) AS score FROM (SELECT session, node, CAST(row_number() OVER (PARTITION BY log_id ORDER BY node) AS BIGINT) AS pos FROM (SELECT DISTINCT session, log_id, node FROM (SELECT o_custkey AS session, l_partkey AS node, l_orderkey AS log_id FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey) u) v) x".replace("1.0 / pos", "CAST(1 AS DOUBLE) / pos"))
q("rnk06_raw_scores", lambda d: f"WITH {CAND} SELECT query, id, round(score, 6) AS score FROM cand WHERE score >= 0.5")
q("rnk07_best_known_score", lambda d: "SELECT event_id, round(coalesce(CASE WHEN event_id % 4 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value / 2 END, CASE WHEN event_id % 2 = 0 THEN value / 4 END, 0), 6) AS score FROM {events}")
q("rnk08_hit_boost", lambda d: f"WITH {CAND}, h AS (SELECT query, id, score, row_number() OVER (PARTITION BY query, source ORDER BY ts, id) AS hits FROM cand) SELECT query, id, round(least(2, score * least(1 + 0.1 * (hits - 1), 2)), 6) AS score FROM h")
q("rnk09_access_weight", lambda d: f"SELECT event_id, round(CASE WHEN last IS NULL THEN 1 ELSE power(0.9, {days(d, 'ts', 'last')}) END, 6) AS weight FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM {{events}}) x")
q("rnk10_decay", lambda d: f"SELECT event_id, round(score * w, 6) AS score, score * w < 0.2 AS low_priority FROM (SELECT event_id, least(CAST(1 AS DOUBLE), value / CAST(200 AS DOUBLE)) AS score, power(0.9, {days(d, NOW, 'ts')}) AS w FROM {{events}}) x")
q("rnk11_tree_score", lambda d: "SELECT event_id, round(CASE WHEN event_type = 'error' THEN 0.45 ELSE 0.5 + 0.4 * least(greatest(value / 100, 0), 1) END, 4) AS score, CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'tree_score' END AS how FROM {events}")
q("rnk12_turn_dedup", lambda d: f"WITH {CAND}, s AS (SELECT query, id, score, row_number() OVER (PARTITION BY query, source, CAST(ts AS DATE) ORDER BY ts, id) AS seen FROM cand) SELECT query, id, round(CASE WHEN seen > 1 THEN score * 0.1 ELSE score END, 6) AS score FROM s")
q("rnk13_recall_pipeline", lambda d: f"WITH {CAND}, kept AS (SELECT * FROM cand WHERE source <> 'error'), boosted AS (SELECT query, id, source, ts, least(2, score * least(1 + 0.1 * (row_number() OVER (PARTITION BY query, source ORDER BY ts, id) - 1), 2)) AS score FROM kept), fused AS (SELECT query, id, source, score * (0.5 + 0.5 * exp(-greatest({days(d, NOW, 'ts')}, 0) / 30)) AS score FROM boosted WHERE score >= 0.1), one AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, id) AS own FROM fused), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS BIGINT) AS rn FROM one WHERE own <= 2) SELECT query, id, source, round(score, 4) AS score, rn FROM top WHERE rn <= 5")
q("rnk14_eval_match", lambda d: f"WITH u AS (SELECT doc_id, {d.distinct(d.words('lower(text)'))} AS w FROM {{documents}} WHERE text IS NOT NULL), b AS (SELECT item_id, {d.distinct(d.words('lower(text)'))} AS w FROM {{benchmark}}), uw AS (SELECT doc_id, {d.explode('w')} AS x FROM u), bw AS (SELECT item_id, {d.explode('w')} AS x FROM b), o AS (SELECT doc_id, item_id, count(*) AS n FROM uw JOIN bw USING (x) GROUP BY 1, 2), s AS (SELECT o.doc_id, o.item_id, n / CAST({d.size('b.w')} AS DOUBLE) AS share FROM o JOIN b ON b.item_id = o.item_id), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, item_id) AS rn FROM s) SELECT doc_id, item_id, round(share, 6) AS share FROM r WHERE rn = 1 AND share >= 0.3")
q("rnk15_keyword_prescreen", lambda d: f"WITH s AS (SELECT p_partkey AS id, {d.distinct(d.words('lower(p_name)'))} AS n, {d.distinct(d.words('lower(p_type)'))} AS c, lower(p_brand) AS b FROM {{part}}), qs AS (SELECT n_nationkey AS qid, {d.distinct(d.words("lower(concat('part ', n_name, ' economy 7 12'))"))} AS w FROM {{nation}}), x AS (SELECT qid, id, 5 * {d.size(d.inter('w', 'n'))} + 3 * {d.size(d.inter('w', 'c'))} AS score FROM qs CROSS JOIN s), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM x WHERE score > 0) SELECT qid, id, score FROM r WHERE rn <= 10")
q("rnk16_synonyms", lambda d: f"WITH g AS (SELECT p_partkey % 50 AS grp, p_brand AS w FROM {{part}}), k AS (SELECT DISTINCT p_partkey AS id, p_brand AS w FROM {{part}} WHERE p_partkey % 50 = 0) SELECT DISTINCT id, b.w AS word FROM k JOIN g a ON a.w = k.w JOIN g b ON b.grp = a.grp")
q("rnk18_sort_key", lambda d: "SELECT event_id, round(greatest(0.01 * event_id % 7, 0.2 * value / 100), 6) AS k FROM {events}".replace("0.01 * event_id % 7", "0.01 * (event_id % 7)"))
q("rnk19_rank_skills", lambda d: "WITH s AS (SELECT s_suppkey AS id, count(l_orderkey) AS activity, avg(l_discount) AS neg FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY s_suppkey), r AS (SELECT id, round(3 * coalesce(neg, 0) + 0.5 * ln(1 + activity), 6) AS score FROM s WHERE activity > 0) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank FROM r")
q("rnk20_negative_decay", lambda d: f"WITH o AS (SELECT user_id AS k, count(*) AS ema FROM {{events}} WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id AS k, count(*) AS fresh FROM {{events}} WHERE event_type = 'error' AND event_id % 2 = 1 GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, round(coalesce(ema, 0) * power(0.5, 7 / CAST(14 AS DOUBLE)) + coalesce(fresh, 0), 6) AS ema FROM o FULL OUTER JOIN n ON o.k = n.k WHERE coalesce(ema, 0) * power(0.5, 7 / CAST(14 AS DOUBLE)) + coalesce(fresh, 0) >= 0.5")
q("rnk21_session_gate", lambda d: f"WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM {{events}} GROUP BY 1, 2), l AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM d) SELECT user_id, {d.varchar('day')} AS day, CASE WHEN prev IS NULL OR ({d.epoch('day') if d.name == 'duckdb' else 'unix_date(day) * 86400'} - {d.epoch('prev') if d.name == 'duckdb' else 'unix_date(prev) * 86400'}) / 86400 <= 2 THEN 'open' ELSE 'cooldown' END AS gate FROM l")
q("rnk22_variants", lambda d: f"SELECT p_type AS path, {d.best('p_name', '-length(p_name)', '-p_partkey')} AS representative, max(p_size) AS usage FROM {{part}} GROUP BY p_type")
q("rnk23_subject_scores", lambda d: "SELECT p_brand AS subject, round(1 * count(*) + 0.5 * avg(p_size) + 0.1 * max(p_size) + 0.3 * min(p_size), 4) AS score FROM {part} GROUP BY p_brand")
q("rnk24_temporal_filter", lambda d: "WITH v AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS score, o_orderdate AS vf, o_orderdate + INTERVAL '365' DAY AS vu FROM {orders}), n AS (SELECT max(o_orderdate) - INTERVAL '500' DAY AS t FROM {orders}) SELECT id, round(score * CASE WHEN vf > t THEN 0.5 ELSE 1 END * CASE WHEN vu < t THEN 0.5 ELSE 1 END, 4) AS score, vf > t OR vu < t AS demoted FROM v CROSS JOIN n")
q("rnk25_date_compare", lambda d: f"SELECT event_id, CASE WHEN substring({d.varchar('ts')}, 1, 7) < '2024-01' THEN -1 WHEN substring({d.varchar('ts')}, 1, 7) > '2024-01' THEN 1 ELSE 0 END AS by_month, CASE WHEN substring({d.varchar('ts')}, 1, 10) < '2024-01-15' THEN -1 WHEN substring({d.varchar('ts')}, 1, 10) > '2024-01-15' THEN 1 ELSE 0 END AS by_day FROM {{events}}")
q("rnk26_rollout_sets", lambda d: "SELECT user_id, max(value) AS best, min(value) AS worst, round(max(value) - min(value), 6) AS spread, round(avg(CASE WHEN value >= 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pass_rate FROM {events} GROUP BY user_id")
q("rnk27_reward", lambda d: "SELECT user_id, round(0.6 * avg(CASE WHEN event_type <> 'error' THEN CAST(1 AS DOUBLE) ELSE 0 END) - 0.2 * avg(value) / 1000 - 0.2 * count(*) / 1000, 6) AS reward FROM {events} GROUP BY user_id")
q("rnk28_by_quality", lambda d: "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM {part}) x WHERE rn <= 5 AND p_partkey % 7 <> 0")
q("rnk29_by_coverage", lambda d: "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM {part}) x WHERE rn = 1")
q("rnk31_round_cap", lambda d: "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 20 THEN 1 ELSE 5 END AS max_results FROM {events}")

# --- KPIs and statistics
q("agg01_text_kpis", lambda d: f"SELECT count(*) AS n, round(avg(CASE WHEN length(text) > 1500 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS long_share, round({d.pct('length(text)', 0.5)}, 4) AS median_length, CAST(max(length(text)) AS BIGINT) AS max_length, {d.best('doc_id', 'length(text)', '-doc_id')} AS longest FROM {{documents}} WHERE text IS NOT NULL")
q("agg02_tree_kpis", lambda d: f"WITH {NODES}, c AS (SELECT p.id, count(k.id) AS n FROM nodes p JOIN nodes k ON k.parent = p.id WHERE p.kind = 'subject' GROUP BY p.id) SELECT count(*) AS subjects, count(CASE WHEN n < 50 THEN 1 END) AS fragments, max(n) AS largest, round(avg(n), 4) AS mean FROM c")
q("agg03_router", lambda d: f"SELECT event_type, count(*) AS n, round({d.pct('value', 0.5)}, 4) AS p50, round({d.pct('value', 0.95)}, 4) AS p95, round({d.pct('value', 0.99)}, 4) AS p99, round(100 * avg(CASE WHEN value = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS empty_pct FROM {{events}} GROUP BY event_type")
q("agg04_percentile", lambda d: f"SELECT user_id, round({d.pct('value', 0.9)}, 6) AS p90 FROM {{events}} GROUP BY user_id")
q("agg05_contribution", lambda d: "SELECT event_type, round(avg(value), 4) AS mean, max(value) AS most, round(sum(value), 2) AS total, count(CASE WHEN value > 0 THEN 1 END) AS non_zero FROM {events} GROUP BY event_type")
q("agg06_token_usage", lambda d: f"SELECT source, round(avg(length(text) / CAST(4 AS DOUBLE)), 4) AS mean, CAST(max(length(text)) AS BIGINT) AS most, round({d.pct('length(text)', 0.9)}, 4) AS p90, round(sum(length(text)) / CAST(sum(sum(length(text))) OVER () AS DOUBLE), 6) AS share FROM {{documents}} WHERE text IS NOT NULL GROUP BY source")
q("agg07_error_modules", lambda d: "SELECT user_id AS module, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, user_id) AS BIGINT) AS rnk FROM {events} WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
q("agg08_usage", lambda d: "SELECT count(CASE WHEN n >= 20 THEN 1 END) AS active, count(CASE WHEN n < 20 THEN 1 END) AS stale, max(n) AS most FROM (SELECT s_suppkey, count(l_orderkey) AS n FROM {supplier} LEFT JOIN {lineitem} ON l_suppkey = s_suppkey GROUP BY 1) x")
q("agg09_duration_outliers", lambda d: f"SELECT user_id, round(latest, 4) AS latest, abs(latest - mean) > 2 * sd AND abs(latest - mean) > 0.5 * mean AS outlier FROM (SELECT user_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, {d.best('value', 'ts', 'event_id')} AS latest FROM {{events}} GROUP BY user_id) x WHERE n >= 3")
q("agg10_dimensions", lambda d: f"SELECT lang, round(avg(length(text)), 4) AS mean_length, round(avg(CASE WHEN l.doc_id IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS unknown_share FROM {{documents}} t LEFT JOIN {{labels}} l ON l.doc_id = t.doc_id GROUP BY lang")
q("agg11_latest_report", lambda d: f"SELECT user_id, {d.best('event_type', 'ts', 'event_id')} AS action, count(*) AS n FROM {{events}} GROUP BY user_id")
q("agg12_acceptance", lambda d: "SELECT lang, round(avg(CASE WHEN quality = 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accept_rate, count(*) AS n FROM {labels} l JOIN {documents} t ON t.doc_id = l.doc_id GROUP BY lang")
q("agg13_rolling_judge", lambda d: "SELECT event_type, CASE WHEN count(*) >= 5 THEN round(avg(CASE WHEN value >= 50 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) END AS relevant_rate, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL '7' DAY) x WHERE rn <= 200 GROUP BY event_type")
q("agg14_judge_estimate", lambda d: "SELECT event_type, round(0.40 + (least(greatest(m, 0.40), 0.65) - 0.40) / 0.25 * 0.35, 4) AS est_avg, round(greatest(0.1, least(0.95, (0.40 + (least(greatest(m, 0.40), 0.65) - 0.40) / 0.25 * 0.35) * (0.85 + 0.3 * r))), 4) AS est_rate FROM (SELECT event_type, avg(value) / 100 AS m, avg(CASE WHEN value > 10 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS r FROM {events} GROUP BY event_type) x")
q("agg15_baseline", lambda d: "SELECT coalesce(CASE WHEN user_id % 3 = 0 THEN event_type END, CASE WHEN user_id % 3 = 1 THEN 'candidate' END, 'free') AS k, count(*) AS n, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS half_width FROM {events} GROUP BY 1")
q("agg16_two_levels", lambda d: "SELECT event_type, count(*) AS users, round(avg(m), 6) AS mean_of_means FROM (SELECT event_type, user_id, avg(value) AS m FROM {events} GROUP BY 1, 2) x GROUP BY event_type")
q("agg18_welch", lambda d: "SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM (SELECT avg(CASE WHEN event_type = 'view' THEN value END) AS m1, var_samp(CASE WHEN event_type = 'view' THEN value END) AS v1, count(CASE WHEN event_type = 'view' THEN 1 END) AS n1, avg(CASE WHEN event_type = 'click' THEN value END) AS m2, var_samp(CASE WHEN event_type = 'click' THEN value END) AS v2, count(CASE WHEN event_type = 'click' THEN 1 END) AS n2 FROM {events}) x")
q("agg19_regressions", lambda d: "WITH d AS (SELECT user_id, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'prev' ELSE 'cur' END AS period, count(*) AS n, avg(value) AS score, max(value) AS latency FROM {events} GROUP BY 1, 2) SELECT c.user_id, c.score < 0.9 * p.score AS score_drop, c.latency > 1.5 * p.latency AS slower FROM d c JOIN d p ON p.user_id = c.user_id AND p.period = 'prev' AND c.period = 'cur' WHERE c.n >= 4 AND p.n >= 4")
q("agg20_precision_recall", lambda d: f"WITH {USES}, g AS (SELECT session, {d.collect('node')} AS got FROM (SELECT DISTINCT session, node FROM uses WHERE node % 2 = 0) x GROUP BY session), e AS (SELECT session, {d.collect('node')} AS want FROM (SELECT DISTINCT session, node FROM uses WHERE node % 3 = 0) x GROUP BY session) SELECT e.session, round({d.size(d.inter('got', 'want'))} / CAST({d.size('got')} AS DOUBLE), 6) AS p, round({d.size(d.inter('got', 'want'))} / CAST({d.size('want')} AS DOUBLE), 6) AS r FROM e JOIN g ON g.session = e.session")
q("agg21_eval_run", lambda d: f"SELECT round(avg(value), 6) AS mean, round({d.pct('value', 0.5)}, 6) AS median, round(avg(CASE WHEN value <= 100 THEN value END), 6) AS clean_mean, count(CASE WHEN value > 100 THEN 1 END) AS outliers FROM {{events}}")
q("agg22_report", lambda d: "SELECT coalesce(event_type, 'all') AS category, round(0.4 * avg(value) + 0.3 * min(value) + 0.3 * max(value), 6) AS overall, count(*) AS n FROM {events} GROUP BY ROLLUP (event_type)")
q("agg23_score_stats", lambda d: "SELECT user_id, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM {events} GROUP BY user_id")
q("agg24_recall_summary", lambda d: f"WITH {CAND}, r AS (SELECT query, source, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM cand) SELECT query, count(*) AS n, count(CASE WHEN source = 'view' THEN 1 END) AS views, {d.join(d.map(d.collect('CASE WHEN rn <= 8 THEN id END') if d.name == 'spark' else 'list_sort(list(id) FILTER (rn <= 8))', 'i', d.varchar('i')), ',')} AS top FROM r GROUP BY query")
q("agg25_recent_trend", lambda d: "SELECT user_id, count(*) AS n, count(CASE WHEN value > 100 THEN 1 END) AS high, round(count(CASE WHEN value > 100 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x WHERE rn <= 10 GROUP BY user_id")
q("agg26_hourly", lambda d: "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(CASE WHEN event_type = 'view' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS hit_rate FROM {events} GROUP BY 1")
q("agg27_histogram", lambda d: "SELECT CASE WHEN value < 20 THEN '0-20' WHEN value < 40 THEN '20-40' WHEN value < 60 THEN '40-60' WHEN value < 80 THEN '60-80' ELSE '80+' END AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY 1")
q("agg28_replay_scores", lambda d: "SELECT round(avg(quality), 6) AS hard, count(*) AS n FROM {labels} WHERE toxic = 0")
q("agg29_replay_cost", lambda d: "SELECT round(avg(length(text)), 6) AS tokens, round(avg(turn), 6) AS latency FROM {conversations} WHERE text IS NOT NULL")
q("agg30_votes", lambda d: "WITH v AS (SELECT user_id AS id, event_type AS round, count(*) AS n FROM {events} GROUP BY 1, 2), r AS (SELECT count(DISTINCT round) AS rounds FROM v) SELECT id, CASE WHEN count(DISTINCT round) = max(rounds) THEN 'all' ELSE 'some' END AS vote FROM v CROSS JOIN r GROUP BY id")
q("agg31_capacity", lambda d: "SELECT source, round(sum(length(text)) / CAST(1000000 AS DOUBLE), 6) AS ratio FROM {documents} GROUP BY source")
q("agg32_last_days", lambda d: f"SELECT {d.varchar('day')} AS day, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {{events}} GROUP BY 1 ORDER BY 1 DESC LIMIT 7) x")
q("agg33_credibility", lambda d: f"SELECT user_id, {d.join(d.keep(d.array(['CASE WHEN n < 60 THEN ' + d.lit('small_sample') + ' ELSE ' + d.lit('') + ' END', 'CASE WHEN e > 12 THEN ' + d.lit('errors') + ' ELSE ' + d.lit('') + ' END']), 'w', 'w <> ' + d.lit('')), ',')} AS warnings FROM (SELECT user_id, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS e FROM {{events}} GROUP BY user_id) x")
q("agg34_confidence_step", lambda d: "SELECT event_id, round(CASE event_type WHEN 'click' THEN least(1.0, 0.5 + 0.05) WHEN 'view' THEN 0.5 * power(0.99, value / 10) WHEN 'error' THEN 0.5 * 0.5 ELSE 0.5 * power(0.997, value / 10) END, 6) AS confidence FROM {events}")
q("agg36_timeouts", lambda d: "SELECT o_orderkey, CASE WHEN o_orderdate < (SELECT max(o_orderdate) FROM {orders}) - INTERVAL '30' DAY THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'approve' ELSE 'reject' END ELSE 'pending' END AS action FROM {orders} WHERE o_orderstatus = 'O'")
q("agg37_weights", lambda d: "SELECT round(avg(w), 6) AS mean, round(min(w), 6) AS low, round(max(w), 6) AS high, round(avg(CASE WHEN w < 0.2 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS low_share FROM (SELECT value / 200 AS w FROM {events}) x")

# --- scalar rules on rows
q("fn08_parse_datetime", lambda d: f"SELECT event_id, {d.one('s', '([0-9]+-[0-9]+-[0-9]+ [0-9:]+)', 1)} AS stamp, {d.one('s', '([0-9]+/[0-9]+/[0-9]+)', 1)} AS slashed FROM (SELECT event_id, concat('at ', {d.varchar('ts')}, ' or ', replace(substring({d.varchar('ts')}, 1, 10), '-', '/')) AS s FROM {{events}}) x")
q("fn09_last_access", lambda d: f"SELECT event_id, round({d.epoch('ts')} + ({d.epoch(NOW)} - {d.epoch('ts')}) * CASE WHEN event_type = 'view' THEN 0.3 ELSE 0.2 END, 3) AS last_access FROM {{events}}")
q("fn10_access_count", lambda d: f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN doc_id % 10 WHEN hits > 0 THEN least(15, 5 + 2 * hits) ELSE 3 END AS accesses FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), ' la ') THEN 1 ELSE 0 END AS hits FROM {{documents}} WHERE text IS NOT NULL) x")
q("fn26_sibling_conflicts", lambda d: f"SELECT a.vec_id AS a, b.vec_id AS b FROM {{embeddings}} a JOIN {{embeddings}} b ON a.label = b.label AND a.vec_id < b.vec_id AND (a.vec_id % 2) <> (b.vec_id % 2) WHERE {d.dot('a.embedding', 'b.embedding')} / sqrt({d.dot('a.embedding', 'a.embedding')} * {d.dot('b.embedding', 'b.embedding')}) > 0.3")
q("fn44_mine_tasks", lambda d: f"WITH u AS (SELECT conv_id, {d.best('text', '-turn')} AS intent, count(*) AS n, max(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS good FROM {{conversations}} WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id) SELECT conv_id, substring(intent, 1, 80) AS intent, CASE WHEN good = 1 AND n < 3 THEN 'success' WHEN n >= 3 THEN 'mixed' ELSE 'unknown' END AS outcome FROM u WHERE length(intent) >= 8")
q("fn45_splits", lambda d: f"SELECT doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, ({' + '.join(f'(instr({d.lit("0123456789abcdef")}, substring(h, {i}, 1)) - 1) * {pow(16, 64 - i, 100)}' for i in range(1, 65))}) % 100 AS b FROM (SELECT doc_id, {'sha2' if d.name == 'spark' else 'sha256'}(concat('42', {d.varchar('doc_id')}){', 256' if d.name == 'spark' else ''}) AS h FROM {{documents}}) x) y")
q("fn46_apportion", lambda d: "WITH g AS (SELECT lang, count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE) AS want FROM {documents} GROUP BY lang), f AS (SELECT lang, floor(want) AS base, row_number() OVER (ORDER BY want - floor(want) DESC, lang) AS rn, 100 - sum(floor(want)) OVER () AS left_over FROM g) SELECT lang, CAST(base + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f")
q("fn47_gate", lambda d: "SELECT event_id, CASE WHEN value > 50 AND value > 90 THEN 'accept_new_best' WHEN value > 50 THEN 'accept' ELSE 'reject' END AS verdict FROM {events}")
q("fn48_gate_score", lambda d: "SELECT event_id, round((1 - 0.25) * value + 0.25 * value / 2, 6) AS mixed FROM {events}")
q("fn49_direction", lambda d: "SELECT user_id, CASE WHEN late > 1.1 * early THEN 'up' WHEN late < 0.9 * early THEN 'down' ELSE 'hold' END AS direction FROM (SELECT user_id, avg(CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN value END) AS early, avg(CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-15' THEN value END) AS late FROM {events} GROUP BY user_id) x")
q("fn50_improved", lambda d: "SELECT event_id, CASE event_id % 3 WHEN 0 THEN value >= prev WHEN 1 THEN value <= prev ELSE prev <= 0 OR abs(value - prev) / prev < 0.1 END AS improved FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) x WHERE prev IS NOT NULL")
q("fn51_valid_step", lambda d: "SELECT event_id, CASE WHEN value = 0 THEN true WHEN event_id % 2 = 0 THEN abs(prev - value) <= 5 + 0.000000001 ELSE abs((prev - value) / value) * 100 <= 20 + 0.000000001 END AS ok FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) x WHERE prev IS NOT NULL")
q("fn52_guards", lambda d: "WITH rules AS (SELECT 'view' AS metric, 'ge' AS op, 60.0 AS bound UNION ALL SELECT 'error', 'le', 40.0), m AS (SELECT event_type AS metric, avg(value) AS v FROM {events} GROUP BY 1) SELECT m.metric, CASE WHEN op = 'ge' THEN v >= bound ELSE v <= bound END AS ok FROM m JOIN rules ON rules.metric = m.metric")
q("fn57_anchors", lambda d: f"SELECT doc_id, (length(text) - length(replace(text, 'the ', ''))) / 4 = 1 AS unique_anchor FROM {{documents}} WHERE text IS NOT NULL")
q("fn60_context_xml", lambda d: f"SELECT source, concat('<source name=\"', source, '\">', {d.join(d.collect('concat(' + d.lit('<item>') + ', replace(replace(substring(text, 1, 40), ' + d.lit('&') + ', ' + d.lit('&amp;') + '), ' + d.lit('<') + ', ' + d.lit('&lt;') + '), ' + d.lit('</item>') + ')'), '')}, '</source>') AS xml FROM {{documents}} WHERE text IS NOT NULL GROUP BY source")
q("fn61_fallback_embedding", lambda d: f"SELECT doc_id, round({d.dot('v', 'v')}, 4) AS sq, round({d.at('v', '1')}, 6) AS first FROM (SELECT doc_id, {d.map(d.steps('1', '16'), 'i', f'((instr({d.lit("0123456789abcdef")}, substring(h, 2 * i - 1, 1)) - 1) * 16 + instr({d.lit("0123456789abcdef")}, substring(h, 2 * i, 1)) - 1) / CAST(255 AS DOUBLE) * 2 - 1')} AS v FROM (SELECT doc_id, md5(text) AS h FROM {{documents}} WHERE text IS NOT NULL) x) y")

# --- clustering and graphs in SQL
q("clu02_parameters", lambda d: "SELECT source, n, CASE WHEN n < 20 THEN 2 WHEN n < 100 THEN 3 WHEN n < 500 THEN 3 WHEN n < 2000 THEN 4 ELSE 8 END AS min_cluster_size, CASE WHEN n < 20 THEN 2 WHEN n < 100 THEN 3 WHEN n < 500 THEN 2 WHEN n < 2000 THEN 3 ELSE 5 END AS min_samples FROM (SELECT source, count(*) AS n FROM {documents} GROUP BY source) x")
q("clu03_clusters", lambda d: "SELECT label, count(*) AS n, min(vec_id) AS representative FROM {embeddings} WHERE label >= 0 GROUP BY label HAVING count(*) <= 60")
q("clu09_report", lambda d: "SELECT count(*) AS clusters, round(avg(n), 6) AS mean_size, round(avg(CASE WHEN n < 50 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS small_share FROM (SELECT label, count(*) AS n FROM {embeddings} GROUP BY label) x")
q("clu13_merge_candidates", lambda d: f"WITH {USES}, s AS (SELECT DISTINCT session, node % 25 AS subject FROM uses), n AS (SELECT subject, count(*) AS points FROM s GROUP BY 1), c AS (SELECT x.subject AS a, y.subject AS b, count(*) AS n FROM s x JOIN s y ON x.session = y.session AND x.subject < y.subject GROUP BY 1, 2), r AS (SELECT a, b, n / CAST(max(n) OVER () AS DOUBLE) AS rate FROM c) SELECT a, b, CASE WHEN p.points + o.points < 20 THEN 'merge' ELSE 'link' END AS action FROM r JOIN n p ON p.subject = a JOIN n o ON o.subject = b WHERE rate > 0.30")
q("clu15_info_density", lambda d: f"WITH w AS (SELECT doc_id, {d.explode(d.words('lower(text)'))} AS w FROM {{documents}} WHERE text IS NOT NULL), f AS (SELECT w, count(*) AS cf FROM w GROUP BY w), n AS (SELECT count(*) AS n FROM {{documents}} WHERE text IS NOT NULL), s AS (SELECT doc_id, avg(ln(n / CAST(1 + cf AS DOUBLE))) AS density FROM w JOIN f USING (w) CROSS JOIN n GROUP BY doc_id) SELECT doc_id, round(CASE WHEN max(density) OVER () = min(density) OVER () THEN 0 ELSE (density - min(density) OVER ()) / (max(density) OVER () - min(density) OVER ()) END, 4) AS density FROM s")
q("clu19_failure_patterns", lambda d: f"SELECT event_type, user_id % 10 AS op, count(*) AS n, {d.join(d.map(d.first(d.collect('event_id'), 3), 'i', d.varchar('i')), ',')} AS reasons FROM {{events}} GROUP BY 1, 2")
q("clu20_placement", lambda d: f"WITH {NODES}, c AS (SELECT parent, count(*) AS n FROM nodes WHERE kind = 'subject' GROUP BY parent) SELECT k.id, CASE WHEN c.n < 3 THEN concat('root/', {d.varchar('s.parent')}) ELSE {d.varchar('s.id')} END AS place FROM nodes k JOIN nodes s ON s.id = k.parent JOIN c ON c.parent = s.parent WHERE k.kind = 'knowledge_point'")
q("clu18_lineage", lambda d: f"SELECT o_custkey AS node, CAST(max(v) AS BIGINT) AS version, {d.best('o_orderkey', 'v')} AS record FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM {{orders}}) x GROUP BY o_custkey")
q("ded03_exact_dedup", lambda d: "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {documents} WHERE text IS NOT NULL GROUP BY text")
q("ded09_winner", lambda d: f"SELECT source, {d.best('doc_id', 'length(text)', 'doc_id')} AS winner FROM {{documents}} WHERE text IS NOT NULL GROUP BY source")
q("ded23_first_digest", lambda d: "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {conversations}) x WHERE rn = 1")
q("ded24_task_merge", lambda d: f"SELECT user_id, {d.join(d.collect('DISTINCT event_type') if d.name == 'spark' else 'list_sort(list(DISTINCT event_type))', ',')} AS sources, max(CASE event_type WHEN 'view' THEN 3 WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS outcome FROM {{events}} GROUP BY user_id")
q("ded27_repeated_lines", lambda d: (f"SELECT doc_id, count(*) AS repeats FROM (SELECT doc_id, {d.strip('line')} AS s, row_number() OVER (PARTITION BY doc_id, {d.strip('line')} ORDER BY pos) AS rn FROM " + ("(SELECT doc_id, p AS pos, line FROM {documents} LATERAL VIEW posexplode(split(text, chr(10))) v AS p, line) a" if d.name == "spark" else "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {documents}) a") + f" WHERE length({d.strip('line')}) >= 10) x WHERE rn > 1 GROUP BY doc_id"))

COS = "WITH v AS (SELECT vec_id, label, embedding, {n} AS n FROM {{embeddings}})"


def cos(d, a, b):
    return f"{d.dot(f'{a}.embedding', f'{b}.embedding')} / ({a}.n * {b}.n)"


def vecs(d):
    return COS.format(n=f"sqrt({d.dot('embedding', 'embedding')})").replace("{{", "{").replace("}}", "}")


def cents(d):
    """Centroids by label: posexploded means, collected again."""
    if d.name == "spark":
        return "c AS (SELECT label, transform(array_sort(collect_list(struct(p, m))), s -> s.m) AS embedding FROM (SELECT label, p, avg(CAST(x AS DOUBLE)) AS m FROM v LATERAL VIEW posexplode(embedding) e AS p, x GROUP BY label, p) g GROUP BY label), cn AS (SELECT label, embedding, sqrt(" + d.dot("embedding", "embedding") + ") AS n FROM c)"
    return "c AS (SELECT label, list(m ORDER BY p) AS embedding FROM (SELECT label, p, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM v) u GROUP BY label, p) g GROUP BY label), cn AS (SELECT label, embedding, sqrt(" + d.dot("embedding", "embedding") + ") AS n FROM c)"


q("vec01_cosine", lambda d: f"{vecs(d)} SELECT a.vec_id AS a, b.vec_id AS b, round({cos(d, 'a', 'b')}, 6) + CAST(0 AS DOUBLE) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id")
q("vec05_centroids", lambda d: f"{vecs(d)}, {cents(d)} SELECT label, round(n, 6) AS norm, round({d.at('embedding', '1')}, 6) AS first FROM cn")
q("vec06_best_domain", lambda d: f"{vecs(d)}, {cents(d)}, s AS (SELECT v.vec_id, cn.label, {cos(d, 'v', 'cn')} AS sim FROM v CROSS JOIN cn), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s) SELECT vec_id, CASE WHEN sim > 0.25 THEN label END AS domain, round(sim, 4) AS sim FROM r WHERE rn = 1")
q("vec09_subject_offset", lambda d: f"{vecs(d)}, {cents(d)} SELECT a.label, round({d.at('a.embedding', '1')} - avg({d.at('b.embedding', '1')}), 6) AS offset1 FROM cn a JOIN cn b ON a.label <> b.label GROUP BY a.label, {d.at('a.embedding', '1')}")
q("vec11_centroid_move", lambda d: f"{vecs(d)}, {cents(d)}, k AS (SELECT label, count(*) AS m FROM v GROUP BY label) SELECT v.vec_id, round(({d.at('cn.embedding', '1')} * m - {d.at('v.embedding', '1')}) / (m - 1), 6) AS left1 FROM v JOIN cn ON cn.label = v.label JOIN k ON k.label = v.label")
q("clu05_match_entities", lambda d: f"{vecs(d)}, {cents(d)}, s AS (SELECT a.label AS fresh, b.label AS known, {cos(d, 'a', 'b')} AS sim FROM cn a JOIN cn b ON a.label >= 5 AND b.label < 5), r AS (SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY sim DESC, known) AS rn FROM s) SELECT fresh, known, round(sim, 4) AS sim FROM r WHERE rn = 1")


# --- Python-backed or iterative operators: rows-only for the driver, brute force in the tests
def _bigrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) >= 1")
    return docs.select(F.col("doc_id").alias("id"), F.expr(t.grams(SPARK, "text")).alias("items"))


@R.add("ded01_greedy_jaccard")
def ded01_greedy_jaccard(spark, sf_dir):
    sets = _bigrams(spark, sf_dir)
    return dedup.survivors(sets.select("id", F.col("id").alias("ord")), dedup.dense_pairs(sets, 0.85)).select("id", "kept")


@R.add("ded02_minhash")
def ded02_minhash(spark, sf_dir):
    sets = _bigrams(spark, sf_dir)
    return dedup.survivors(sets.select("id", F.col("id").alias("ord")), dedup.minhash_pairs(sets, 0.85)).select("id", "kept")


@R.add("ded07_jaccard_pairs", "WITH s AS (SELECT doc_id AS id, CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS x FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda z: z <> '') AS w FROM documents WHERE length(text) >= 1)), e AS (SELECT id, len(x) AS n, unnest(x) AS g FROM s), p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3, 4) SELECT a, b, round(c / CAST(na + nb - c AS DOUBLE), 6) AS sim FROM p WHERE c / CAST(na + nb - c AS DOUBLE) >= 0.8")
def ded07_jaccard_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) >= 1")
    sets = docs.select(F.col("doc_id").alias("id"), F.expr(t.word_shingles(SPARK, "text")).alias("items"))
    return dedup.similar_pairs(sets, 0.8).withColumn("sim", F.round("sim", 6))


@R.add("clu04_components")
def clu04_components(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dedup.components(vectors.spanning_links(e, 0.4))


@R.add("clu01_density_clusters")
def clu01_density_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return cluster.density_clusters(e, "grp", min_cluster_size=3, min_samples=2)


@R.add("rnk02_mmr")
def rnk02_mmr(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rank.mmr(d.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), "text", (F.length("text") / 30000).alias("score")), 5)


@R.add("rnk30_diversity")
def rnk30_diversity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rank.diverse(d.select(F.lit(0).alias("grp"), F.col("doc_id").alias("id"), "source", F.col("lang").alias("kind"), F.length("text").alias("score")))


@R.add("agg17_bootstrap_ci")
def agg17_bootstrap_ci(spark, sf_dir):
    return rank.bootstrap_ci(table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "value"))


@R.add("agg35_confidence_fold")
def agg35_confidence_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rank.confidence_fold(e.select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("tie"), (F.col("event_type") == "view").alias("recalled"), (F.col("event_type") == "click").alias("clicked"), (F.col("event_type") == "error").alias("negated")))


@R.add("vec10_ema")
def vec10_ema(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = vectors.ema_fold(e, "label", "vec_id", "embedding")
    return out.select("label", F.round(F.get("vec", 0), 6).alias("first"), F.size("vec").alias("n"))


@R.add("ded26_sequence_ratio")
def ded26_sequence_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    w = d.select("conv_id", "turn", "text", F.expr("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)").alias("prev")).where("prev IS NOT NULL")
    return w.select("conv_id", "turn", rank.sequence_ratio("text", "prev").alias("ratio"))


@R.add("fn18_chunks")
def fn18_chunks(spark, sf_dir):
    return rank.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 1000)
