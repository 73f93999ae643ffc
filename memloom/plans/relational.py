"""Sources as scans, filters, joins, tree walks and merges, over the relational tables.

Tree: region -> nation -> customer. Edges: parts that share an order. Use log: the parts of each order.
"""

from __future__ import annotations

from memloom.plans.base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
q = R.sql

NODES = """nodes AS (
SELECT CAST(1000000 + r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name, 'domain' AS kind FROM {region}
UNION ALL SELECT 2000000 + n_nationkey, CAST(1000000 + n_regionkey AS BIGINT), n_name, 'subject' FROM {nation}
UNION ALL SELECT c_custkey, CAST(2000000 + c_nationkey AS BIGINT), c_name, 'knowledge_point' FROM {customer})"""
USES = "uses AS (SELECT o_custkey AS session, l_partkey AS node, l_orderkey AS log_id, o_orderdate AS ts FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey)"
PAIRS = "pairs AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"

# --- scans
q("src01_units", lambda d: "SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n FROM {documents} WHERE text IS NOT NULL AND source = 'src0'")
q("src02_unit_entities", lambda d: "SELECT DISTINCT l_orderkey AS unit, l_partkey AS entity FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderpriority = '1-URGENT')")
q("src03_texts_by_id", lambda d: "SELECT l.doc_id, toxic, CAST(length(text) AS BIGINT) AS n FROM {labels} l JOIN {documents} t ON l.doc_id = t.doc_id")
q("src04_entity_units", lambda d: f"SELECT l_partkey AS entity, array_join_(units) AS units, n FROM (SELECT l_partkey, {d.collect('l_orderkey')} AS units, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM {{lineitem}}) x GROUP BY l_partkey) y".replace("array_join_(units)", d.join(d.map("units", "u", d.varchar("u")), ",")))
q("src05_vectors_from_text", lambda d: f"SELECT vec_id, {d.size('v')} AS n, round({d.dot('v', 'v')}, 4) AS sq FROM (SELECT vec_id, {'from_json(s, ' + d.lit('array<float>') + ')' if d.name == 'spark' else 'CAST(s AS FLOAT[])'} AS v FROM (SELECT vec_id, concat('[', {d.join(d.map('embedding', 'x', d.varchar('x')), ',')}, ']') AS s FROM {{embeddings}}) z) y WHERE v IS NOT NULL")
q("src06_new_links", lambda d: f"WITH {PAIRS} SELECT a, b FROM pairs WHERE NOT EXISTS (SELECT 1 FROM {{lineitem}} x WHERE x.l_partkey = pairs.a AND x.l_linenumber = 1)")
q("src07_leaves", lambda d: f"WITH {NODES} SELECT id, name FROM nodes WHERE kind = 'knowledge_point'")
q("src08_recent_uses", lambda d: f"WITH {USES} SELECT log_id, session, min(node) AS first_node, count(*) > 0 AS recalled FROM uses WHERE ts > (SELECT max(ts) FROM uses) - INTERVAL '30' DAY GROUP BY log_id, session")
q("src09_event_streams", lambda d: f"SELECT event_type, {d.varchar('CAST(ts AS DATE)')} AS day, CAST({'get_json_object(props, ' + d.lit('$.k') + ')' if d.name == 'spark' else 'json_extract_string(props, ' + d.lit('$.k') + ')'} AS BIGINT) AS k, count(*) AS n FROM {{events}} WHERE {d.varchar('CAST(ts AS DATE)')} LIKE '2024-01-1%' GROUP BY 1, 2, 3")
q("src10_tolerant_json", lambda d: f"SELECT count(*) AS n_lines, count(k) AS n_good, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CAST({'get_json_object(s, ' + d.lit('$.k') + ')' if d.name == 'spark' else 'CASE WHEN json_valid(s) THEN json_extract_string(s, ' + d.lit('$.k') + ') END'} AS BIGINT) AS k FROM (SELECT CASE WHEN event_id % 10 = 0 THEN '{{oops' ELSE props END AS s FROM {{events}}) x) y".replace("{{", "{").replace("'{oops'", "concat(chr(123), 'oops')"))
q("src12_job_states", lambda d: "SELECT s_suppkey AS job, CASE WHEN s_acctbal >= 0 THEN 'success' ELSE 'fail' END AS status, 'first' AS origin FROM {supplier} WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'success' WHEN s_nationkey % 3 = 1 THEN 'fail' ELSE 'unknown' END, 'second' FROM {supplier} s WHERE NOT EXISTS (SELECT 1 FROM {supplier} f WHERE f.s_suppkey = s.s_suppkey AND f.s_suppkey % 2 = 0)")
q("src13_log_lines", lambda d: f"SELECT day, level, module, count(*) AS n FROM (SELECT {d.one('s', '^([0-9-]+) ([0-9:]+) ([A-Z]+) ([a-z_]+):', 1)} AS day, {d.one('s', '^([0-9-]+) ([0-9:]+) ([A-Z]+) ([a-z_]+):', 3)} AS level, {d.one('s', '^([0-9-]+) ([0-9:]+) ([A-Z]+) ([a-z_]+):', 4)} AS module FROM (SELECT concat(substring({d.varchar('ts')}, 1, 10), ' ', substring({d.varchar('ts')}, 12, 8), ' ', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, ' ', event_type, ': v=', {d.varchar('event_id')}) AS s FROM {{events}}) x) y GROUP BY 1, 2, 3")
q("src14_sessions", lambda d: "SELECT c_custkey AS session, count(o_orderkey) AS messages, coalesce(max(o_orderdate), min(o_orderdate)) AS last_activity FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) >= 5")
q("src15_transcripts", lambda d: f"SELECT conv_id, {d.join('parts', chr(10))} AS transcript, n FROM (SELECT conv_id, {d.map(d.collect(f'concat(lpad({d.varchar('turn')}, 6, {d.lit('0')}), role, {d.lit(': ')}, CASE WHEN role = {d.lit('user')} THEN substring(text, 1, 300) ELSE substring(text, 1, 150) END)'), 'p', 'substring(p, 7)')} AS parts, CAST(sum(length(text)) AS BIGINT) AS n FROM {{conversations}} WHERE text IS NOT NULL GROUP BY conv_id) x WHERE n >= 200")
q("src16_full_text_search", lambda d: f"WITH terms AS (SELECT doc_id, {d.explode(d.distinct(d.words('lower(text)')))} AS w FROM {{documents}} WHERE text IS NOT NULL), qs AS (SELECT item_id, {d.explode(d.distinct(d.words('lower(text)')))} AS w FROM {{benchmark}}), hits AS (SELECT item_id, doc_id, count(*) AS n FROM qs JOIN terms USING (w) GROUP BY item_id, doc_id), sizes AS (SELECT item_id, count(*) AS total FROM qs GROUP BY item_id), ranked AS (SELECT hits.item_id, doc_id, round(n / CAST(total AS DOUBLE), 4) AS confidence, row_number() OVER (PARTITION BY hits.item_id ORDER BY n DESC, doc_id DESC) AS rn FROM hits JOIN sizes USING (item_id)) SELECT item_id, doc_id, confidence FROM ranked WHERE rn <= 3")
q("src20_split_dedup", lambda d: f"SELECT doc_id, pos, line FROM (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, {d.sub('line', '[ \t]+')} ORDER BY pos) AS rn FROM (SELECT doc_id, {d.explode(d.steps('1', d.size('lines')))} AS pos, lines FROM (SELECT doc_id, {'split(text, chr(10))' if d.name == 'spark' else 'string_split(text, chr(10))'} AS lines FROM {{documents}} WHERE text IS NOT NULL) x) y0, LATERAL (SELECT {d.at('lines', 'pos')} AS line) z WHERE {d.strip('line')} <> '') y WHERE rn = 1" if d.name == "duckdb" else f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, {d.sub('line', '[ \t]+')} ORDER BY pos) AS rn FROM (SELECT doc_id, p + 1 AS pos, line FROM {{documents}} LATERAL VIEW posexplode(split(text, chr(10))) v AS p, line WHERE text IS NOT NULL) x WHERE {d.strip('line')} <> '') y WHERE rn = 1")
q("src21_digests", lambda d: "SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) AS user_turns, count(CASE WHEN role = 'assistant' THEN 1 END) AS assistant_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id")

# --- merges (old table and delta -> new table)
q("snk01_upsert", lambda d: "WITH old AS (SELECT o_custkey AS k, max(o_totalprice) AS w FROM {orders} WHERE o_orderkey % 2 = 0 GROUP BY 1), delta AS (SELECT o_custkey AS k, max(o_totalprice) AS w FROM {orders} WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(old.k, delta.k) AS k, greatest(coalesce(old.w, 0), coalesce(delta.w, 0)) AS w, CASE WHEN old.k IS NULL THEN 'inserted' WHEN delta.k IS NULL THEN 'kept' ELSE 'updated' END AS how FROM old FULL OUTER JOIN delta ON old.k = delta.k")
q("snk02_edge_upsert", lambda d: f"WITH {PAIRS} SELECT a, b, CAST(sum(n) AS BIGINT) AS cooccurrence FROM (SELECT a, b, n FROM pairs WHERE a % 2 = 0 UNION ALL SELECT a, b, 1 FROM pairs) x GROUP BY a, b")
q("snk04_daily_append", lambda d: f"WITH days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {{events}} GROUP BY 1), fresh AS (SELECT day, n + 1 AS n FROM days ORDER BY day DESC LIMIT 2), merged AS (SELECT * FROM fresh UNION ALL SELECT days.day, days.n FROM days WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.day = days.day)) SELECT {d.varchar('day')} AS day, n FROM merged ORDER BY merged.day DESC LIMIT 30")
q("snk05_rotate", lambda d: "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x WHERE rn <= 5")
q("snk07_archive", lambda d: f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n, {'sha2(text, 256)' if d.name == 'spark' else 'sha256(text)'} AS digest FROM {{documents}} WHERE length(text) > 5000")

# --- filters
q("flt12_sources", lambda d: "SELECT doc_id FROM {documents} WHERE source NOT IN ('src1', 'src2', 'src3')")
q("flt19_eligible", lambda d: "SELECT p_partkey FROM {part} WHERE p_size <> 1 AND NOT (p_name LIKE 'Part 1%') AND (p_brand = 'Brand#1' OR p_partkey IN (SELECT l_partkey FROM {lineitem}))")
q("flt20_since", lambda d: "SELECT conv_id FROM (SELECT conv_id, max(turn) AS ended, min(turn) AS started FROM {conversations} GROUP BY conv_id) x WHERE coalesce(ended, started, 0) >= 3")
q("flt24_cold", lambda d: "SELECT c_custkey, CAST(date_diff_ AS BIGINT) AS days_since FROM (SELECT c_custkey, DATEDIFF_EXPR AS date_diff_ FROM {customer} JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM {orders} GROUP BY 1) o ON o_custkey = c_custkey CROSS JOIN (SELECT max(o_orderdate) AS now FROM {orders}) m WHERE c_mktsegment <> 'BUILDING') x WHERE date_diff_ >= 90".replace("DATEDIFF_EXPR", "datediff(now, last)" if d.name == "spark" else "date_diff('day', CAST(last AS DATE), CAST(now AS DATE))"))
q("flt25_hot", lambda d: "SELECT o_custkey, count(*) AS accesses FROM {orders} GROUP BY o_custkey HAVING count(*) >= 15")
q("flt29_remove_candidates", lambda d: "SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 20 THEN 'auto' WHEN doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 0) THEN 'verify' ELSE 'keep' END AS action FROM {documents}")
q("flt30_dependencies", lambda d: "SELECT down.o_orderkey AS job, CASE WHEN up.o_orderstatus = 'F' THEN 'upstream_failed' ELSE 'ran_before_upstream' END AS issue FROM {orders} down JOIN {orders} up ON up.o_orderkey = down.o_orderkey - 1 WHERE up.o_orderstatus = 'F' OR up.o_orderdate > down.o_orderdate")
q("flt31_zombies", lambda d: "SELECT s_suppkey FROM {supplier} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_linenumber = 7)")

# --- joins
q("join01_freshness", lambda d: "SELECT t.doc_id FROM {documents} t JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 1 THEN 'stale' END AS stored FROM {documents}) h ON h.doc_id = t.doc_id WHERE stored IS NULL OR stored <> md5(text)")
q("join02_siblings", lambda d: f"WITH {NODES}, seeds AS (SELECT id, parent FROM nodes WHERE kind = 'knowledge_point' AND id % 50 = 0) SELECT id, CAST(0.5 AS DOUBLE) AS score FROM nodes WHERE parent IN (SELECT parent FROM seeds) AND id NOT IN (SELECT id FROM seeds)")
q("join03_shared_entities", lambda d: "WITH bridge AS (SELECT DISTINCT l_orderkey AS unit, l_partkey AS entity FROM {lineitem}) SELECT a.unit AS seed, b.unit AS peer, least(1.0, count(*) / 5.0) AS score FROM bridge a JOIN bridge b ON a.entity = b.entity AND a.unit <> b.unit WHERE a.unit % 50 = 0 GROUP BY a.unit, b.unit".replace("least(1.0, count(*) / 5.0)", "least(CAST(1 AS DOUBLE), count(*) / CAST(5 AS DOUBLE))"))
q("join04_edge_hops", lambda d: f"WITH {PAIRS}, sides AS (SELECT a AS seed, b AS peer, n FROM pairs UNION ALL SELECT b, a, n FROM pairs) SELECT seed, peer, round(least(CAST(1 AS DOUBLE), sum(n) / CAST(3 AS DOUBLE)), 6) AS score FROM sides WHERE seed % 50 = 0 GROUP BY seed, peer")
q("join05_multi_hop", lambda d: f"WITH {PAIRS}, routes AS (SELECT b AS id, 1 AS route, least(CAST(1 AS DOUBLE), n / CAST(3 AS DOUBLE)) AS score FROM pairs WHERE a = 7 UNION ALL SELECT p_partkey, 2, CAST(0.5 AS DOUBLE) FROM {{part}} WHERE p_brand = (SELECT p_brand FROM {{part}} WHERE p_partkey = 7) AND p_partkey <> 7 UNION ALL SELECT p_partkey, 3, CAST(0.4 AS DOUBLE) FROM {{part}} WHERE p_size = (SELECT p_size FROM {{part}} WHERE p_partkey = 7) AND p_partkey <> 7), one AS (SELECT id, route, score, row_number() OVER (PARTITION BY id ORDER BY route, score DESC) AS rn FROM routes) SELECT id, route, round(score, 6) AS score FROM one WHERE rn = 1")
q("join06_orphans", lambda d: "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey".replace("LEFT ANTI JOIN", "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"))
q("join07_without_entities", lambda d: "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
q("join08_orphan_nodes", lambda d: f"WITH {PAIRS}, ends AS (SELECT a AS id FROM pairs WHERE n > 1 UNION SELECT b FROM pairs WHERE n > 1) SELECT p_partkey FROM {{part}} WHERE p_partkey NOT IN (SELECT id FROM ends)")
q("join09_cooccurrence", lambda d: f"WITH {USES}, s AS (SELECT DISTINCT session, node % 25 AS subject FROM uses), c AS (SELECT x.subject AS a, y.subject AS b, count(*) AS n FROM s x JOIN s y ON x.session = y.session AND x.subject < y.subject GROUP BY 1, 2) SELECT a, b, n, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS rate FROM c")
q("join15_as_of", lambda d: "WITH v AS (SELECT o_custkey AS k, o_totalprice AS val, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, o_orderkey FROM {orders}), asked AS (SELECT o_custkey AS k, max(o_orderdate) - INTERVAL '200' DAY AS t FROM {orders} GROUP BY 1) SELECT asked.k, max(o_orderkey) AS o_orderkey FROM asked JOIN v ON v.k = asked.k AND valid_from <= t AND (valid_to IS NULL OR valid_to > t) GROUP BY asked.k")
q("join16_versions", lambda d: "SELECT o_custkey AS k, o_orderkey AS version, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM {orders}")
q("join17_eval_traffic", lambda d: f"WITH e AS (SELECT user_id, ts, CAST(floor({d.epoch('ts')} / 3600) AS BIGINT) AS b FROM {{events}} WHERE event_type = 'error'), m AS (SELECT event_id, user_id, ts, CAST(floor({d.epoch('ts')} / 3600) AS BIGINT) AS b FROM {{events}} WHERE event_type = 'view'), near AS (SELECT user_id, ts, {d.explode('[b, b + 1]' if d.name == 'duckdb' else 'array(b, b + 1)')} AS b FROM e) SELECT event_id, EXISTS (SELECT 1 FROM near WHERE near.user_id = m.user_id AND near.b = m.b AND m.ts >= near.ts AND m.ts <= near.ts + INTERVAL '3600' SECOND) AS is_eval FROM m")
q("join18_causal_boost", lambda d: f"WITH {PAIRS}, s AS (SELECT p_partkey AS id, p_size / CAST(50 AS DOUBLE) AS score FROM {{part}}), f AS (SELECT b AS id, sum(ln(least(1 + 0.05 * s.score * coalesce(n / CAST(10 AS DOUBLE), 0.5), 1.10))) AS g FROM pairs JOIN s ON s.id = pairs.a GROUP BY b) SELECT s.id, round(score * exp(coalesce(g, 0)), 6) AS score FROM s LEFT JOIN f ON f.id = s.id")
q("join19_subject_edges", lambda d: f"WITH v AS (SELECT vec_id, label, embedding, sqrt({d.dot('embedding', 'embedding')}) AS n FROM {{embeddings}}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM v) SELECT a.vec_id AS a, b.vec_id AS b FROM r a JOIN r b ON a.label = b.label AND a.vec_id < b.vec_id AND a.rn <= 100 AND b.rn <= 100 WHERE {d.dot('a.embedding', 'b.embedding')} / (a.n * b.n) > 0.25")
q("join23_link_dedup", lambda d: f"WITH {PAIRS}, l AS (SELECT a AS f, b AS t, n FROM pairs UNION ALL SELECT b, a, n + 1 FROM pairs) SELECT least(f, t) AS a, greatest(f, t) AS b, {d.best('n', '-f', '-t')} AS n FROM l GROUP BY 1, 2")
q("join24_cross_dedup", lambda d: "SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM {documents} m WHERE m.source = 'src0' AND m.text = d.text) THEN 0.5 ELSE 1.0 END AS factor FROM {documents} d WHERE d.source <> 'src0'".replace("0.5 ELSE 1.0", "CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE)"))
q("join25_pair_outcomes", lambda d: "WITH p AS (SELECT doc_id, quality FROM {labels}), c AS (SELECT doc_id, (quality + doc_id) % 2 AS quality FROM {labels}) SELECT CASE WHEN p.quality < c.quality THEN 'improved' WHEN p.quality > c.quality THEN 'regressed' WHEN p.quality = 1 THEN 'stable' ELSE 'persistent' END AS outcome, count(*) AS n FROM p JOIN c ON p.doc_id = c.doc_id GROUP BY 1")
q("join28_find", lambda d: f"WITH {NODES} SELECT id, name FROM nodes LEFT JOIN {{documents}} ON doc_id = id WHERE name ILIKE '%china%' OR text ILIKE '%idiot%'")
q("join29_source_pairs", lambda d: "WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem}), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rn FROM r) SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.rn <= 50 AND b.rn <= 50 AND NOT EXISTS (SELECT 1 FROM {part} WHERE p_partkey = a.l_partkey AND p_size = 1)")
