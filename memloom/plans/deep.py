"""Queries of the operators that keep indexes, trees, caches and ordered state; their SQL is written apart."""

from __future__ import annotations

import math
import uuid

from memloom.functions import text as t
from memloom.functions.dialect import DUCK
from memloom.operators import causal, cluster, curate, edits, expand, fulltext, ivf, knowledge, lineage, recall, reports, scores, skills, stats, temporal, tree, vectors
from memloom.plans import ranking, relational
from memloom.plans.base import Registry, rounded, table
from memloom.plans.streams import _shared
from memloom.sources import files, sinks, use_log
from memloom.streaming import semantic_cache
from pyspark.sql import Window
from pyspark.sql import functions as F

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _folder(spark):
    return f"{_shared(spark)}/memloom-index-{uuid.uuid4().hex}"


@R.add("vec02_ivf_search")
def vec02_ivf_search(spark, sf_dir):
    """As vec02_nearest, through an index whose recall on a sample of the queries is at least 0.95."""
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = ivf.build(known, _folder(spark))
    queries = known.where("id % 50 = 0").withColumnRenamed("id", "qid")
    probes, _ = ivf.calibrated(index, queries, 5, 0.95, other=True)
    return ivf.search(index, queries, 5, probes, other=True)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"


@R.add(
    "src16_indexed_search",
    f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM d) GROUP BY ALL),
f AS (SELECT w, CAST(round(256 * ln(1 + (SELECT count(*) FROM documents) / count(*))) AS BIGINT) AS weight FROM t GROUP BY w),
q AS MATERIALIZED (SELECT item_id AS qid, unnest({_WORDS}) AS w FROM benchmark), m AS (SELECT qid, count(*) AS words FROM q GROUP BY qid),
s AS MATERIALIZED (SELECT qid, id, CAST(sum(2 * weight * tf // (tf + 1)) AS BIGINT) AS score, count(*) AS hits, any_value(words) AS words FROM q JOIN m USING (qid) JOIN t USING (w) JOIN f USING (w) GROUP BY qid, id),
e AS (SELECT *, max(hits = words) OVER (PARTITION BY qid) AS exact FROM s),
r AS (SELECT qid, id, CASE WHEN exact THEN 'and' ELSE 'or' END AS mode, CASE WHEN exact THEN NULL ELSE score END AS score, round(hits / words, 4) AS confidence,
CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN exact THEN 0 ELSE score END DESC, id DESC) AS INTEGER) AS rank FROM e WHERE NOT exact OR hits = words)
SELECT qid, id, mode, score, confidence, rank FROM r WHERE rank <= 3""",
)
def src16_indexed_search(spark, sf_dir):
    """Each benchmark item as a query: documents with all of its words, else the best by weighted words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = fulltext.build(docs, _folder(spark))
    return fulltext.search(index, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))


_NODES = """nodes AS (SELECT CAST(1000000 + r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name, 'domain' AS kind FROM region
UNION ALL SELECT 2000000 + n_nationkey, 1000000 + n_regionkey, n_name, 'subject' FROM nation UNION ALL SELECT c_custkey, 2000000 + c_nationkey, c_name, 'knowledge_point' FROM customer)"""


def _nodes(spark, sf_dir):
    """The tree region -> nation -> customer: id, parent, name, kind."""
    one = lambda name, *cols: table(spark, sf_dir, name).selectExpr(*cols)
    domains = one("region", "CAST(1000000 + r_regionkey AS LONG) AS id", "CAST(null AS LONG) AS parent", "r_name AS name", "'domain' AS kind")
    subjects = one("nation", "CAST(2000000 + n_nationkey AS LONG) AS id", "CAST(1000000 + n_regionkey AS LONG) AS parent", "n_name AS name", "'subject' AS kind")
    points = one("customer", "CAST(c_custkey AS LONG) AS id", "CAST(2000000 + c_nationkey AS LONG) AS parent", "c_name AS name", "'knowledge_point' AS kind")
    return domains.unionByName(subjects).unionByName(points)


@R.add(
    "join10_subject_search",
    f"WITH RECURSIVE {_NODES}, walk(id, name, depth) AS (SELECT id, name, 0 FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, n.name, w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.id WHERE n.kind <> 'knowledge_point') SELECT id, name, depth FROM walk WHERE name ILIKE '%a%' OR name ILIKE '%e%'",
)
def join10_subject_search(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    subjects = nodes.where("kind <> 'knowledge_point'")
    depths = tree.ancestors(subjects)[0].select("id", F.col("depth").cast("int").alias("depth"))
    return subjects.where("name ILIKE '%a%' OR name ILIKE '%e%'").select("id", "name").join(depths, "id")


@R.add(
    "join11_descendants",
    f"WITH RECURSIVE {_NODES}, walk(root, id) AS (SELECT id, id FROM nodes WHERE kind = 'domain' UNION ALL SELECT w.root, n.id FROM nodes n JOIN walk w ON n.parent = w.id) SELECT root, walk.id, name FROM walk JOIN nodes ON nodes.id = walk.id WHERE kind = 'knowledge_point'",
)
def join11_descendants(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    below = tree.descendants(tree.label(nodes), nodes.where("kind = 'domain'").select(F.col("id").alias("root")))
    return below.join(nodes.where("kind = 'knowledge_point'").select("id", "name"), "id").select("root", "id", "name")


@R.add(
    "join12_guarded_descendants",
    f"WITH RECURSIVE {_NODES}, walk(id, path, depth) AS (SELECT id, [CAST(id AS VARCHAR)], 0 FROM nodes WHERE kind = 'domain' UNION ALL SELECT n.id, list_append(w.path, CAST(n.id AS VARCHAR)), w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.id WHERE NOT list_contains(w.path, CAST(n.id AS VARCHAR))) SELECT id, array_to_string(path, '/') AS path, depth FROM walk",
)
def join12_guarded_descendants(spark, sf_dir):
    paths = tree.lineages(tree.label(_nodes(spark, sf_dir)))
    return paths.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), F.col("depth").cast("int").alias("depth"))


@R.add(
    "join13_listing",
    f"WITH RECURSIVE {_NODES}, walk(id, path, depth) AS (SELECT id, name, 0 FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, concat(w.path, '/', n.name), w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.id WHERE w.depth < 2) SELECT id, path, depth FROM walk",
)
def join13_listing(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    labels = tree.label(nodes).where("depth <= 2")
    pairs = tree.descendants(labels, labels.select(F.col("id").alias("root"))).join(nodes.select(F.col("id").alias("root"), "name"), "root")
    path = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("level", "name")))), lambda s: s["name"]), "/")
    return pairs.groupBy("id").agg(path.alias("path"), F.max("level").cast("int").alias("depth"))


@R.add("join14_cascade", f"WITH RECURSIVE {_NODES}, gone(id) AS (SELECT id FROM nodes WHERE name = 'ASIA' OR id = 2000003 UNION ALL SELECT n.id FROM nodes n JOIN gone g ON n.parent = g.id) SELECT id, name FROM nodes WHERE id NOT IN (SELECT id FROM gone)")
def join14_cascade(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    gone = tree.removed(tree.label(nodes), nodes.where("name = 'ASIA' OR id = 2000003").select(F.col("id").alias("root")))
    return nodes.join(gone, "id", "left_anti").select("id", "name")


@R.add(
    "clu16_child_vectors",
    f"WITH RECURSIVE {_NODES}, walk(root, id, depth) AS (SELECT id, id, 0 FROM nodes WHERE kind = 'domain' UNION ALL SELECT w.root, n.id, w.depth + 1 FROM nodes n JOIN walk w ON n.parent = w.id WHERE w.depth < 3) SELECT root, count(*) AS vectors FROM walk JOIN embeddings ON vec_id = walk.id GROUP BY root",
)
def clu16_child_vectors(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    below = tree.descendants(tree.label(nodes), nodes.where("kind = 'domain'").select(F.col("id").alias("root"))).where("level <= 3")
    return below.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id")), "id").groupBy("root").agg(F.count("*").alias("vectors"))


@R.add(
    "join18_link_order",
    """WITH RECURSIVE l AS (SELECT o_orderkey AS g, l_linenumber AS n, max(l_quantity) / 50 AS score, max(l_discount) * 10 AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
s AS (SELECT g, map_from_entries(list((n, score))) AS now FROM l GROUP BY g),
k AS (SELECT a.g, a.n AS src, b.n AS dst, a.w, row_number() OVER (PARTITION BY a.g ORDER BY (a.n * 3 + b.n * 5) % 7, a.n, b.n) AS i FROM l a JOIN l b ON a.g = b.g AND a.n <> b.n),
walk(g, i, now) AS (SELECT g, 0, now FROM s UNION ALL SELECT walk.g, walk.i + 1, map_from_entries(list_transform(map_entries(walk.now), lambda e: (e.key, CASE WHEN e.key = k.dst AND walk.now[k.src] > 0 THEN e.value * least(1 + 0.15 * walk.now[k.src] * CASE WHEN k.w = 0 THEN 0.5 ELSE k.w END, 1.3) ELSE e.value END)))
FROM walk JOIN k ON k.g = walk.g AND k.i = walk.i + 1),
fin AS (SELECT g, unnest(map_entries(now)) AS e FROM (SELECT g, max_by(now, i) AS now FROM walk GROUP BY g))
SELECT g AS within, e.key AS id, round(e.value, 6) AS score FROM fin""",
)
def join18_link_order(spark, sf_dir):
    """A recall is an order: its lines' scores, boosted over links between every two of them, in a mixed order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    lines = lines.groupBy(F.col("l_orderkey").alias("within"), F.col("l_linenumber").alias("id")).agg((F.max("l_quantity") / 50).alias("score"), (F.max("l_discount") * 10).alias("w"))
    pairs = lines.select("within", F.col("id").alias("src"), F.col("w").alias("weight")).join(lines.select("within", F.col("id").alias("dst")), "within").where("src <> dst")  # the lines of one order
    links = pairs.withColumn("ord", (F.col("src") * 3 + F.col("dst") * 5) % 7)
    return causal.boosted(lines, links).select("within", "id", rounded("score", 6).alias("score"))


@R.add(
    "fn57_edit_scripts",
    """WITH RECURSIVE b AS (SELECT doc_id AS id, coalesce(text, '') AS body, coalesce(item, '') AS item FROM documents LEFT JOIN (SELECT item_id, text AS item FROM benchmark) x ON item_id = doc_id % (SELECT count(*) FROM benchmark)),
e AS (SELECT id, 1 AS k, 'replace' AS op, item AS content, split_part(body, ' ', 1) AS anchor FROM b UNION ALL SELECT id, 2, 'delete', '', split_part(body, '. ', 2) FROM b
UNION ALL SELECT id, 3, 'add', item, '' FROM b UNION ALL SELECT id, 4, 'delete', '', item FROM b UNION ALL SELECT id, 5, 'replace', 'x', 'the ' FROM b),
walk(id, k, body, log) AS (SELECT id, 0, body, '' FROM b UNION ALL SELECT id, k, CASE WHEN reason NOT LIKE 'ok%' THEN body WHEN op = 'add' THEN chr(10) || chr(10) || plain || chr(10) || chr(10) || content || chr(10) WHEN op = 'delete' THEN replace(body, anchor, '') ELSE replace(body, anchor, content) END, log || ',' || reason
FROM (SELECT *, CASE WHEN op = 'add' THEN CASE WHEN content = '' THEN 'nothing to add' WHEN length(plain) + length(content) > 30000 THEN 'too long' WHEN length(plain) + length(content) > 12000 THEN 'ok: long' ELSE 'ok' END
WHEN trim(anchor, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'no anchor' WHEN n = 0 THEN 'anchor not found' WHEN n > 1 THEN 'anchor found ' || n || ' times' ELSE 'ok' END AS reason
FROM (SELECT w.id, e.k, op, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS content, anchor, body, log, trim(body, chr(10)) AS plain, CASE WHEN anchor = '' THEN 0 ELSE len(string_split(body, anchor)) - 1 END AS n FROM walk w JOIN e ON e.id = w.id AND e.k = w.k + 1)))
SELECT id, md5(max_by(body, k)) AS body_md5, max_by(log, k) AS log FROM walk GROUP BY id""",
)
def fn57_edit_scripts(spark, sf_dir):
    """Five edits a document: its first word gives way to a benchmark item, its second sentence goes, the item is added, the item goes, 'the ' is replaced."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    total = items.agg(F.count("*").alias("total"))  # one row
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body")).crossJoin(F.broadcast(total))
    docs = docs.withColumn("item_id", F.when(F.col("total") > 0, F.col("id") % F.nullif("total", F.lit(0)))).join(items, "item_id", "left").select("id", "body", F.coalesce("item", F.lit("")).alias("item"))
    one = lambda seq, op, content, anchor: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), content.alias("content"), anchor.alias("anchor"))
    none, item = F.lit(""), F.col("item")
    script = [one(1, "replace", item, F.split_part("body", F.lit(" "), F.lit(1))), one(2, "delete", none, F.split_part("body", F.lit(". "), F.lit(2))), one(3, "add", item, none), one(4, "delete", none, item), one(5, "replace", F.lit("x"), F.lit("the "))]
    done = edits.apply(docs, docs.select("id", F.explode(F.array(*script)).alias("e")).select("id", "e.*"))
    return done.select("id", F.md5("body").alias("body_md5"), F.concat(F.lit(","), F.array_join(F.transform("log", lambda x: x["reason"]), ",")).alias("log"))


@R.add(
    "agg18_welch_test",
    """WITH m AS (SELECT user_id % 10 AS part, avg(value) FILTER (event_type = 'view') AS ma, avg(value) FILTER (event_type = 'click') AS mb, var_samp(value) FILTER (event_type = 'view') / count(value) FILTER (event_type = 'view') AS pa,
var_samp(value) FILTER (event_type = 'click') / count(value) FILTER (event_type = 'click') AS pb, count(value) FILTER (event_type = 'view') AS na, count(value) FILTER (event_type = 'click') AS nb FROM events GROUP BY 1),
w AS (SELECT *, (mb - ma) / sqrt(pa + pb) AS t, (pa + pb) ** 2 / (pa ** 2 / (na - 1) + pb ** 2 / (nb - 1)) AS df FROM m),
g AS (SELECT *, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c FROM w),
i AS (SELECT part, sum((CASE WHEN j IN (0, 4000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * c * (1 + (abs(t) * j / 4000) ** 2 / df) ** (-(df + 1) / 2)) * any_value(abs(t)) / 4000 / 3 AS area FROM g, range(0, 4001) r(j) GROUP BY part)
SELECT part, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(t, 6) AS t, round(df, 4) AS df, round(1 - 2 * area, 6) AS p FROM g JOIN i USING (part)""",
)
def agg18_welch_test(spark, sf_dir):
    """Values of views against clicks, by a tenth of the users; the SQL integrates the density."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("part"), "event_type", "value")
    out = stats.welch(rows, "event_type", "value", "view", "click", ("part",))
    return out.select("part", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "t")], F.round("df", 4).alias("df"), F.round("p", 6).alias("p"))


@R.add("vec16_living_cache")
def vec16_living_cache(spark, sf_dir):
    """Every vector as a request of its label's cache, a minute apart, driven as a stream; a test replays it in a plain loop."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("key"),
        F.col("vec_id").alias("id"),
        F.timestamp_seconds(1_704_067_200 + F.col("vec_id") * 60).alias("at"),
        F.expr("CAST(null AS array<double>)").alias("context"),
        F.col("embedding").cast("array<double>").alias("query"),
        F.concat(F.lit("r"), F.col("vec_id")).alias("answer"),
    )
    rows.repartitionByRange(4, "at").write.parquet(f"{folder}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        answered = semantic_cache.answers(stream, query=0.3, ttl=6 * 3600, most=20)
        answered.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda b, n: use_log.record(b, n, f"{folder}/out", "cache")).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return use_log.read(spark, f"{folder}/out", semantic_cache.ANSWER).select("key", "id", "hit", "entry", "hits", "answer")


@R.add(
    "clu01_silhouette",
    """WITH v AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label >= 0), u AS (SELECT id, cluster, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v),
d AS (SELECT a.id, a.cluster, b.cluster AS other, avg(1 - list_inner_product(a.u, b.u)) AS d, count(*) AS n FROM u a JOIN u b ON a.id <> b.id GROUP BY 1, 2, 3),
s AS (SELECT id, cluster, max(d) FILTER (other = cluster) AS a, min(d) FILTER (other <> cluster) AS b FROM d GROUP BY 1, 2) SELECT id, cluster, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""",
)
def clu01_silhouette(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("grp"), F.col("vec_id").alias("id"), F.col("label").cast("int").alias("cluster"), F.col("embedding").alias("vec"))
    return cluster.silhouette(rows).select("id", "cluster", F.round("silhouette", 6).alias("silhouette"))


def _kw(x):
    return t.keywords(DUCK, x)


@R.add(
    "rnk17_skill_cascade",
    f"""WITH s AS (SELECT vec_id AS id, p_name AS name, p_brand AS description, p_type AS category, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN part ON p_partkey = vec_id),
q AS (SELECT id AS qid, name || ' ' || category AS text, CASE WHEN id % 100 = 0 THEN NULL ELSE e END AS e FROM s WHERE id % 50 = 0),
c AS (SELECT qid, id, round(list_inner_product(q.e, s.e) / sqrt(list_inner_product(q.e, q.e)) / sqrt(list_inner_product(s.e, s.e)), 6) AS emb FROM q JOIN s ON q.e IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY emb DESC, id) AS n FROM c WHERE emb >= 0.25 QUALIFY n <= 30),
left_ AS (SELECT qid, text, {_kw('text')} AS ws FROM q WHERE qid NOT IN (SELECT qid FROM n)),
k AS (SELECT qid, id, name, 5 * len(list_intersect(ws, {_kw('name')})) + 3 * len(list_intersect(ws, {_kw('category')})) + len(list_intersect(ws, {_kw('description')})) + CASE WHEN lower(name) = lower(text) THEN 10 ELSE 0 END AS kw FROM left_, s WHERE category <> '.archive'),
k30 AS (SELECT qid, id, kw FROM k WHERE kw > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY kw DESC, name, id) <= 30),
f AS (SELECT qid, id, n, 0.2 * emb AS w FROM n UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY kw DESC, id), greatest(0.01 * kw, 0) FROM k30),
z AS (SELECT *, count(*) OVER (PARTITION BY qid) AS size FROM f),
w AS (SELECT z.*, q.text, lower(replace(s.name || ' ' || s.description, '.', ' ')) AS own FROM z JOIN s USING (id) JOIN q USING (qid) WHERE size > 3 AND n <= 20),
j AS (SELECT qid, id, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(replace(text, '.', ' ')), '\\s+'), lambda x: length(x) > 2)), list_distinct(list_filter(string_split_regex(own, '\\s+'), lambda x: length(x) > 2)))) AS m FROM w),
o AS (SELECT qid, id, round(least(1, 0.5 + m / 10), 6) AS score, 'judge' AS stage FROM j WHERE m >= 2 UNION ALL SELECT qid, id, round(least(0.49, 0.3 + w), 6), CASE WHEN size <= 3 THEN 'early' ELSE 'fallback' END FROM z WHERE size <= 3 OR (n <= 20 AND qid NOT IN (SELECT qid FROM j WHERE m >= 2)))
SELECT qid, id, score, stage, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM o QUALIFY rank <= 3""",
)
def rnk17_skill_cascade(spark, sf_dir):
    """Parts with a vector as skills; the ids divisible by 50 as queries, half of them without their vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    own = e.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.col("p_type").alias("category")), "id")
    queries = own.where("id % 50 = 0").select(F.col("id").alias("qid"), F.concat_ws(" ", "name", "category").alias("text"), F.when(F.col("id") % 100 != 0, F.col("vec")).alias("vec"))
    return skills.match(queries, own, threshold=0.25)


@R.add("rnk13_whole_recall")
def rnk13_whole_recall(spark, sf_dir):
    """A recall is the 30 nearest of a vector whose id is divisible by 50, with the text of the document of that id; customers' parts of it come from the same label."""
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    near = vectors.nearest(known, known.where("id % 50 = 0").withColumnRenamed("id", "qid"), 30, among="other").join(texts, "id", "left")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    recalled = near.select(F.col("qid").alias("query"), "id", "text", (F.col("sim") * 2).alias("score"), F.col("sim").alias("ce"), (F.col("id") % 4 + 1).cast("int").alias("hits"), (now - F.make_dt_interval(days=F.col("id") % 60)).alias("at"))
    pair = near.select(F.col("qid").alias("query"), F.col("rank").alias("ord"), F.col("id").alias("src"))
    links = pair.join(pair.select("query", (F.col("ord") - 1).alias("ord"), F.col("src").alias("dst")), ["query", "ord"]).withColumn("weight", F.lit(0.5))
    points = near.where("rank % 5 = 0").select(F.col("qid").alias("query"), (F.col("id") + 1_000_000).alias("id"), "text", F.lit("point").alias("name"), F.col("sim").alias("score"))
    return recall.post_process(recalled, points, links, now, least=0.2).withColumn("score", F.round("score", 6))


@R.add(
    "agg30_vote_rounds",
    """WITH v AS (SELECT event_id, user_id % 3 AS round, ['remove', 'compress', 'merge', 'flagged'][CAST(event_id % 4 AS INTEGER) + 1] AS kind, CAST(user_id // 3 AS VARCHAR) AS key, event_type || event_id AS value FROM events WHERE user_id IS NOT NULL),
a AS (SELECT kind, key FROM v GROUP BY 1, 2 HAVING count(DISTINCT round) = 3)
SELECT kind, key, value FROM v WHERE kind = 'flagged' UNION ALL SELECT kind, key, value FROM v SEMI JOIN a USING (kind, key) WHERE round = 0 AND kind IN ('compress', 'merge')
UNION ALL SELECT kind, key, value FROM v WHERE kind = 'remove' QUALIFY row_number() OVER (PARTITION BY key ORDER BY round DESC, event_id DESC) = 1""",
)
def agg30_vote_rounds(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("remove", "compress", "merge", "flagged")])
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    votes = e.select((F.col("user_id") % 3).alias("round"), F.col("event_id").alias("pos"), F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("kind"), F.floor(F.col("user_id") / 3).cast("string").alias("key"), F.concat("event_type", "event_id").alias("value"))
    return curate.merged_votes(votes, 3)


@R.add("fn55_mark_rules")
def fn55_mark_rules(spark, sf_dir):
    """Each document with one of 16 fixed reports below it; a test holds the rules against cases by hand."""
    reports = F.array(*[F.lit(x) for x in ("服务崩溃", "异常处理方案", "请求超时", "讨论失败", "测试通过", "worker OOM", "磁盘满", "未找到文件", "熔断", "失败原因分析", "一切正常", "拒绝连接", "降级策略", "任务阻塞在队列", "连接失败", "无法连接")])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", F.get(reports, (F.col("doc_id") % 16).cast("int"))).alias("text"))
    return rows.withColumn("m", curate.keyword_mark("text")).where("m IS NOT NULL").select("doc_id", "m.mark", "m.keyword")


@R.add(
    "fn22_reply_objects",
    """SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN greatest(0, least(1, value / 100)) WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END + 0.25 * (1 - (CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END)) ELSE 1 END, 6) AS overall,
CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 2 AS DOUBLE) END AS sag FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL""",
)
def fn22_reply_objects(spark, sf_dir):
    """Replies in three forms: an object in a fence, a number in words, an object with another field."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL AND user_id IS NOT NULL")
    whole = F.concat(F.lit('```json\n{"overall": "'), (F.col("value") / 100).cast("string"), F.lit('", "sag": '), (F.col("user_id") % 2).cast("string"), F.lit("}\n```"))
    text = F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, F.when(F.col("user_id") % 2 == 0, "about 1, or so").otherwise("it is 0.25")).otherwise(F.lit('{"relevance": 7}'))
    out = e.select("event_id", text.alias("text")).withColumn("s", curate.judge_reply("text"))
    return out.select("event_id", F.round("s.overall", 6).alias("overall"), F.col("s.sag").alias("sag"))


@R.add(
    "fn42_choices",
    """WITH c AS (SELECT n_nationkey, n_name, chr(CAST(65 + n_nationkey % 5 AS INTEGER)) AS label, n_regionkey FROM nation)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN label WHEN 1 THEN label WHEN 2 THEN label ELSE 'NOT SURE' END AS label FROM customer JOIN c ON n_nationkey = c_nationkey""",
)
def fn42_choices(spark, sf_dir):
    """A customer answers with its nation: by label, by text, by a label and words, or not at all; the choices are all nations of the label."""
    n = table(spark, sf_dir, "nation").withColumn("label", F.char(65 + F.col("n_nationkey") % 5))
    choices = F.array(F.struct(F.concat(F.lower("label"), F.lit(".")).alias("label"), F.col("n_name").alias("text")))
    forms = F.array(F.concat(F.lit("I think\n<answer> "), F.lower("label"), F.lit(") </answer>")), F.concat(F.lit("so it is\n"), F.lower("n_name")), F.concat("label", F.lit(". because")), F.lit("not sure"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.get(forms, (F.col("c_custkey") % 4).cast("int")).alias("reply"), choices.alias("choices")).select("c_custkey", curate.choice_label("reply", "choices").alias("label"))


_OFFSETS = """WITH v AS (SELECT vec_id, label, label % 3 AS parent, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, label, parent, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM v),
o AS (SELECT a.label, a.pos, any_value(a.m) - coalesce(avg(b.x), 0) AS o, any_value(a.n) AS n FROM (SELECT label, parent, pos, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2, 3) a LEFT JOIN x b ON b.parent = a.parent AND b.label <> a.label AND b.pos = a.pos GROUP BY 1, 2)"""


def _subjects(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, vectors.subject_offsets(e.select((F.col("label") % 3).alias("parent"), F.col("label").alias("subject"), F.col("embedding").alias("vec")))


@R.add("vec09_offsets", f"{_OFFSETS} SELECT label AS subject, CAST(pos AS INTEGER) AS pos, round(o, 6) AS value FROM o")
def vec09_offsets(spark, sf_dir):
    return _subjects(spark, sf_dir)[1].select("subject", F.posexplode("offset").alias("pos", "value")).withColumn("value", F.round("value", 6))


@R.add("vec08_local_vectors", f"{_OFFSETS} SELECT vec_id AS qid, CAST(pos AS INTEGER) AS pos, round(x + CASE WHEN n >= 20 THEN 0.3 * o ELSE 0 END, 6) AS value FROM x JOIN o USING (label, pos)")
def vec08_local_vectors(spark, sf_dir):
    e, offsets = _subjects(spark, sf_dir)
    out = vectors.local_queries(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("subject"), F.col("embedding").alias("vec")), offsets)
    return out.select("qid", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.round("value", 6))


@R.add(
    "vec11_moves",
    """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v),
p AS (SELECT label AS id, list(m ORDER BY pos) AS vec, any_value(n) AS n FROM (SELECT label, pos, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT vec_id, e, label AS source, (label + 1) % (SELECT count(*) FROM p) AS target FROM v WHERE vec_id % 10 = 3),
m AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY vec_id, leaves) AS k, e, leaves FROM (SELECT source AS id, vec_id, e, true AS leaves FROM t UNION ALL SELECT target, vec_id, e, false FROM t)),
walk(id, k, vec, n) AS (SELECT id, 0, vec, n FROM p UNION ALL SELECT w.id, m.k, CASE WHEN leaves AND n > 1 THEN list_transform(list_zip(vec, e), lambda z: (z[1] * n - z[2]) / (n - 1)) WHEN leaves THEN vec
ELSE list_transform(list_zip(vec, e), lambda z: (1 - least(1 / (n + 1), 0.1)) * z[1] + least(1 / (n + 1), 0.1) * z[2]) END, CASE WHEN leaves AND n > 1 THEN n - 1 WHEN leaves THEN n ELSE n + 1 END FROM walk w JOIN m ON m.id = w.id AND m.k = w.k + 1),
f AS (SELECT id, max_by(vec, k) AS vec, max_by(n, k) AS n FROM walk GROUP BY id) SELECT id, n, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, round(unnest(vec), 5) AS value FROM f""",
)
def vec11_moves(spark, sf_dir):
    """Every vector whose id ends in 3 moves from its label to the next one, in order of ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    parents = vectors.centroid(e, "label", "embedding").select(F.col("label").alias("id"), F.col("centroid").alias("vec"), "n")
    total = e.agg(F.count_distinct("label").alias("labels"))  # one row
    moves = e.where("vec_id % 10 = 3").crossJoin(F.broadcast(total)).select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"), F.col("label").alias("source"), ((F.col("label") + 1) % F.col("labels")).alias("target"))
    out = vectors.after_moves(parents, moves)
    return out.select("id", "n", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.round("value", 5))


@R.add(
    "join05_three_routes",
    """WITH s AS (SELECT c_nationkey AS query, min(c_custkey) AS id FROM customer GROUP BY 1 UNION SELECT c_nationkey, max(c_custkey) FROM customer GROUP BY 1),
e AS (SELECT DISTINCT o_custkey AS id, l_partkey AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL),
g AS (SELECT o_custkey AS a, o_custkey + 3 AS b, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
p AS (SELECT DISTINCT query, c_nationkey % 7 AS parent FROM s JOIN customer ON c_custkey = id),
r1 AS (SELECT query, c_custkey AS id, 0.5 AS score, 0.5 AS o FROM p JOIN customer ON c_nationkey % 7 = parent),
r2 AS (SELECT query, b.id, least(1, count(*) / 5) AS score, count(*) AS o FROM (SELECT DISTINCT query, entity FROM s JOIN e USING (id)) a JOIN e b USING (entity) GROUP BY 1, 2),
r3 AS (SELECT query, b AS id, least(1, sum(n) / 3) AS score, sum(n) AS o FROM s JOIN (SELECT a, b, n FROM g UNION ALL SELECT b, a, n FROM g) ON a = s.id GROUP BY 1, 2),
u AS (SELECT *, 0 AS route, 'subject' AS strategy FROM r1 UNION ALL SELECT *, 1, 'entity' FROM r2 UNION ALL SELECT *, 2, 'edge' FROM r3),
k AS (SELECT * FROM u ANTI JOIN s USING (query, id) QUALIFY row_number() OVER (PARTITION BY query, route ORDER BY o DESC, id) <= 4),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY route) = 1)
SELECT query, id, round(score, 6) AS score, strategy, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, route, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""",
)
def join05_three_routes(spark, sf_dir):
    """A recall is a nation with its first and last customer as seeds: customers of like nations, of shared parts, and over edges."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    seeds = c.groupBy(F.col("c_nationkey").alias("query")).agg(F.array(F.min("c_custkey"), F.max("c_custkey")).alias("ids")).select("query", F.explode("ids").alias("id"))
    points = c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 7).alias("parent"), F.expr("CAST(null AS array<double>)").alias("vec"))
    links = o.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("entity"))
    edges = o.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("a")).agg(F.count("*").alias("n")).select("a", (F.col("a") + 3).alias("b"), "n")
    return expand.expand(points, links, edges, seeds, 10).withColumn("score", F.round("score", 6))


def _through(name):
    """A query that runs the library's function, held against the SQL that stands beside it in relational.py."""

    def register(f):
        R.add(name, relational.ORACLES[name])(f)
        return f

    return register


@_through("src09_event_streams")
def src09_event_streams(spark, sf_dir):
    """The trace as JSON lines with a broken one in ten, read as one stream for each type."""
    path, e = _folder(spark), table(spark, sf_dir, "events")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("event"), "props")
    lines = rows.select(F.to_json(F.struct("*")).alias("value")).unionByName(rows.where("event = 'error'").select(F.lit('{"timestamp": "2024-01-1').alias("value")))
    lines.write.text(path)
    names = ["click", "view", "error", *[r[0] for r in e.where("event_type NOT IN ('click', 'view', 'error')").select("event_type").distinct().collect()]]  # the types of events, a few
    found = None
    for stream in files.event_log(spark, path, "timestamp string, event string, props string", "2024-01-1", names).values():
        found = stream if found is None else found.unionByName(stream)
    return found.groupBy(F.col("event").alias("event_type"), F.substring("timestamp", 1, 10).alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@_through("src13_log_lines")
def src13_log_lines(spark, sf_dir):
    path, e = _folder(spark), table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit(" "), "event_type", F.lit(": v="), F.col("event_id").cast("string"))
    e.select(line.alias("value")).where("value IS NOT NULL").write.text(path)
    return files.log_lines(spark, path).groupBy("day", "level", "module").agg(F.count("*").alias("n"))


@_through("src21_digests")
def src21_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.lit("p").alias("project"), "role", F.coalesce("text", F.lit("")).alias("content"), F.col("turn").alias("ts"))
    out = files.transcripts(rows)
    return out.select(F.col("session_id").alias("conv_id"), F.col("n_user_turns").cast("long").alias("user_turns"), F.col("n_assistant_turns").cast("long").alias("assistant_turns"), F.col("started_at").alias("first_turn"), F.col("ended_at").alias("last_turn"))


@_through("snk01_upsert")
def snk01_upsert(spark, sf_dir):
    side = lambda odd, how: table(spark, sf_dir, "orders").where(f"o_orderkey % 2 = {odd}").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("w")).withColumn("how", F.lit(how))
    merged = sinks.upsert(side(0, "kept").withColumn("first", F.lit("kept")), side(1, "inserted").withColumn("first", F.lit("inserted")), ["k"], {"w": "greatest", "how": "new", "first": "old"})
    return merged.select("k", "w", F.when(F.col("how") == F.col("first"), F.col("how")).otherwise("updated").alias("how"))


@_through("snk05_rotate")
def snk05_rotate(spark, sf_dir):
    return sinks.rotate(table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")), "user_id", "at", 5).select("user_id", "event_id")


@_through("snk04_daily_append")
def snk04_daily_append(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    fresh = days.orderBy(F.desc("date")).limit(2).select("date", (F.col("n") + 1).alias("n"))
    return sinks.daily(days, fresh).select(F.col("date").cast("string").alias("day"), "n")


@_through("snk07_archive")
def snk07_archive(spark, sf_dir):
    kept, _ = sinks.archive(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 5000)
    return kept.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n"), "digest")


@_through("snk02_edge_upsert")
def snk02_edge_upsert(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"))
    pairs = one.join(one.withColumnRenamed("a", "b"), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))  # parts of one order
    edge = lambda df, n: df.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("co").alias("kind"), n.cast("long").alias("n"))
    out = sinks.edges(edge(pairs.where("a % 2 = 0"), F.col("n")), edge(pairs, F.lit(1)))
    return out.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("n").alias("cooccurrence"))


@R.add("clu15_info_density", ranking.ORACLES["clu15_info_density"])
def clu15_info_density(spark, sf_dir):
    out = knowledge.info_density(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return out.select(F.col("id").alias("doc_id"), F.round("density", 4).alias("density"))


@R.add(
    "clu18_versions",
    """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS node, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS version FROM orders WHERE o_custkey IS NOT NULL),
s AS (SELECT CAST(c_custkey AS VARCHAR) AS node, c_name FROM customer)
SELECT node, version, CAST(o_orderkey AS VARCHAR) AS article, CASE WHEN version = max(version) OVER (PARTITION BY node) AND c_name IS NOT NULL THEN 'placed:' || c_name || ',checked:' ELSE '' END AS steps FROM r LEFT JOIN s USING (node)""",
)
def clu18_versions(spark, sf_dir):
    """Orders as sources of their customer: the even ones first, the odd ones in a second run, and two steps for the newest version."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("article"), F.lit("").alias("text"), F.expr("CAST(null AS string)").alias("method"))
    records = lineage.append(lineage.append(spark.createDataFrame([], lineage.SCHEMA), o.where("ord % 2 = 0")), o.where("ord % 2 = 1"))
    c = table(spark, sf_dir, "customer")
    steps = c.select(F.col("c_custkey").alias("node"), F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("placed").alias("step"), F.col("c_name").alias("detail")), F.struct(F.lit(2).alias("ord"), F.lit("checked").alias("step"), F.lit("").alias("detail")))).alias("s")).select("node", "s.*")
    out = lineage.add_steps(records, steps)
    return out.select("node", "version", "article", F.array_join(F.transform("steps", lambda x: F.concat(x["step"], F.lit(":"), x["detail"])), ",").alias("steps"))


@_through("join01_freshness")
def join01_freshness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = F.when(F.col("id") % 3 == 0, F.md5("text")).when(F.col("id") % 3 == 1, "stale")
    return temporal.stale(docs, docs.select("id", stored.alias("hash"))).select(F.col("id").alias("doc_id"))


@_through("join06_orphans")
def join06_orphans(spark, sf_dir):
    return temporal.unlinked(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@_through("join07_without_entities")
def join07_without_entities(spark, sf_dir):
    return temporal.unlinked(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@_through("join08_orphan_nodes")
def join08_orphan_nodes(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"))
    pairs = one.join(one.withColumnRenamed("a", "b"), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")  # parts of one order
    return temporal.unlinked(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", pairs, "a", "b")


@_through("join09_cooccurrence")
def join09_cooccurrence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session"))
    uses = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("session", (F.col("l_partkey") % 25).alias("subject"))
    return temporal.cooccurrence(uses).withColumn("rate", F.round("rate", 6))


@_through("join15_as_of")
def join15_as_of(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("valid_from"), "o_orderkey")
    asked = o.groupBy("k").agg((F.max("valid_from") - F.expr("INTERVAL '200' DAY")).alias("t"))
    found = temporal.as_of(temporal.versions(o, "k", "valid_from", "o_orderkey"), asked, "k", "t")
    return found.where("version IS NOT NULL").select("k", "version.o_orderkey")


@_through("join16_versions")
def join16_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("valid_from"))
    return temporal.versions(o, "k", "valid_from", "version")


@_through("join17_eval_traffic")
def join17_eval_traffic(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return temporal.followed(e.where("event_type = 'view'"), e.where("event_type = 'error'"), "user_id", "ts", 3600, "is_eval").select("event_id", "is_eval")


@R.add("rnk16_synonyms", ranking.ORACLES["rnk16_synonyms"])
def rnk16_synonyms(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("grp"), F.col("p_brand").alias("word"))
    return expand.synonyms(part.where("grp = 0"), part)


def _placed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return e, e.withColumnRenamed("id", "qid")


@R.add("fn26_sibling_conflicts", ranking.ORACLES["fn26_sibling_conflicts"])
def fn26_sibling_conflicts(spark, sf_dir):
    """The bound holds for cosines that are not rounded."""
    known, asked = _placed(spark, sf_dir)
    found = vectors.nearest(known, asked, None, math.nextafter(0.3, 1), among="earlier", within="label", places=None)
    return found.where("id % 2 <> qid % 2").select(F.col("id").alias("a"), F.col("qid").alias("b"))


@R.add("vec01_cosine", ranking.ORACLES["vec01_cosine"])
def vec01_cosine(spark, sf_dir):
    """All pairs of a label; a vector that is null has none, one that is not finite or 0 NaN."""
    known, asked = _placed(spark, sf_dir)
    sound = F.coalesce(vectors.finite("vec") & (vectors.norm("vec") > 0), F.lit(False))
    found = vectors.nearest(known.where(sound), asked.where(sound), None, -math.inf, block=2048, among="earlier", within="label", places=None)
    odd = known.select("id", "label", F.col("vec").isNull().alias("none"), (~sound).alias("odd"))
    pairs = odd.where("odd").alias("x").join(odd.alias("y"), "label").where("x.id <> y.id AND (NOT y.odd OR x.id < y.id)")
    left = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(~F.col("x.none") & ~F.col("y.none"), F.lit(float("nan"))).alias("sim"))
    return found.select(F.col("id").alias("a"), F.col("qid").alias("b"), (rounded("sim", 6) + F.lit(0.0)).alias("sim")).unionByName(left)


@R.add("agg13_rolling_judge", ranking.ORACLES["agg13_rolling_judge"])
def agg13_rolling_judge(spark, sf_dir):
    out = temporal.rolling_judge(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")
    return out.select("event_type", F.round("relevant_rate", 6).alias("relevant_rate"), F.round("mean", 6).alias("mean"))


@R.add("agg19_regressions", ranking.ORACLES["agg19_regressions"])
def agg19_regressions(spark, sf_dir):
    return temporal.regressions(table(spark, sf_dir, "events"), "user_id", F.to_date("ts") >= F.lit("2024-01-15").cast("date"), "value", "value")


def _ranked(name):
    """As _through, for the SQL in ranking.py."""

    def register(f):
        R.add(name, ranking.ORACLES[name])(f)
        return f

    return register


def _candidates(spark, sf_dir):
    """An event is a candidate of its user's query; value / 200 is its score."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.least(F.lit(1.0), F.col("value") / 200).alias("score"), F.col("ts").cast("timestamp").alias("at"), "ts")


def _now(df):
    return df.crossJoin(F.broadcast(df.agg(F.max("at").alias("now"))))  # one row


@_ranked("rnk01_filter_by_score")
def rnk01_filter_by_score(spark, sf_dir):
    out = scores.filtered(_now(_candidates(spark, sf_dir)).withColumn("at", F.col("at") + (F.lit("2024-02-01").cast("timestamp") - F.col("now"))), F.lit("2024-02-01").cast("timestamp"), 0.2, 0.5)
    return out.select("query", "id", *[F.round(c, 6).alias(c) for c in ("base_score", "final_score")], F.col("rank").cast("long").alias("rank"))


@_ranked("rnk03_time_score")
def rnk03_time_score(spark, sf_dir):
    rows = _now(_candidates(spark, sf_dir)).withColumn("at", F.when(F.col("source") != "error", F.col("at")))
    return rows.select(F.col("id").alias("event_id"), F.round(recall.time_score("at", F.col("now")), 6).alias("time_score"))


@_ranked("rnk04_score_span")
def rnk04_score_span(spark, sf_dir):
    return scores.span_cut(_candidates(spark, sf_dir)).select("query", "id", F.round("span", 6).alias("span"))


@_ranked("rnk07_best_known_score")
def rnk07_best_known_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    for name, by, part in (("final", 4, 1), ("rerank", 3, 2), ("base", 2, 4)):
        e = e.withColumn(name, F.when(F.col("event_id") % by == 0, F.col("value") / part))
    return e.select("event_id", F.round(scores.best_known("final", "rerank", "base"), 6).alias("score"))


@_ranked("rnk08_hit_boost")
def rnk08_hit_boost(spark, sf_dir):
    hits = F.row_number().over(Window.partitionBy("query", "source").orderBy("at", "id"))
    return _candidates(spark, sf_dir).withColumn("hits", hits).select("query", "id", F.round(recall.hit_boost(F.col("score"), F.col("hits")), 6).alias("score"))


@_ranked("rnk09_access_weight")
def rnk09_access_weight(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("last", F.lag("at").over(Window.partitionBy("query").orderBy("at", "id")))
    return rows.select(F.col("id").alias("event_id"), F.round(scores.access_weight("at", "last"), 6).alias("weight"))


@_ranked("rnk10_decay")
def rnk10_decay(spark, sf_dir):
    out = _now(_candidates(spark, sf_dir)).withColumn("d", scores.decayed(F.col("score"), scores.access_weight("now", "at")))
    return out.select(F.col("id").alias("event_id"), F.round("d.score", 6).alias("score"), "d.low_priority")


@_ranked("rnk11_tree_score")
def rnk11_tree_score(spark, sf_dir):
    own = F.when(F.col("event_type") != "error", F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", F.round(recall.tree_score(own), 4).alias("score"), F.when(F.col("event_type") == "error", "fallback").otherwise("tree_score").alias("how"))


@_ranked("rnk18_sort_key")
def rnk18_sort_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scores.sort_key(F.col("event_id") % 7, F.col("value") / 100), 6).alias("k"))


@_ranked("rnk20_negative_decay")
def rnk20_negative_decay(spark, sf_dir):
    one = lambda odd, name: table(spark, sf_dir, "events").where(f"event_type = 'error' AND event_id % 2 = {odd}").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias(name))
    return scores.negatives(one(0, "ema"), one(1, "n"), 7).withColumn("ema", F.round("ema", 6))


@_ranked("rnk22_variants")
def rnk22_variants(spark, sf_dir):
    return scores.variants(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("usage")))


@_ranked("rnk25_date_compare")
def rnk25_date_compare(spark, sf_dir):
    shown = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select("event_id", scores.date_order(shown, F.lit("2024-01")).alias("by_month"), scores.date_order(shown, F.lit("2024-01-15")).alias("by_day"))


@_ranked("rnk26_rollout_sets")
def rnk26_rollout_sets(spark, sf_dir):
    return scores.rollouts(table(spark, sf_dir, "events"), "user_id", "value").withColumns({c: F.round(c, 6) for c in ("spread", "pass_rate")})


@_ranked("rnk27_reward")
def rnk27_reward(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("right"), F.avg("value").alias("tokens"), F.count("*").alias("latency"))
    return sums.select("user_id", F.round(scores.reward(F.col("right"), F.col("tokens"), F.col("latency")), 6).alias("reward"))


@_ranked("rnk28_by_quality")
def rnk28_by_quality(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return scores.best_of_kind(p, "p_brand", "p_retailprice", "p_partkey", 5, p.where("p_partkey % 7 = 0")).select("p_brand", "p_partkey")


@_ranked("rnk29_by_coverage")
def rnk29_by_coverage(spark, sf_dir):
    return scores.best_of_kind(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey", 1).select("p_brand", "p_partkey")


@_ranked("rnk31_round_cap")
def rnk31_round_cap(spark, sf_dir):
    rounds = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("n", rounds).select("event_id", scores.most_results(F.col("n")).alias("max_results"))


def _rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


@_ranked("agg03_router")
def agg03_router(spark, sf_dir):
    return _rounded(reports.router(table(spark, sf_dir, "events"), "event_type", "value"), 4, "p50", "p95", "p99", "empty_pct")


@_ranked("agg04_percentile")
def agg04_percentile(spark, sf_dir):
    return _rounded(reports.percentiles(table(spark, sf_dir, "events"), "user_id", "value", {"p90": 0.9}), 6, "p90")


@_ranked("agg05_contribution")
def agg05_contribution(spark, sf_dir):
    out = reports.contribution(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", F.round("mean", 4).alias("mean"), "most", F.round("total", 2).alias("total"), "non_zero")


@_ranked("agg06_token_usage")
def agg06_token_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.length("text").cast("long").alias("n"))
    return reports.token_usage(rows, "source", "n").select("source", F.round(F.col("mean") / 4, 4).alias("mean"), "most", F.round("p90", 4).alias("p90"), F.round("share", 6).alias("share"))


@_ranked("agg07_error_modules")
def agg07_error_modules(spark, sf_dir):
    out = reports.top_modules(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id")
    return out.select(F.col("user_id").alias("module"), "n", F.col("rnk").cast("long").alias("rnk"))


@_ranked("agg09_duration_outliers")
def agg09_duration_outliers(spark, sf_dir):
    return _rounded(reports.duration_outliers(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id"), 4, "latest")


@_ranked("agg14_judge_estimate")
def agg14_judge_estimate(spark, sf_dir):
    return _rounded(reports.judge_estimate(table(spark, sf_dir, "events"), "event_type", F.col("value") / 100, (F.col("value") > 10).cast("int")), 4, "est_avg", "est_rate")


@_ranked("agg16_two_levels")
def agg16_two_levels(spark, sf_dir):
    out = reports.mean_of_means(table(spark, sf_dir, "events"), "event_type", "user_id", "value")
    return out.select("event_type", F.col("members").alias("users"), F.round("mean_of_means", 6).alias("mean_of_means"))


@_ranked("agg22_report")
def agg22_report(spark, sf_dir):
    return _rounded(reports.category_report(table(spark, sf_dir, "events"), "event_type", F.avg("value"), F.min("value"), F.max("value")), 6, "overall")


@_ranked("agg23_score_stats")
def agg23_score_stats(spark, sf_dir):
    return _rounded(reports.score_stats(table(spark, sf_dir, "events"), "user_id", "value"), 6, "mean")


@_ranked("agg25_recent_trend")
def agg25_recent_trend(spark, sf_dir):
    return _rounded(reports.recent_trend(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("value") > 100), 6, "ratio")


@_ranked("agg26_hourly")
def agg26_hourly(spark, sf_dir):
    return _rounded(reports.hourly(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "view"), 6, "hit_rate")


@_ranked("agg27_histogram")
def agg27_histogram(spark, sf_dir):
    return _rounded(reports.histogram(table(spark, sf_dir, "events"), "value", (0, 20, 40, 60, 80)), 6, "mean")


@_ranked("agg33_credibility")
def agg33_credibility(spark, sf_dir):
    rules = {"small_sample": F.count("*") < 60, "errors": F.count(F.when(F.col("event_type") == "error", 1)) > 12}
    return reports.warnings(table(spark, sf_dir, "events"), "user_id", rules).select("user_id", F.array_join("warnings", ",").alias("warnings"))


@_ranked("agg34_confidence_step")
def agg34_confidence_step(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "recall").when(F.col("event_type") == "error", "negated").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", F.round(reports.confidence_step(kind, F.lit(0.5), F.col("value") / 10), 6).alias("confidence"))


@_ranked("agg37_weights")
def agg37_weights(spark, sf_dir):
    return _rounded(reports.weights(table(spark, sf_dir, "events"), F.col("value") / 200), 6, "mean", "low", "high", "low_share")
