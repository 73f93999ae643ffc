"""Further queries: similarity zones, semantic lookups, trees of clusters, merges of small groups, quality checks, parsing."""

from __future__ import annotations

from memloom.functions import gates as g
from memloom.functions import text as t
from memloom.functions.dialect import SPARK
from memloom.operators import cluster, dedup, parse
from memloom.plans.base import Registry, table
from memloom.plans.ranking import _bigrams, cents, cos, vecs
from memloom.plans.relational import NODES
from pyspark.sql import functions as F

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
q = R.sql


q("ded15_normal_bigram_jaccard", lambda d: f"SELECT conv_id, turn, round(CASE WHEN x = y AND x <> '' THEN CAST(1 AS DOUBLE) ELSE {t.jaccard(d, t.grams(d, 'x'), t.grams(d, 'y'))} END, 6) AS sim FROM (SELECT conv_id, turn, {d.sub('lower(text)', r'\s+')} AS x, {d.sub('lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))', r'\s+')} AS y FROM {{conversations}} WHERE text IS NOT NULL) z WHERE y IS NOT NULL")
q("ded22_match_entity", lambda d: f"WITH e AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM {{nation}}), m AS (SELECT DISTINCT lower(substring(n_name, 1, 6)) AS mention FROM {{nation}}), x AS (SELECT mention, id, CASE WHEN name = mention THEN CAST(2 AS DOUBLE) ELSE {t.dice(d, t.grams(d, 'mention', 3), t.grams(d, 'name', 3))} END AS sim FROM m CROSS JOIN e), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY sim DESC, id) AS rn FROM x WHERE sim >= 0.5) SELECT mention, id FROM r WHERE rn = 1")
q("vec04_batch_cosine", lambda d: f"{vecs(d)}, u AS (SELECT * FROM v WHERE vec_id = 0) SELECT v.vec_id, round(coalesce(CASE WHEN v.vec_id % 7 <> 0 THEN {cos(d, 'u', 'v')} END, 0), 6) + CAST(0 AS DOUBLE) AS sim FROM v CROSS JOIN u")
q("vec08_local_query", lambda d: f"{vecs(d)}, {cents(d)}, k AS (SELECT label, count(*) AS m FROM v GROUP BY label) SELECT v.vec_id, round({d.at('v.embedding', '1')} + CASE WHEN m >= 20 THEN 0.3 * {d.at('cn.embedding', '1')} ELSE 0 END, 6) AS q1 FROM v JOIN cn ON cn.label = v.label JOIN k ON k.label = v.label")
q("vec12_match_or_create", lambda d: f"{vecs(d)}, {cents(d)}, s AS (SELECT v.vec_id, cn.label, {cos(d, 'v', 'cn')} AS sim FROM v CROSS JOIN cn), m AS (SELECT vec_id, {d.best('label', 'sim', '-label')} AS label, max(sim) AS sim FROM s GROUP BY vec_id) SELECT vec_id, CASE WHEN sim > 0.3 THEN {d.varchar('label')} ELSE 'new' END AS subject FROM m")
q("vec13_locate_subject", lambda d: f"{vecs(d)}, {cents(d)}, s AS (SELECT v.vec_id, cn.label, {cos(d, 'v', 'cn')} AS sim FROM v CROSS JOIN cn), m AS (SELECT vec_id, {d.best('label', 'sim', '-label')} AS label FROM s GROUP BY vec_id), k AS (SELECT vec_id, label AS hit FROM v WHERE vec_id % 4 = 0) SELECT m.vec_id, coalesce(k.hit, m.label) AS subject, k.hit IS NOT NULL AS by_keyword FROM m LEFT JOIN k ON k.vec_id = m.vec_id")
q("vec14_semantic_domain", lambda d: f"{vecs(d)}, {cents(d)}, s AS (SELECT v.vec_id, cn.label, {cos(d, 'v', 'cn')} AS sim FROM v CROSS JOIN cn) SELECT vec_id, {d.best('label', 'sim', '-label')} AS domain FROM s GROUP BY vec_id HAVING max(sim) > 0.28")
q("clu17_backfill", lambda d: "SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {conversations} WHERE text IS NOT NULL) x WHERE rn = 1")
q("join26_similar_history", lambda d: f"WITH h AS (SELECT conv_id, turn, {t.word_set(d, 'text')} AS w FROM {{conversations}} WHERE text IS NOT NULL AND turn > 0), n AS (SELECT conv_id, {t.word_set(d, 'text')} AS w FROM {{conversations}} WHERE text IS NOT NULL AND turn = 0), s AS (SELECT h.conv_id, h.turn, {t.jaccard(d, 'h.w', 'n.w')} AS sim FROM h JOIN n ON n.conv_id = h.conv_id) SELECT conv_id, turn, round(sim, 6) AS sim FROM s WHERE sim > 0")
q("join27_subject_load", lambda d: f"WITH {NODES} SELECT s.id AS subject, count(p.id) AS points, {d.join(d.map(d.first(d.collect('p.id'), 3), 'i', d.varchar('i')), ',')} AS ids FROM nodes s JOIN nodes p ON p.parent = s.id WHERE s.kind = 'subject' GROUP BY s.id HAVING count(p.id) >= 3")
q("flt27_compress_quality", lambda d: f"SELECT doc_id, length(short) >= 20 AND length(short) <= 0.9 * length(text) AND {d.size(d.inter(t.key_numbers(d, 'text'), t.key_numbers(d, 'short')))} * 2 >= {d.size(t.key_numbers(d, 'text'))} AND {d.size(d.inter(t.proper_nouns(d, 'text'), t.proper_nouns(d, 'short')))} * 4 >= {d.size(t.proper_nouns(d, 'text'))} AS ok FROM (SELECT doc_id, text, {t.head_tail(d, 'text', 400)} AS short FROM {{documents}} WHERE text IS NOT NULL) x")
q("fn05_enriched", lambda d: f"SELECT doc_id, CASE WHEN contains(text, '[tags:') OR length(text) > 200 THEN text ELSE concat(text, ' [tags: ', lang, ', ', source, ']') END AS text FROM {{documents}} WHERE text IS NOT NULL")
q("fn15_capped_keywords", lambda d: f"SELECT doc_id, {d.join(d.first(d.distinct(d.map(d.all('text', '[A-Za-z]{4,}'), 'w', 'lower(w)')), 8) if d.name == 'spark' else 'list_transform(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(text, ' + d.lit('[A-Za-z]{4,}') + '), lambda w: lower(w))), lambda w: {p: list_position(list_transform(regexp_extract_all(text, ' + d.lit('[A-Za-z]{4,}') + '), lambda y: lower(y)), w), w: w}))[1:8], lambda s: s.w)', ',')} AS words FROM {{documents}} WHERE text IS NOT NULL".replace("{p:", "{{'p':").replace(", w: w}", ", 'w': w}}") if d.name == "spark" else f"SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(ws), lambda w: {{'p': list_position(ws, w), 'w': w}}))[1:8], lambda s: s.w), ',') AS words FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda w: lower(w)) AS ws FROM documents WHERE text IS NOT NULL) x")
q("fn22_judge_reply", lambda d: f"SELECT event_id, round(least(1, greatest(0, CAST({d.one('s', '([0-9]+[.]?[0-9]*)', 1)} AS DOUBLE))), 6) AS score FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('score: ', {d.varchar('event_id % 3')}, '.', {d.varchar('event_id % 7')}) ELSE {d.varchar('event_id % 5')} END AS s FROM {{events}}) x")
q("fn42_choice_label", lambda d: f"SELECT conv_id, turn, coalesce(nullif({d.one('text', '[(]([A-D])[)]', 1)}, ''), nullif({d.one('text', '^([A-D])([ .]|$)', 1)}, ''), upper(substring(text, 1, 1))) AS label FROM {{conversations}} WHERE text IS NOT NULL")
q("fn55_keyword_marks", lambda d: f"WITH rules AS (SELECT 'license' AS word, '作废' AS mark UNION ALL SELECT 'idiot', '可疑'), h AS (SELECT doc_id, mark, row_number() OVER (PARTITION BY mark ORDER BY doc_id DESC) AS rn FROM {{documents}} CROSS JOIN rules WHERE contains(lower(text), word) AND NOT {d.has('text', '标记: ')}) SELECT doc_id, mark FROM h WHERE rn <= 500")
q("str04_hour_of_state", lambda d: "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS BIGINT) AS running FROM {events} GROUP BY 1, 2")


@R.add("ded08_minhash_pairs")
def ded08_minhash_pairs(spark, sf_dir):
    return dedup.minhash_pairs(_bigrams(spark, sf_dir), 0.8).withColumn("sim", F.round("sim", 6))


@R.add("ded12_text_dedup")
def ded12_text_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND turn = 0")
    sets = docs.select(F.col("conv_id").alias("id"), F.expr(t.word_set(SPARK, t.denoised(SPARK, "text"))).alias("items"))
    return dedup.survivors(sets.select("id", F.col("id").alias("ord")), dedup.similar_pairs(sets, 0.8, strict=True)).select("id", "kept")


@R.add("ded16_point_dedup")
def ded16_point_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    sets = docs.select(F.col("item_id").alias("id"), F.expr(t.grams(SPARK, "regexp_replace(lower(text), '\\\\s+', '')")).alias("items"))
    return dedup.survivors(sets.select("id", F.col("id").alias("ord")), dedup.similar_pairs(sets, 0.85)).select("id", "kept")


@R.add("clu07_tree")
def clu07_tree(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return cluster.build_tree(e, max_depth=2)


@R.add("clu11_split_subject")
def clu11_split_subject(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return cluster.density_clusters(e, "grp", min_cluster_size=5, min_samples=2).groupBy("grp").agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("parts"), F.count("*").alias("n"))


@R.add("fn20_mask")
def fn20_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr("CASE event_id % 4 WHEN 0 THEN concat('mask: ', '{\"h\": true, \"kt\": false, \"confidence\": 0.9}') WHEN 1 THEN '{\"h\": 1, \"confidence\": 0.1}' WHEN 2 THEN 'no json' ELSE props END").alias("reply"))
    return e.select("event_id", parse.parse_mask("reply").alias("m")).select("event_id", "m.*")


@R.add("fn21_json_reply")
def fn21_json_reply(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done")).alias("reply"))
    return e.select("event_id", parse.parse_json("reply").alias("json"))
