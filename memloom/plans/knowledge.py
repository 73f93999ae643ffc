"""Queries of memloom.operators.knowledge and memloom.functions.content. Each calls the library; its SQL is written apart, from the semantics."""

from __future__ import annotations

from memloom.functions import content
from memloom.operators import knowledge
from memloom.plans.base import Registry, table
from pyspark.sql import Window
from pyspark.sql import functions as F

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: The conversations state causes in Chinese: every turn's first words are put into sentences of the four families.
_SAID = "concat(coalesce({0}, ''), '导致', coalesce({1}, ''), '，', coalesce({2}, ''), '超时。因为', coalesce({3}, ''), '，其余正常，所以', coalesce({4}, ''), CASE WHEN turn % 3 = 0 THEN concat('。根因是', coalesce({0}, '')) ELSE '' END)"
_SAID_DUCK = _SAID.format(*[f"string_split(text, ' ')[{k}]" for k in range(1, 6)])
_UNITS = f"u AS (SELECT conv_id AS grp, conv_id * 1000 + turn AS unit_id, {_SAID_DUCK} AS text, turn % 2 = 1 AS fresh FROM conversations WHERE text IS NOT NULL)"


def _units(spark, sf_dir):
    words = [f"get(split(text, ' '), {k})" for k in range(5)]
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("grp"), F.expr("conv_id * 1000 + turn").alias("unit_id"), F.expr(_SAID.format(*words)).alias("text"), F.expr("turn % 2 = 1").alias("fresh"))


_LIST = "[" + ", ".join(f"'{w}'" for w in content.NOISE_WORDS) + "]"
_STOP = "[" + ", ".join(f"'{w}'" for w in (*content.NOISE_WORDS, *content.CAUSAL_STOP)) + "]"
_C = r"[\x{4e00}-\x{9fff}\p{L}\p{M}\p{N}_]"


def _family(rank: int, pattern: str, effect: str | None, confidence: float, kind: str) -> str:
    other = f"unnest(regexp_extract_all(text, '{pattern}', 2))" if effect is None else f"'{effect}'"
    return f"SELECT grp, unit_id, fresh, {rank} AS family, unnest(range(len(regexp_extract_all(text, '{pattern}', 1)))) AS place, unnest(regexp_extract_all(text, '{pattern}', 1)) AS cause, {other} AS effect, CAST({confidence} AS DOUBLE) AS confidence, '{kind}' AS kind FROM u"


_FAMILIES = " UNION ALL ".join(
    (
        _family(1, f"({_C}{{2,20}})(?:导致|引发|造成|引起|触发|带来)({_C}{{2,20}})", None, 0.9, "causes"),
        _family(2, f"({_C}{{2,15}})(?:失败|报错|崩溃|超时|卡死)", "系统异常", 0.6, "caused_by"),
        _family(3, f"因为\\s*({_C}{{2,15}})[，,].*?(?:才|就|所以|因此|从而)\\s*({_C}{{2,20}})", None, 0.8, "causes"),
        _family(4, f"(?:根因|根源)(?:是|为)\\s*({_C}{{2,20}})", "问题根因", 0.85, "causes"),
    )
)
_PAIRS = f"""{_UNITS},
raw AS ({_FAMILIES}),
p AS (SELECT * FROM raw WHERE NOT list_contains({_LIST}, cause) AND NOT list_contains({_LIST}, lower(cause)) AND (family IN (2, 4) OR NOT list_contains({_LIST}, effect) AND NOT list_contains({_LIST}, lower(effect))))"""
_LINKS = f"""{_PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, kind ORDER BY family, place) AS nth FROM p WHERE confidence >= 0.6),
x AS (SELECT r.unit_id AS from_id, u.unit_id AS to_id, r.kind, r.confidence, r.grp, r.cause, r.effect, u.text, list_filter([r.cause, r.effect], lambda w: NOT list_contains({_STOP}, w)) AS w FROM r JOIN u ON u.grp = r.grp AND u.unit_id <> r.unit_id WHERE r.nth = 1 AND {{fresh}})
SELECT from_id, to_id, kind, confidence, grp, cause, effect, CASE WHEN contains(text, '[因果来源：') OR len(w) < 2 OR w[1] = w[2] OR length(w[1]) < 2 OR length(w[2]) < 2 THEN text
ELSE text || '。[因果来源：' || w[1] || '] [因果结果：' || w[2] || '] 与 ' || w[1] || ' 相关。' END AS enriched_to_text FROM x"""


@R.add("fn04_causal_pairs", f"WITH {_PAIRS} SELECT unit_id, cause, effect, confidence, kind, count(*) AS n FROM p GROUP BY ALL")
def fn04_causal_pairs(spark, sf_dir):
    pairs = _units(spark, sf_dir).select("unit_id", F.explode(content.causal_pairs("text")).alias("p"))
    return pairs.select("unit_id", "p.*").groupBy("unit_id", "cause", "effect", "confidence", "kind").agg(F.count("*").alias("n"))


@R.add("join21_causal_groups", "WITH " + _LINKS.replace("{fresh}", "true"))
def join21_causal_groups(spark, sf_dir):
    return knowledge.causal_links(_units(spark, sf_dir))


@R.add("join22_causal_new", "WITH " + _LINKS.replace("{fresh}", "(r.fresh OR u.fresh)"))
def join22_causal_new(spark, sf_dir):
    return knowledge.causal_links(_units(spark, sf_dir), "fresh")


_MERGED = "concat(CASE WHEN conv_id % 5 = 0 THEN '2024-05-06 ' ELSE '' END, substring(text, 1, 10 + CAST(conv_id % 400 AS INT)))"


@R.add(
    "flt26_merge_quality",
    f"""WITH m AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN '2024-05-06 ' ELSE '' END || substring(text, 1, 10 + CAST(conv_id % 400 AS INTEGER)) AS merged FROM conversations WHERE turn = 0),
e AS (SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN '2024/5/6 ' ELSE '' END || text AS text FROM conversations WHERE text IS NOT NULL),
k AS (SELECT m.conv_id, coalesce(merged, '') AS merged, e.text, list_distinct(regexp_extract_all(e.text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-zA-Z]{{4,}}')) AS own, list_distinct(regexp_extract_all(coalesce(merged, ''), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-zA-Z]{{4,}}')) AS ks FROM m LEFT JOIN e ON e.conv_id = m.conv_id),
a AS (SELECT conv_id, any_value(merged) AS merged, any_value(ks) AS ks, count(text) AS n, sum(length(text)) AS total, count(*) FILTER (regexp_matches(text, '[0-9]{{4}}[年/-][0-9]{{1,2}}')) AS dated, max(len(list_intersect(own, ks)) / greatest(len(own), 1)) AS top, avg(len(list_intersect(own, ks)) / greatest(len(own), 1)) AS mean FROM k GROUP BY conv_id)
SELECT conv_id AS merge_id, CASE WHEN n = 0 OR merged = '' THEN 'empty' WHEN length(merged) > 0.8 * total THEN 'joined' WHEN dated = n AND regexp_matches(merged, '[0-9]{{4}}[年/-][0-9]{{1,2}}') AND length(merged) >= 0.5 * total THEN 'dated'
WHEN len(ks) > 0 AND CASE WHEN n <= 3 THEN top <= 0 ELSE mean < 0.15 END THEN 'uncovered' END AS reason FROM a""",
)
def flt26_merge_quality(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    merges = c.where("turn = 0").select(F.col("conv_id").alias("merge_id"), F.expr(_MERGED).alias("merged"))
    return knowledge.valid_merges(merges, c.select(F.col("conv_id").alias("merge_id"), F.expr("concat(CASE WHEN conv_id % 10 = 0 THEN '2024/5/6 ' ELSE '' END, text)").alias("text")))


@R.add("flt28_tag_quality", "SELECT doc_id AS entry_id FROM documents WHERE length(text) >= 20 AND (source = 'src1' OR lang <> 'de')")
def flt28_tag_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    moves = docs.select(F.col("doc_id").alias("entry_id"), F.expr("array(IF(source = 'src1', source, ''), IF(lang <> 'de', lang, null))").alias("tags"))
    return knowledge.valid_moves(moves, docs.select(F.col("doc_id").alias("entry_id"), "text")).select("entry_id")


#: Old and new statements of one conversation, with a condition in front and a denial now and then. Only equal conditions, or none, are the same.
_STATED = "concat(CASE turn % 3 WHEN 0 THEN '如果缓存没有命中则' WHEN 1 THEN '如果缓存没有命中那么' ELSE '' END, CASE WHEN (conv_id + turn) % 2 = 0 THEN '不能' ELSE '可以' END, substring(text, 1, 20))"


@R.add(
    "fn25_conflicts",
    """WITH s AS (SELECT conv_id, turn, (conv_id + turn) % 2 = 0 AS denied, turn % 10 / 10.0 AS sim FROM conversations WHERE text IS NOT NULL)
SELECT a.conv_id, a.turn AS new_turn, b.turn AS old_turn FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.sim > 0.05 AND a.denied <> b.denied AND (a.turn % 3 = b.turn % 3 OR a.turn % 3 = 2 OR b.turn % 3 = 2)""",
)
def fn25_conflicts(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.expr(_STATED).alias("text"), F.expr("turn % 10 / 10.0").alias("sim"))
    old = s.select("conv_id", F.col("turn").alias("old_turn"), F.col("text").alias("old_text"))
    pairs = s.select("conv_id", F.col("turn").alias("new_turn"), F.col("text").alias("new_text"), "sim").join(old, "conv_id").where("old_turn < new_turn")
    return knowledge.conflicts(pairs, 0.05).select("conv_id", "new_turn", "old_turn")


CHECKS = [("en", 0, "contains", "THE"), ("en", 1, "min_chars", "200"), ("en", 2, "regex", "[0-9]{3}"), ("fr", 0, "max_chars", "3000"), ("fr", 1, "tool_called", "src1"), ("de", 0, "section_present", "license"), ("de", 1, "unheard_of", None)]


@R.add(
    "fn35_rule_judge",
    """WITH d AS (SELECT doc_id AS id, lang, coalesce(text, '') AS r, source FROM documents),
c AS (SELECT id, 'en' AS lang, 0 AS pos, contains(lower(r), 'the') AS ok, 'contains=THE' AS what FROM d UNION ALL SELECT id, 'en', 1, length(r) >= 200, 'min_chars=200' FROM d UNION ALL SELECT id, 'en', 2, regexp_matches(r, '[0-9]{3}'), 'regex=[0-9]{3}' FROM d
UNION ALL SELECT id, 'fr', 0, length(r) <= 3000, 'max_chars=3000' FROM d UNION ALL SELECT id, 'fr', 1, lower(source) = 'src1' OR regexp_matches(r, '(?i)\\btool_call\\s*:\\s*src1\\b'), 'tool_called=src1' FROM d
UNION ALL SELECT id, 'de', 0, regexp_matches(r, '(?im)^\\s{0,3}(#{1,6}\\s*.*license|\\*\\*.*license.*\\*\\*\\s*:?)\\s*$') OR regexp_matches(r, '(?im)^\\s*license\\s*:'), 'section_present=license' FROM d UNION ALL SELECT id, 'de', 1, true, '' FROM d),
a AS (SELECT c.id, count(*) AS n, count(*) FILTER (ok) AS passed, string_agg(what, ', ' ORDER BY pos) FILTER (NOT ok) AS failed FROM c JOIN d ON d.id = c.id AND d.lang = c.lang GROUP BY c.id)
SELECT d.id, CASE WHEN passed = n THEN 1.0 ELSE 0.0 END AS hard, coalesce(passed / n, 0.0) AS soft, CASE WHEN n IS NULL THEN 'no checks' WHEN passed = n THEN 'all checks passed' ELSE 'failed: ' || failed END AS rationale FROM d LEFT JOIN a ON a.id = d.id""".replace("\\\\", "\\"),
)
def fn35_rule_judge(spark, sf_dir):
    responses = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("judge_id"), F.col("text").alias("response"), F.array("source").alias("tools"))
    return knowledge.rule_judge(responses, spark.createDataFrame(CHECKS, "judge_id string, pos int, op string, arg string"))


@R.add(
    "fn43_cell_equality",
    """SELECT l_orderkey, l_linenumber, round(l_discount, 2) = round(l_tax, 2) AS numbers, round(l_quantity, 2) = round(CAST(CAST(l_linenumber AS VARCHAR) AS DOUBLE), 2) AS number_text, l_returnflag = l_linestatus AS texts, l_linenumber = 1 AS empties FROM lineitem""",
)
def fn43_cell_equality(spark, sf_dir):
    cell = lambda kind, number="null", text="null": content.cell(F.expr(kind), F.expr(number), F.expr(f"CAST({text} AS string)"))
    same = lambda a, b: content.same_cell(a, b)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        same(cell("'number'", "l_discount"), cell("'number'", "l_tax")).alias("numbers"),
        same(cell("'number'", "l_quantity"), cell("'text'", text="l_linenumber")).alias("number_text"),
        same(cell("'text'", text="l_returnflag"), cell("'text'", text="l_linestatus")).alias("texts"),
        same(cell("'text'", text="IF(l_linenumber = 1, '', 'x')"), cell("CAST(null AS string)")).alias("empties"),
    )


@R.add(
    "fn58_estimate_quality",
    """SELECT doc_id, round(CASE WHEN text IS NULL OR length(text) < 10 THEN 0.1 WHEN length(text) > 10000 THEN 0.3 ELSE least(1.0, 0.4 + CASE WHEN contains(text, 'def ') OR contains(text, 'class ') THEN 0.15 ELSE 0 END
+ CASE WHEN contains(text, '\"\"\"') OR contains(text, chr(39) || chr(39) || chr(39)) OR starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), '#') THEN 0.1 ELSE 0 END
+ least(0.15, 0.03 * len(list_filter(['if ', 'for ', 'return', 'import', 'while', 'try', 'with '], lambda k: contains(lower(text), k)))) + CASE WHEN length(text) BETWEEN 100 AND 5000 THEN 0.1 ELSE 0 END) END, 6) AS quality FROM documents""".replace('\\"', '"'),
)
def fn58_estimate_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(content.component_quality(F.col("text")), 6).alias("quality"))


@R.add(
    "fn59_component_kind",
    """SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(lower(text), 'def |function') THEN 'function' WHEN regexp_matches(lower(text), 'import|from ') THEN 'import' WHEN contains(lower(text), 'class ') THEN 'class'
WHEN regexp_matches(lower(text), 'if |for |while ') THEN 'control_flow' WHEN regexp_matches(lower(text), 'try |except') THEN 'error_handling' ELSE 'general' END AS kind FROM documents""",
)
def fn59_component_kind(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content.component_kind(F.col("text")).alias("kind"))


#: Skills are named by the third and fourth word of the benchmark's items.
_SKILL = "concat('kit/', {0}, '-', {1})"


@R.add(
    "flt22_mentions",
    r"""WITH s AS (SELECT DISTINCT 'kit/' || string_split(text, ' ')[3] || '-' || string_split(text, ' ')[4] AS skill FROM benchmark WHERE len(string_split(text, ' ')) >= 4),
l AS (SELECT skill, lower(regexp_extract(skill, '[^/]*$')) AS leaf, list_filter(string_split_regex(lower(regexp_extract(skill, '[^/]*$')), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM s),
t AS (SELECT skill, leaf, words, list_filter(words, lambda w: length(w) >= 3 AND w NOT IN ('ai', 'ml', 'llm', 'rag', 'api', 'agent', 'system', 'dev', 'ops', 'data')) AS telling FROM l WHERE len(words) > 0),
m AS (SELECT doc_id AS id, lower(text) AS low, string_split_regex(lower(text), '[^a-z0-9]+') AS have FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT id, skill FROM m JOIN t ON (len(telling) >= 2 AND list_has_all(have, telling)) OR (contains(low, leaf) AND regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(leaf) || '([^a-z0-9]|$)'))""",
)
def flt22_mentions(spark, sf_dir):
    skills = table(spark, sf_dir, "benchmark").where("size(split(text, ' ')) >= 4").select(F.expr(_SKILL.format("split(text, ' ')[2]", "split(text, ' ')[3]")).alias("skill"))
    return knowledge.mentions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), skills)


@R.add(
    "clu12_small_domains",
    """WITH v AS (SELECT vec_id % 37 AS domain, embedding FROM embeddings WHERE embedding IS NOT NULL AND (vec_id % 37 > 5 OR vec_id < 700)),
k AS (SELECT domain, count(*) AS n FROM v GROUP BY domain),
x AS (SELECT domain, p, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT domain, unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM v) u GROUP BY domain, p),
c AS (SELECT domain, list(m ORDER BY p) AS c FROM x GROUP BY domain),
s AS (SELECT a.domain, b.domain AS target, list_cosine_similarity(a.c, b.c) AS sim FROM c a JOIN k ka ON ka.domain = a.domain AND ka.n < 24 CROSS JOIN c b JOIN k kb ON kb.domain = b.domain AND kb.n >= 24),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sim DESC, target) AS nth FROM s WHERE sim > 0.1)
SELECT k.domain, k.n, r.target, round(r.sim, 5) AS sim FROM k LEFT JOIN r ON r.domain = k.domain AND nth = 1 WHERE k.n < 24""",
)
def clu12_small_domains(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND (vec_id % 37 > 5 OR vec_id < 700)").select(F.expr("vec_id % 37").alias("domain"), F.col("embedding").alias("vec"))
    return knowledge.small_domain_targets(points, 24, 0.1).withColumn("sim", F.round("sim", 5))


@R.add(
    "snk03_batch_insert",
    """WITH n AS (SELECT n_nationkey AS id, n_name AS name FROM nation), r AS (SELECT p_partkey AS pos, p_name AS name, 'about ' || p_name AS text FROM part),
i AS (SELECT row_number() OVER (ORDER BY pos) + (SELECT max(id) FROM n) AS id, name, text FROM r)
SELECT id, name, 'knowledge_point' AS kind, 7 AS parent, text FROM i UNION ALL SELECT id, name, 'subject', NULL, NULL FROM n""",
)
def snk03_batch_insert(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("subject").alias("kind"), F.lit(None).cast("long").alias("parent"))
    texts = spark.createDataFrame([], "node_id long, text string")
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.concat(F.lit("about "), "p_name").alias("text"))
    nodes, texts = knowledge.insert_points(nodes, texts, records, parent=7)
    return nodes.join(texts.withColumnRenamed("node_id", "id"), "id", "left")


@R.add("ded11_paged_dedup", "WITH p AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS page FROM documents WHERE text IS NOT NULL) SELECT doc_id, row_number() OVER (PARTITION BY page, text ORDER BY doc_id) > 1 AS redundant FROM p")
def ded11_paged_dedup(spark, sf_dir):
    rows = knowledge.numbered(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), ["doc_id"])
    first = F.min("nth").over(Window.partitionBy(F.expr("(nth - 1) div 500"), F.sha2("text", 256)))
    return rows.select("doc_id", (F.col("nth") > first).alias("redundant"))
