"""Knowledge upkeep against plain Python models and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.functions import content
from memloom.operators import knowledge


SLOW, POOL = ("缓存过期", "请求变慢", 0.9, "causes"), ("连接池耗尽", "问题根因", 0.85, "causes")
#: What sentences state, said by hand.
STATED = {
    "缓存过期引发请求变慢": [SLOW],
    "缓存过期带来请求变慢，别的没有": [SLOW],
    "数据库连接失败": [("数据库连接", "系统异常", 0.6, "caused_by")],
    "Pool_9 超时": [],
    "Pool_9超时": [("Pool_9", "系统异常", 0.6, "caused_by")],
    "因为磁盘满了，所以写入停止": [("磁盘满了", "写入停止", 0.8, "causes")],
    "因为 磁盘满了,写入才 停止服务": [("磁盘满了", "停止服务", 0.8, "causes")],
    "因为磁盘满了": [],
    "根因是连接池耗尽": [POOL],
    "根源为 连接池耗尽。": [POOL],
    "缓存过期引发请求变慢。根因是连接池耗尽": [SLOW, POOL],
    "根因是连接池耗尽。缓存过期引发请求变慢": [SLOW, POOL],
    "一切正常": [],
    "": [],
}


def texts(n, seed):
    return random.Random(seed).choices(list(STATED), k=n)


def test_causal_pairs(spark):
    noise = next(w for w in content.NOISE_WORDS if len(w) > 1 and not w.isascii())
    cases = STATED | {f"{noise}引发请求变慢": [], f"缓存过期引发{noise}": []}
    got = spark.createDataFrame([(t,) for t in cases] + [(None,)], "text string").select("text", content.causal_pairs("text").alias("p")).collect()
    assert {r.text: [tuple(x) for x in r.p] for r in got} == cases | {None: []}


@pytest.mark.parametrize("new", [None, "fresh"])
def test_causal_links(spark, new):
    units = [(g, g * 10 + k, t, k % 2 == 0) for g in range(6) for k, t in enumerate(texts(5, g + 7))]
    units.append((9, 11, units[1][2], True))
    want = {}
    for g, a, t, fresh in sorted(units):
        for h, b, _, other in units:
            if g == h and a != b and (new is None or fresh or other):
                for cause, effect, confidence, kind in STATED[t]:
                    want.setdefault((a, b, kind), (cause, effect, confidence))
    got = knowledge.causal_links(spark.createDataFrame(units, "grp int, unit_id int, text string, fresh boolean"), new).collect()
    assert {(r.from_id, r.to_id, r.kind): (r.cause, r.effect, r.confidence) for r in got} == want and len(got) == len(want)


def test_enrichment(spark):
    rows = [("t", ["缓存过期", "请求超时"]), ("t", ["导致", "缓存过期", "系统"]), ("t", ["缓存", "缓存"]), ("t [因果来源：x]", ["缓存过期", "请求超时"]), ("t", ["缓存过期", "x"]), ("t", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, w array<string>").select(content.enriched(F.col("t"), F.col("w"))).collect()]
    assert got == ["t。[因果来源：缓存过期] [因果结果：请求超时] 与 缓存过期 相关。", "t", "t", "t [因果来源：x]", "t", "t"]


def test_merge_gate(spark):
    long = "数据库连接池耗尽 connection pool exhausted again and again "
    merges = [(1, "连接池 connection pool"), (2, long * 2), (3, "2024-05-06 " + long), (4, "unrelated words"), (5, ""), (6, "lonely"), (7, "pool words")]
    members = [(1, long), (1, long), (2, long), (3, "2024/5/6 " + long), (4, long), (5, long), *[(7, "other things entirely here")] * 3, (7, "pool")]
    got = {r.merge_id: r.reason for r in knowledge.valid_merges(spark.createDataFrame(merges, "merge_id int, merged string"), spark.createDataFrame(members, "merge_id int, text string")).collect()}
    assert got == {1: None, 2: "joined", 3: "joined", 4: "uncovered", 5: "empty", 6: "empty", 7: None}


def test_cells(spark):
    n, t, d, z = "number", "text", "date", "time"
    cases = [((n, 1.004, None), (n, 1.0, None), True), ((n, 2.0, None), (t, None, "2"), True), ((t, None, "x"), (t, None, "x"), True), ((t, None, ""), (None, None, None), True), ((None, None, None), (None, None, None), True), ((t, None, "x"), (n, 1.0, None), False), ((d, 45000.4, None), (d, 45000.0, None), True), ((z, None, "10:20:30"), (z, None, "10:20:59"), True), ((z, None, "10:20:30"), (t, None, "10:20"), True), ((n, 0.0, None), (None, None, None), False)]
    kind = "struct<kind:string,number:double,text:string>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    got = {r.i: r.same for r in df.select("i", content.same_cell(F.col("a"), F.col("b")).alias("same")).collect()}
    assert got == {i: same for i, (_, _, same) in enumerate(cases)}


def test_rule_judge_odd_rows(spark):
    responses = spark.createDataFrame([(1, "j", "# Plan\nTool_call: Search", None), (2, "j", None, ["SEARCH"]), (3, "none", "x", None)], "id int, judge_id string, response string, tools array<string>")
    checks = spark.createDataFrame([("j", 0, "section_present", "plan"), ("j", 1, "tool_called", "search"), ("j", 2, "max_chars", "no number")], "judge_id string, pos int, op string, arg string")
    got = {r.id: (r.hard, round(r.soft, 3), r.rationale) for r in knowledge.rule_judge(responses, checks).collect()}
    assert got == {1: (0.0, 0.667, "failed: max_chars=no number"), 2: (0.0, 0.333, "failed: section_present=plan, max_chars=no number"), 3: (0.0, 0.0, "no checks")}


def test_mentions(spark):
    messages = spark.createDataFrame([(1, "please run skill-matcher now"), (2, "the matcher of this skill"), (3, "xskill-matcher"), (4, None), (5, "data api")], "id int, text string")
    skills = spark.createDataFrame([("core/skill-matcher",), ("data-api",), ("---",)], "skill string")
    assert sorted(map(tuple, knowledge.mentions(messages, skills).collect())) == [(1, "core/skill-matcher"), (2, "core/skill-matcher")]


def test_numbered_and_inserted(spark):
    rows = spark.createDataFrame([(k * 7 % 101, f"n{k}", None if k == 3 else f"t{k}") for k in range(101)], "pos int, name string, text string").repartition(5)
    assert sorted((r.pos, r.nth) for r in knowledge.numbered(rows, ["pos"]).collect()) == [(k, k + 1) for k in range(101)]
    nodes = spark.createDataFrame([(40, "old", "subject", None)], "id long, name string, kind string, parent long")
    made, said = knowledge.insert_points(nodes, spark.createDataFrame([], "node_id long, text string"), rows, 40)
    want = {41 + k * 7 % 101: (f"n{k}", None if k == 3 else f"t{k}") for k in range(101)}
    assert {r.id: r.name for r in made.collect()} == {40: "old"} | {i: n for i, (n, _) in want.items()}
    assert {r.node_id: r.text for r in said.collect()} == {i: t for i, (_, t) in want.items()}
    assert knowledge.insert_points(nodes, said.limit(0), rows.limit(0))[0].count() == 1
