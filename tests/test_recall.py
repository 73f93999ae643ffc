"""The order of a recall's stages, marks, votes and replies against plain loops."""

import json
import math
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from memloom.operators import curate, rank, recall

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


def trigrams(s):
    s = s.strip().lower()
    n = min(3, len(s)) or 1
    return {s[i : i + n] for i in range(len(s) - n + 1)} if s else set()


def plain_recall(rows, points, links, most, mmr):
    out = []
    for query in sorted({r[0] for r in rows} | {p[0] for p in points}):
        own, score = [r for r in rows if r[0] == query], {}
        own = [r for r in own if not re.search(r"\[标记: (错误|作废|可疑|待验证)\]", r[2][-100:])]
        for _, i, text, s, _, hits, _ in own:
            score[i] = min(s * min(1 + 0.1 * (hits - 1), 2.0), 2.0) if hits > 1 else s
        for q, _, src, dst, w in sorted(links):
            if q == query and src in score and dst in score and score[src] > 0:
                score[dst] *= min(1 + 0.05 * score[src] * (w or 0.5), 1.10)
        fused = {}
        for _, i, text, _, ce, _, at in own:
            s = score[i] * (0.3 if "[标记: 已解决]" in text[-100:] else 1)
            if s >= 0.35:
                days = max(0.0, (NOW - at).total_seconds() / 86400) if at else None
                fused[i] = (s * (0.3 + 0.7 * (0.5 if days is None else math.exp(-days / 30))), text, ce)
        kept = [i for _, i in sorted((r, i) for q, i, r in mmr if q == str(query))]
        assert set(kept) <= set(fused)
        ces = [fused[i][2] for i in kept if (fused[i][2] or 0) >= 0.5]
        if len(kept) > 3 and len(ces) >= 2:
            span = max(ces) - min(ces)
            kept = kept[:3] if span > 0.9 else kept[: min(max(3, min(most // 2, len(kept))), most)] if span > 0.7 else kept
        tree = []
        for q, i, text, name, s in points:
            if q == query:
                a = trigrams(text or name)
                alike = any(len(a & b) / len(a | b) >= 0.65 for b in (trigrams(fused[k][1]) for k in kept) if a and b)
                s = None if s is None else s * (0.5 if alike else 1)
                tree.append((-(0.45 if s is None else 0.5 + 0.4 * min(max(s, 0), 1)), i))
        out += [(str(query), "recall", i, pytest.approx(fused[i][0]), r) for r, i in enumerate(kept, 1)]
        out += [(str(query), "tree", i, pytest.approx(-s), len(kept) + r) for r, (s, i) in enumerate(sorted(tree), 1)]
    return out


def test_whole_order(spark, monkeypatch):
    rng = random.Random(20)
    said = ["the router keeps a cache", "vectors live in an index", "the graph has edges", "tokens are counted twice", "a tree of knowledge points"]
    marks = ["", "", "", "\n[标记: 错误]", "\n[标记: 已解决] ok", "[标记: 可疑]" + " x" * 80]
    rows = [(q, i, rng.choice(said) + f" {i}" + rng.choice(marks), round(rng.random() * 1.2, 3), rng.choice([None, 0.3, 0.55, 0.8, 1.0, 1.5]), rng.choice([1, 1, 2, 30]), rng.choice([None, NOW - timedelta(days=rng.randrange(90)), NOW + timedelta(days=3)])) for q in range(12) for i in range(rng.randrange(1, 16))]
    links = [(q, n, rng.randrange(16), rng.randrange(16), rng.choice([None, 0.5, 3.0])) for q in range(12) for n in range(20)]
    points = [(q, 100 + i, rng.choice([None, "", rng.choice(said) + f" {i}", "something else entirely"]), "a name", rng.choice([None, -1.0, 0.4, 2.0])) for q in range(14) for i in range(5)]
    seen = []
    plain = rank.mmr
    monkeypatch.setattr(rank, "mmr", lambda *a: seen.append(plain(*a)) or seen[0])
    got = recall.post_process(
        spark.createDataFrame(rows, "query long, id long, text string, score double, ce double, hits int, at timestamp"),
        spark.createDataFrame(points, "query long, id long, text string, name string, score double"),
        spark.createDataFrame(links, "query long, ord long, src long, dst long, weight double"),
        F.lit(NOW),
        8,
    )
    got = sorted(map(tuple, got.collect()), key=lambda r: (int(r[0]), r[4]))
    want = plain_recall(rows, points, links, 8, [(r.query, r.id, r.rank) for r in seen[0].collect()])
    assert got == sorted(want, key=lambda r: (int(r[0]), r[4]))


def test_marks(spark):
    cases = {
        "今天服务崩溃了": "崩溃", "连接失败": "失败", "worker hit OOM again": "OOM", "BOOM": None, "oom": "OOM", "异常处理方案": None, "失败原因分析": None, "失败了，没有人知道": "失败", "讨论崩溃": None,
        "讨论会之后服务又崩溃了": "崩溃", "讨论后又崩溃了": None, "讨论会之后很久很久服务才崩溃": "崩溃", "没有任何错误，但超时": None, "请求超时": "超时", "测试 通过，此前报错": None, "熔断\n[标记: 可疑]": None, "未找到文件": "未找到", "": None, "fine": None, "无 bug": None,
        "超时时间设置": None, "任务阻塞在队列": "阻塞", "拒绝连接然后宕机": "宕机", "降级后稳定": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "text string")
    got = {r.text: r.m.keyword if r.m else None for r in df.select("text", curate.keyword_mark("text").alias("m")).collect()}
    assert got.pop(None) is None and got == cases
    kinds = dict(curate.RULES)
    assert all(r.m.mark == kinds[r.m.keyword] for r in df.select(curate.keyword_mark("text").alias("m")).collect() if r.m)


def test_votes(spark):
    rows = [(0, 0, "remove", "1", "a"), (1, 0, "remove", "1", "b"), (1, 1, "remove", "2", "c"), (0, 1, "remove", "-1", "x"), (0, 0, "compress", "3", "first"), (1, 0, "compress", "3", "second"), (0, 1, "compress", "4", "alone"),
            (0, 0, "merge", "1,2", "m0"), (1, 0, "merge", "1,2", "m1"), (1, 1, "merge", "2,1", "m2"), (0, 0, "flagged", "9", "f0"), (1, 0, "flagged", "9", "f1"), (0, 0, "flagged", None, "f2"), (1, 0, "hindsight", "7", "late")]
    got = curate.merged_votes(spark.createDataFrame(rows, "round int, pos int, kind string, key string, value string"), 2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("remove", "1", "b"), ("remove", "2", "c"), ("compress", "3", "first"), ("merge", "1,2", "m0"), ("flagged", "9", "f0"), ("flagged", "9", "f1"), ("flagged", None, "f2")], key=str)


def plain_reply(s):
    s = s.strip()
    if s.startswith("```"):
        s = re.sub(r"\n?```$", "", re.sub(r"^```[a-zA-Z]*\n?", "", s)).strip()

    def cut(v):
        try:
            return None if v is None else max(0.0, min(1.0, float(v)))
        except (TypeError, ValueError):
            return None

    try:
        o = json.loads(s)
    except ValueError:
        o = None
    if isinstance(o, dict):
        whole = next((cut(o.get(k)) for k in ("overall", "score", "relevance") if cut(o.get(k)) is not None), None)
        return (whole, cut(o.get("hindsight")), cut(o.get("knowledge_tree")), cut(o.get("sag")))
    m = re.search(r"[01](?:\.\d+)?", s)
    return (min(1.0, float(m[0])), None, None, None) if m else None


def test_judge_replies(spark):
    cases = ['{"overall": 0.7, "sag": 2}', '```json\n{"overall": "0.25", "hindsight": null, "knowledge_tree": -3}\n```', '{"score": 0.5}', '{"relevance": 1, "overall": "x"}', "0.8", "about 0.6 or so", "1.7", "[0.4]", "none", "", '{"overall": true, "sag": [1]}', '{"overall": {"a": 1}}', '{"broken": 0.9', "  \n0\n", '"0.3"', "nul"]
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    got = {r.text: tuple(r.s) if r.s else None for r in df.select("text", curate.judge_reply("text").alias("s")).collect()}
    assert got == {c: plain_reply(c) for c in cases}


def test_choice_labels(spark):
    choices = [("A", "Four"), ("b.", "Five apples"), ("C", None), (None, "none of these")]
    cases = {"<answer> a) </answer>": "A", "thinking\n\nB.": "B", "<ANSWER>x</ANSWER> then <answer>five\napples</answer>": "FIVE\nAPPLES", "It is\nFive Apples": "B", "c: because": "C", "none of these": "", "D": "D", "": "", None: "", "the A": "THE A"}
    df = spark.createDataFrame([(k, choices) for k in cases], "reply string, choices array<struct<label: string, text: string>>")
    assert {r.reply: r.l for r in df.select("reply", curate.choice_label("reply", "choices").alias("l")).collect()} == cases
