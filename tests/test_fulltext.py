"""The inverted index against a plain scan, and what it reads."""

import math
import random
import re
from collections import Counter

import pytest

from memloom.operators import fulltext


def plain(docs, queries, k):
    held = [(i, Counter(re.findall(r"\w+", (t or "").lower()))) for i, t in sorted(docs, key=lambda r: r[0])]
    df = Counter(w for _, c in held for w in c)
    out = []
    for qid, text in queries:
        said = set(re.findall(r"\w+", (text or "").lower()))
        full = [i for i, c in held if said and all(w in c for w in said)][::-1][:k]
        if full:
            out += [(qid, i, "and", None, 1.0, r) for r, i in enumerate(full, 1)]
            continue
        weight = {w: int(math.floor(256 * math.log(1 + len(held) / df[w]) + 0.5)) for w in said if df[w]}
        scored = [(sum(2 * weight[w] * c[w] // (c[w] + 1) for w in said if c[w]), at, i, sum(w in c for w in said)) for at, (i, c) in enumerate(held)]
        best = sorted((s for s in scored if s[3]), reverse=True)[:k]
        out += [(qid, i, "or", s, round(h / len(said), 4), r) for r, (s, _, i, h) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    rare = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(["the"] * rng.randrange(4) + rng.choices(["The", "of", "and", "data"], k=6) + rng.choices(rare, k=rng.randrange(8)))) for i in range(900)]
    docs += [(900, None), (901, ""), (902, "Élan Größe data_x 漢字"), (903, "w5 w5 w5 w6")]
    df = spark.createDataFrame(docs, "id long, text string")
    return docs, fulltext.build(df, f"file://{tmp_path_factory.mktemp('index')}/a", bits=5)


def test_equal_to_a_scan(spark, corpus):
    docs, index = corpus
    rng = random.Random(7)
    queries = [(i, " ".join(rng.choices([f"w{j}" for j in range(400)] + ["the", "of"] * 40, k=rng.randrange(1, 6)))) for i in range(60)]
    queries += [(100, "the of"), (101, "nowhere the"), (102, "nowhere"), (103, None), (104, "!!"), (105, "größe ÉLAN"), (106, "w5 w6"), (107, "the w1 w2 w3 w4 w5")]
    got = fulltext.search(index, spark.createDataFrame(queries, "qid long, text string"), 3).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, queries, 3)


def test_frequent_words_are_not_read_whole(spark, corpus):
    _, index = corpus
    said = fulltext.asked(index, spark.createDataFrame([(1, "the w1 w2 w3"), (2, "of w9")], "qid long, text string"))
    best, rest = fulltext.open_blocks(index, said, 3)
    blocks = index.postings.select("block").distinct().count()
    assert best.count() and rest.where("qid = 1").count() < blocks / 2  # closed by the bound
    assert fulltext.blocks_with_all(index, said).where("qid = 2").count() < blocks / 2
    plan = fulltext.bounds(index, said)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("most" in r for r in read) and not any("tf" in r for r in read)


def test_empty(spark, corpus, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = fulltext.build(none, f"file://{tmp_path}/none")
    assert fulltext.search(index, spark.createDataFrame([(1, "a b")], "qid long, text string")).count() == 0
    assert fulltext.search(corpus[1], none.withColumnRenamed("id", "qid")).count() == 0
