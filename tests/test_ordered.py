"""Causal boosts, edit scripts and p values against plain loops and known values."""

import random

import duckdb
import pytest
from compare import connect
from pyspark.sql import functions as F

from memloom.operators import causal, edits, stats
from memloom.plans import registry
from memloom.plans.base import rounded


def plain_boost(scores, links, alpha=0.15, cap=1.3):
    now = {}
    for w, i, s in scores:
        if w is not None and i is not None:
            now[w, i] = max(now.get((w, i), -1e9), s or 0.0)
    merged = {}
    for w, o, s, d, x in links:
        if (w, s) in now and (w, d) in now:
            x = x or 0.5
            merged[w, o, s, d] = max(merged.get((w, o, s, d), x), x)
    for (w, _, s, d), x in sorted(merged.items()):
        if now[w, s] > 0:
            now[w, d] *= min(1 + alpha * now[w, s] * x, cap)
    return now


def test_boosts_in_link_order(spark):
    rng = random.Random(8)
    scores = [(w, i, rng.choice([0.0, -0.5, None, rng.random() * 2])) for w in range(6) for i in range(8)] + [(0, 1, 0.1), (None, 1, 1.0)]
    links = [(rng.randrange(7), rng.randrange(30), rng.randrange(9), rng.randrange(8), rng.choice([None, 0.0, rng.random(), 3.0])) for _ in range(200)]
    links += [(1, 5, 2, 2, 1.0), links[0], (1, 40, 3, 4, 1.0), (1, 41, 4, 3, 1.0), (1, 42, 3, 4, 1.0)]
    df = spark.createDataFrame([(*r, 1.0) for r in scores], "within long, id long, score double, factor double")
    lf = spark.createDataFrame(links, "within long, ord long, src long, dst long, weight double")
    got = {(r.within, r.id): r.score for r in causal.boosted(df, lf).collect()}
    want = plain_boost(scores, links)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert causal.boosted(df, lf.limit(0)).count() == len(want) and causal.boosted(df.limit(0), lf).count() == 0


def test_boosts_to_the_last_bit(spark):
    """Each score is multiplied factor after factor; a product of the factors alone, or in another order, differs in the last bits."""
    rng = random.Random(18)
    scores = [(w, i, rng.random()) for w in range(40) for i in range(7)]
    links = [(w, (3 * a + 5 * b) % 7, a, b, rng.random()) for w in range(40) for a in range(7) for b in range(7) if a != b]
    lf = spark.createDataFrame(links, "within long, ord long, src long, dst long, weight double").repartition(7, "weight")
    got = causal.boosted(spark.createDataFrame(scores, "within long, id long, score double"), lf).collect()
    assert {(r.within, r.id): r.score for r in got} == plain_boost(scores, links)


def test_rounding_is_that_of_the_sql(spark):
    values = [1.1378044999999999, 0.3606295, 1.0145125, 0.5045675, 1.0003315, 0.1278615, -0.5045675, -0.3606295, 2.5e-6, 0.49999999999999994e-6, 0.0, 7.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(rounded("v", 6)).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]


def test_link_order_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["join18_link_order"](spark, sf).collect()
    want = connect(sf).sql(registry.ORACLES["join18_link_order"]).fetchall()
    assert {(r.within, r.id, r.score) for r in got} == set(want) and len(got) == len(want)


def plain_edits(body, script, soft, hard):
    body, log = body or "", []
    for seq, op, content, anchor in script:
        op, content = (op or "").strip().lower() or "add", (content or "").strip()
        if op in ("replace", "delete"):
            n = body.count(anchor) if anchor and anchor.strip() else None
            reason = "no anchor" if n is None else "anchor not found" if n == 0 else "ok" if n == 1 else f"anchor found {n} times"
            if n == 1:
                body = body.replace(anchor, content if op == "replace" else "", 1)
        else:
            plain = body.strip("\n")
            size = len(plain) + len(content)
            reason = "nothing to add" if not content else "too long" if size > hard else "ok: long" if size > soft else "ok"
            if reason.startswith("ok"):
                body = "\n\n" + plain + "\n\n" + content + "\n"
        log.append((seq, op, reason))
    return body, log


def test_edit_scripts(spark):
    rng = random.Random(9)
    pieces = ["alpha ", "beta\n", "aa", "aaa", "漢字", " ", "\n\n", "x$1\\", "[.*]"]
    docs = [(i, None if i == 0 else "" if i == 1 else "".join(rng.choices(pieces, k=rng.randrange(1, 12)))) for i in range(60)]
    ops = ["replace", "delete", "add", " Replace ", None, "", "other"]
    script = [(rng.randrange(70), s, rng.choice(ops), rng.choice([None, "", " new　", "$0 \\1", "alpha ", "long " * 8]), rng.choice([None, " ", *pieces])) for s in range(300)]
    script += [(2, None, "add", "first of all", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "id long, body string, log int")
    ef = spark.createDataFrame(script, "id long, seq long, op string, content string, anchor string")
    got = {r.id: (r.body, [tuple(x) for x in r.log]) for r in edits.apply(df, ef, 40, 60).collect()}
    for i, body in docs:
        own = sorted(((e[1] is not None, e[1] or 0, e) for e in script if e[0] == i), key=lambda x: x[:2])
        assert got[i] == plain_edits(body, [e[1:] for _, _, e in own], 40, 60), i
    assert len(got) == 60 and edits.apply(df.limit(0), ef).count() == 0


#: Fixed values from tables of Student's distribution: t, degrees of freedom, two-sided p.
KNOWN = [(12.706204736432095, 1, 0.05), (4.302652729911275, 2, 0.05), (2.228138851964939, 10, 0.05), (3.169272667175838, 10, 0.01), (1.9839715185235518, 100, 0.05), (63.65674116287399, 1, 0.01), (1.0, 1, 0.5), (0.0, 7, 1.0), (1.3721836411102863, 10, 0.2)]


def test_p_values(spark):
    df = spark.createDataFrame([(float(t), float(n), p) for t, n, p in KNOWN], "t double, df double, p double")
    for r in df.withColumn("got", F.expr(stats.p_value("t", "df"))).collect():
        assert r.got == pytest.approx(r.p, abs=1e-9), r
    # closed forms for 1, 2 and 4 degrees, over the whole range of t
    import math

    exact = {1.0: lambda t: 1 - 2 / math.pi * math.atan(t), 2.0: lambda t: 1 - t / math.sqrt(2 + t * t), 4.0: lambda t: 1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t))}
    rows = spark.createDataFrame([(t, n) for n in exact for t in (1e-4, 0.01, 0.3, 1.0, 2.5, 9.0, 40.0)], "t double, df double")
    for r in rows.withColumn("got", F.expr(stats.p_value("t", "df"))).collect():
        assert r.got == pytest.approx(exact[r.df](r.t), abs=1e-9)
    # many degrees come near the normal distribution
    r = spark.sql(f"SELECT {stats.p_value('1.959963984540054D', '1e6D')} AS p").first()
    assert r.p == pytest.approx(0.05, abs=1e-6)


def test_welch(spark):
    rows = [("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", x) for x in (2.0, 4.0, 6.0, 9.0, 9.5)] + [("c", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    r = stats.welch(df, "g", "x", "a", "b").first()
    assert (r.mean_a, r.mean_b) == (2.5, 6.1) and r.t == pytest.approx(3.6 / (1.25 / 3 + 2.06) ** 0.5) and 0.04 < r.p < 0.08
    assert stats.welch(df, "g", "x", "a", "none").first().p == 1.0 and stats.welch(df.limit(0), "g", "x", "a", "b").first().p == 1.0
