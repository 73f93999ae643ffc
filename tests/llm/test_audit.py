"""op11, op12 and op13 against plain loops, on odd, tied, repeated and empty rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import canonical, connect

from memloom.llm import op11_divergence, op12_elkan, op13_piecewise

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [op11_divergence, op12_elkan])
def test_against_sql(spark, module):
    got, want = module.query(spark, SF).toPandas(), connect(SF).sql(module.SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def plain_audit(rows, least_docs=3, top=200):
    groups, docs, everywhere = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    kept = {lang: sorted((t for t, n in docs[lang].items() if n >= least_docs), key=str.encode) for lang, _ in groups}
    for lang, source in groups:
        everywhere[lang].update(groups[lang, source])

    def shares(counts, lang):
        total = sum(counts[t] for t in kept[lang]) + len(kept[lang])
        return [1 + 10**9 * (counts[t] + 1) // total for t in kept[lang]]

    for lang, source in groups:
        p, q = shares(groups[lang, source], lang), shares(everywhere[lang], lang)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(other, sum(map(f, p, shares(groups[lang, other], lang)))) for l2, other in groups if l2 == lang and other != source]
        terms = [(t, f(a, b)) for t, a, b in zip(kept[lang], p, q) if groups[lang, source][t] and a > b]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_audit_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "é", "漢字", "ÀÉ", "\U0001f600", "z", "￮"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "c\x00"]), " 1,".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(120)]
    rows += [("xx", "one", "rare words only"), ("xx", "two", None), ("yy", "lone", ""), ("en", "a", "beta " * 50000), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "t", 5) for r in rows], "lang string, source string, text string, n long, term string, part int")
    want = plain_audit(rows)
    assert sorted(map(tuple, op11_divergence.audit(df).collect())) == want
    assert sorted(map(tuple, op11_divergence.audit(df, cells=8).collect())) == want  # chunks of two terms
    assert op11_divergence.audit(df.limit(0)).count() == 0


def test_dictionary_ids_keep_utf8_order(spark):
    df = spark.createDataFrame([("en", "s", "zeta ￮ \U0001f600 é Beta alpha")] * 3, "lang string, source string, text string")
    ids, groups = op11_divergence.dictionary(df)
    got = [r.term for r in ids.orderBy("id").collect()]
    assert got == sorted(got, key=str.encode) and [r.id for r in ids.orderBy("id").collect()] == list(range(6)) and groups.count() == 1


def test_shares_beyond_64_bits_are_exact():
    big = np.array([0, 10**12, 3 * 10**12], np.int64)
    assert op11_divergence.share(big, 10**13).tolist() == [1 + 10**9 * (c + 1) // 10**13 for c in big.tolist()]


def plain_kmeans(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]
        if step < rounds:
            for j in range(len(at)):
                own = [v for (_, v), (_, m) in zip(kept, near) if m == j]
                at[j] = [sum(x) // len(own) for x in zip(*own)] if own else at[j]
    by = Counter()
    for d, j in near:
        by[j] += d
    most = 2**63 - 1
    return sorted((i, j, min(d, most), min(by[j], most), min(sum(by.values()), most), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near))


@pytest.mark.parametrize("scale", [0.02, 1.0, 1e7])
def test_kmeans_with_ties_and_odd_rows(spark, scale):
    rng = random.Random(5)
    centers = [[rng.choice([-1, 0, 1]) for _ in range(6)] for _ in range(9)]
    rows = [(i, [scale * (x + rng.choice([0, 0, 0.1, -0.2])) for x in rng.choice(centers)]) for i in range(400)]
    rows += [(400, None), (401, [1.0] * 5), (402, [1.0] * 5 + [None]), (403, [math.nan] * 6), (404, [math.inf] * 6), (None, [0.0] * 6), rows[3], rows[3], (7, [0.5] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, n long")
    got = op12_elkan.clusters(op12_elkan.integers(df, 6), k=12, rounds=4, dims=6)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.select(*columns).collect())) == plain_kmeans(rows, 12, 4, 6)
    assert got.selectExpr("sum(computed)").first()[0] < 403 * 12 * 5  # the bounds save work


def test_kmeans_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [r.distance for r in op12_elkan.clusters(op12_elkan.integers(df, 2), dims=2).collect()] == [0, 0]
    assert op12_elkan.clusters(op12_elkan.integers(df.limit(0), 2), dims=2).count() == 0


def test_kmeans_bounds_never_cut_a_nearest():
    """Rounds over drifting centroids with exact ties: the same clusters as all distances give."""
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (500, 4))
    at = v[:20].copy()
    c = op12_elkan.Centroids(at)
    cluster, d, upper, lower, _ = op12_elkan.first(v, c)
    for _ in range(6):
        new = at + rng.integers(-1, 2, at.shape) * (rng.random((20, 1)) < 0.5)
        c, at = op12_elkan.Centroids(new, at), new
        cluster, d, upper, lower, _ = op12_elkan.settle(v, cluster, d, upper, lower, c, True)
        every = ((v[:, None] - at[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all() and (d == every.min(1)).all()


def plain_fingerprint(text):
    """The documented fingerprint byte by byte: rolling hash over 7 bytes, levels, polynomial piece hashes."""
    m = op13_piecewise
    data, cuts = text.encode(), []
    for i in range(len(data)):
        roll = sum((data[i - j] + 1) * pow(m._ROLL, j + 1, 2**32) for j in range(min(m.WINDOW, i + 1))) % 2**32
        roll ^= roll >> 15
        roll = roll * 0x2C1B3C6D % 2**32
        roll ^= roll >> 13
        value, level = (roll + 1) if roll != 2**32 - 1 else 1, -1
        if value % 3 == 0:
            level = ((value // 3) & -(value // 3)).bit_length() - 1
        cuts.append(99 if i == len(data) - 1 else level)
    level = next(x for x in range(99) if sum(c >= x for c in cuts) <= m.PIECES)
    parts = []
    for x in range(level, level + m.LEVELS):
        out, piece = "", []
        for b, c in zip(data, cuts):
            piece.append(b + 1)
            if c >= x:
                own = sum(y * pow(m._STEP, j, 2**64) for j, y in enumerate(piece)) % 2**64
                for _ in range(2):
                    own = (own ^ own >> 32) * m._MIX % 2**64
                out, piece = out + m._ALPHABET[own >> 58] + m._ALPHABET[own >> 52 & 63], []
        parts.append(out)
    return ":".join([str(level), *parts])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] if x == y else 1 + min(old[j], row[-1]))
    return row[-1]


def test_fingerprints_byte_by_byte(monkeypatch):
    rng = random.Random(2)
    texts = ["", "a", "short", "ab" * 700, "x" * 3000, "é漢字 " * 300] + ["".join(rng.choices("abcdefgh \n", k=n)) for n in (6, 7, 8, 64, 500, 3000, 9000)]
    prints = [plain_fingerprint(t) for t in texts]
    assert [op13_piecewise.fingerprint(t) for t in texts] == prints
    monkeypatch.setattr(op13_piecewise, "_BLOCK", 512)
    op13_piecewise._powers.cache_clear()
    assert [op13_piecewise.fingerprint(t) for t in texts] == prints  # blocks change nothing
    op13_piecewise._powers.cache_clear()
    for a in prints:
        for b in prints:
            (i, *x), (j, *y) = a.split(":"), b.split(":")
            both = max(int(i), int(j))
            if a != b and min(int(i), int(j)) + 2 >= both:
                s, t = ([z[k : k + 2] for k in range(0, len(z), 2)] for z in (x[both - int(i)], y[both - int(j)]))
                want = 1 - plain_distance(s, t) / (len(s) + len(t)) if s and t else 0
                assert op13_piecewise.likeness(a, b) == pytest.approx(want)


def plain_compared(rows):
    m = op13_piecewise
    order = sorted(((-(2**63) if i is None else i, i is not None, hashlib.sha256((t or "").encode()).hexdigest(), i, t or "") for i, t in rows))
    out = []
    for at, (_, _, _, i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][4]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = m.fingerprint(text), m.fingerprint(new), m.fingerprint(following)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, m.likeness(a, b), m.likeness(a, c)))
    return sorted(out, key=repr)


def test_compared_over_ranges(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, op13_piecewise.compared(odd).collect()), key=repr) == plain_compared(rows)
    assert op13_piecewise.compared(none).count() == 0
    one = odd.where("doc_id = 7")
    assert op13_piecewise.compared(one).first().near_next == 1.0


def test_compared_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op13_piecewise.query(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == plain_compared([(r.doc_id, r.text) for r in docs.collect()])
    long = [r for r in got if r.n_chars >= 200]
    assert sum(r.near_edited > 0.2 for r in long) > 0.95 * len(long) and sum(r.near_next < 0.2 for r in long) > 0.9 * len(long)


def test_divergence_counts_hold_little():
    texts = [" ".join(f"t{chr(97 + k % 26)}" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(at, at + 2000)) for at in range(0, 1_800_000, 2000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 900, "source": ["s"] * 900, "text": texts})
    plain = pa.default_memory_pool()
    watched = pa.proxy_memory_pool(plain)
    pa.set_memory_pool(watched)
    try:
        rows = sum(b.num_rows for b in op11_divergence.counted(iter([batch])))
    finally:
        pa.set_memory_pool(plain)
    assert rows >= 1_800_001
    assert watched.max_memory() < 48e6, watched.max_memory()
