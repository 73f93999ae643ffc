import random

import numpy as np

from memloom.llm import op2_order_minhash as op


def classes_of(texts):
    grams = [op.coded(op.words(t)) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if op.words(texts[i]) == op.words(texts[j]) or lcs_similar(grams[i], grams[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(texts))]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def lcs_similar(a, b):
    if not len(a) or not len(b):
        return False
    m = lcs(a.tolist(), b.tolist())
    return 9 * m >= 4 * (len(a) + len(b))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        how = rng.random()
        if how < 0.4:
            out[k] = f"new{rng.randrange(10**6)}"
        elif how < 0.7:
            del out[k]
        else:
            out.insert(k, f"new{rng.randrange(10**6)}")
    return out


def test_classes_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(120, 300))]
        texts += [" ".join(base)] * 2 + [" ".join(edited(rng, base, n)) for n in (1, 2, 3, 30)]
    texts += ["tiny", "tiny", "one two three four five", "one two three four six", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in op.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes_of(texts)


def test_alignment_against_plain_dynamic_programme():
    rng = np.random.default_rng(3)
    for n in (5, 60, 400, 3000):
        a = rng.integers(0, max(3, n // 3), n).astype(np.uint64)
        b = np.delete(np.insert(a, rng.integers(0, n, 3), 7), rng.integers(0, n, 2))
        if n < 1000:
            assert op.aligned(a, b, n + 5) == lcs(a.tolist(), b.tolist())
        assert op.aligned(a, b, 40) <= min(len(a), len(b))
        assert op.similar(a, a)


def test_hot_group_of_variants_is_one_class(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert op.classes(df).select("class_id").distinct().count() == 1
    assert op.deduplicate(df).count() == 1


def test_odd_rows(odd, none):
    assert op.classes(none).count() == 0 and op.deduplicate(none).count() == 0
    rows = op.classes(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.class_id for r in rows}
    assert by[2] == by[3] == 1 and by[5] == 4
    kept = op.deduplicate(odd)
    assert kept.columns == odd.columns
    assert {1, 7, 10}.issubset({r.doc_id for r in kept.collect()}) and not {2, 3} & {r.doc_id for r in kept.collect()}


def test_near_copies_inside_one_template(spark):
    """Copies whose shared sketches nearly all fall in a passage that 60 unlike documents share as well."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(170)]
    own = [[f"d{k}x{i}" for i in range(34)] for k in range(60)]
    texts = [" ".join(passage + w) for w in own]
    for w in own[1:]:
        near = list(w)
        near[rng.randrange(8, 26)] = f"new{rng.randrange(10**6)}"
        near[rng.randrange(8, 26)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(passage + near))
    grams = [op.coded(op.words(t)) for t in texts]
    assert [(i, j) for j in range(len(texts)) for i in range(j) if op.similar(grams[i], grams[j])] == [(k, 59 + k) for k in range(1, 60)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in op.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == [(0, 0)] + [(k, 1) for k in range(1, 60)] * 2


def test_null_ids_keep_their_links(spark):
    base = [f"w{i}" for i in range(200)]
    near = [*base[:100], "new", *base[101:]]
    rows = [(None, " ".join(base)), (4, " ".join(near)), (5, "something else entirely in here")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in op.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: (None, 1), 4: (None, 1), 5: (5, 0)}
    assert {r.doc_id for r in op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {None, 5}


def test_recall_of_edited_copies(spark):
    """Copies with 1, 3, 5 and 8 % of their words edited, among unlike texts of the same words: at least 0.9 share their class."""
    rng = random.Random(33)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, pairs = [], []
    for k in range(120):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        near = edited(rng, base, max(1, len(base) * (1, 3, 5, 8)[k % 4] // 100))
        pairs.append((2 * k, 2 * k + 1))
        texts += [" ".join(base), " ".join(near)]
    got = {r.doc_id: r.class_id for r in op.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[a] in (a, b) and got[b] in (a, b) for a, b in pairs)


def test_left_over_pairs_meet_once_without_a_square(spark):
    """A bucket of one large class and some others: each pair of different classes meets in one group, the large class not in pairs of its blocks."""
    rows = [(7, 0, (i, 0, i, i), (0, 0, 0, 0) if i < 2000 else (i, 0, i, i), 40) for i in range(2012)] + [(8, 0, (i, 0, i, i), (5, 0, 5, 5), 40) for i in range(50)]
    got = op._groups(spark.createDataFrame(rows, f"key long, place int, id {op._ID}, label {op._ID}, n long")).where("key = 7").collect()
    blocks = -(-2000 // op.BLOCK)
    assert len(got) == 2000 + 12 * (blocks + 1)  # 2012 * 8 when every block met every block
    groups, met = {}, []
    for r in got:
        groups.setdefault((r.band, r.p, r.q), []).append(r)
    for (_, p, q), members in groups.items():
        met += [frozenset((x.id.doc_id, y.id.doc_id)) for i, x in enumerate(members) for y in members[:i] if x.label != y.label and (p == q or x.block != y.block) and 0 in (x.role, y.role)]
    want = {frozenset((a, b)) for a in range(2000, 2012) for b in range(2012) if a != b}
    assert set(met) == want and len(met) == len(want)


def test_shorter_texts_of_a_band_meet_the_longer_ones_only(spark):
    """1200 unlike texts and one of the next band of lengths: there, the 1200 are not dealt out in pairs of their blocks again."""
    n = [40] * 1200 + [48]
    band = [int(np.floor(np.log(x) / np.log(1.2501))) for x in n]
    assert band[-1] == band[0] + 1
    rows = [(7, 0, (i, 0, i, i), (i, 0, i, i), x) for i, x in enumerate(n)]
    got = op._groups(spark.createDataFrame(rows, f"key long, place int, id {op._ID}, label {op._ID}, n long")).where(f"band = {band[-1]}").collect()
    assert len(got) <= 1200 + 1 + -(-1200 // op.BLOCK)  # some 1200 * 5 when every block met every block
    met = {(x.p, x.q) for x in got if x.id.doc_id == 1200}
    assert all((x.p, x.q) in met for x in got)
    assert len({x.id.doc_id for x in got}) == 1201
