import hashlib
import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import op1_suffix as op


def brute(texts):
    """texts in order of doc_id: (n_bytes, n_removed, n_spans, sha256) of each."""
    seen, out = set(), []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - op.LENGTH + 1):
            w = b[i : i + op.LENGTH]
            if w in seen:
                gone[i : i + op.LENGTH] = b"\1" * op.LENGTH
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = op.dedupe(df).orderBy("doc_id").collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


def corpus(seed, n):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab c") for _ in range(rng.randint(40, 300))) for _ in range(6)]
    return ["".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 120))) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def test_brute_force(spark):
    texts = corpus(1, 40) + ["z" * 700, "z" * 150, "ab" * 300, "", "y" * 99, "y" * 100, "y" * 101]
    assert run(spark, texts) == brute([t.encode() for t in texts])


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT", 2)
    texts = corpus(2, 30)
    assert run(spark, texts) == brute([t.encode() for t in texts])


def test_pieces_of_long_texts(spark, monkeypatch):
    texts = corpus(3, 10)
    texts.append("".join(texts) + "q" * 500 + "".join(texts))
    monkeypatch.setattr(op, "_SLICE", 256)
    data = [t.encode() for t in texts]
    assert run(spark, texts) == brute(data)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=100, max_size=176), min_size=2, max_size=12))
def test_sorted_block_finds_equal_windows(texts):
    """Spans of one bucket with the anchor at a fixed place: every window that an earlier span also has."""
    lead, spans = 10, []
    for t in texts:
        b = t.encode()
        if len(b) >= op.LENGTH + lead:
            windows = min(lead + 1, len(b) - op.LENGTH + 1)
            spans.append((1, b[: windows + op.LENGTH - 1], lead, windows))
    got = {(r, k) for r, a, b in op.sort_block(spans) for k in range(a, b + 1)}
    want = {(r, k) for r, (_, b, _, n) in enumerate(spans) for k in range(n) if any(k < m and c[k : k + op.LENGTH] == b[k : k + op.LENGTH] for _, c, _, m in spans[:r])}
    assert got == want


def test_odd_rows(spark, odd, none):
    assert op.dedupe(none).count() == 0
    rows = op.dedupe(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    assert by[4, 0].n_removed == 0 and by[4, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert next(r for r in rows if r.doc_id == 2).n_removed == next(r for r in rows if r.doc_id == 1).n_bytes


def test_null_and_large_ids(spark):
    """A null id counts as the least; ids above 2^53 stay apart."""
    t, u = "".join(f"word {i} " for i in range(40)), "".join(f"other {i} " for i in range(40))
    rows = spark.createDataFrame([(5, t), (None, t), (2**60 + 1, u), (2**60, u)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in op.dedupe(rows).collect()}
    assert got == {None: (len(t), 0), 5: (len(t), len(t)), 2**60: (len(u), 0), 2**60 + 1: (len(u), len(u))}


def test_a_span_must_hold_its_windows_only():
    with pytest.raises(ValueError):
        op.sort_block([(1, b"a" * 120, 5, 3)])
