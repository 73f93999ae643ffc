"""op5, op6, op8, op9 and op10: brute force, round trips, held-out accuracy, odd rows."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from memloom.llm import op5_wrapper, op6_toxicity, op8_topk, op9_packing, op10_fm_index

SF = "/root/testdata/sf0.001"


def test_article_text_and_noise():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div>"
        "<article><h1>Head &amp; more</h1><p><b>First<br>line<p>Second   line&nbsp;x<script>var t='</p>'</script><ul><li>a<li>b</ul><aside>Side</aside><div class=\"comment-list\">nice post</div>"
        "<p>1 < 2 &lt; 3</article><footer>&copy; foot</footer>"
    )
    assert op5_wrapper.main_text(page) == "Head & more\nFirst line\nSecond line x\na\nb\n1 < 2 < 3"
    assert op5_wrapper.main_text(None) == op5_wrapper.main_text("") == ""


SITE = "<body><div class=top>Site</div><div id=w><div class=side>Links</div><div class=c><h2>Head {k}</h2><p>Body {k} of page {k}</p><p>Shared words</p></div></div><div>All rights</div></body>"


def test_wrapper_of_a_host_without_article(spark):
    """Template goes because the host's pages agree on it; without other pages nothing can be told apart."""
    pages = [(k, f"http://{'one' if k < 9 else 'lone'}.org/{k}", SITE.format(k=k).replace("<p>Shared words</p>", "<p>Shared words</p>" if k < 3 else "")) for k in range(10)]
    got = {r.page_id: r.text for r in op5_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[5] == "Head 5\nBody 5 of page 5" and got[2] == "Head 2\nBody 2 of page 2\nShared words"
    assert got[9].startswith("Site\n") and "Body 9 of page 9" in got[9]


def test_hot_host_is_dealt_out(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "http://one.org/", SITE.format(k=k)) for k in range(40)], "page_id long, url string, html string")
    plain = sorted(op5_wrapper.extract(pages).collect())
    monkeypatch.setattr(op5_wrapper, "SPLIT", 4)
    assert sorted(op5_wrapper.extract(pages).collect()) == plain and len(plain) == 40


def test_deep_nesting_keeps_text_in_order():
    assert op5_wrapper.main_text("<div>a" * 5000 + "</div>b" * 5000) == "\n".join(["a"] * 5000 + ["b"] * 5000)
    assert op5_wrapper.main_text("<article>" + "<div>" * 3000 + "<p>x</p><nav>menu</nav><p>y</p>") == "x\ny"


def test_tree_match_is_a_largest_match():
    tree = lambda html: op5_wrapper._tree(op5_wrapper.parse(html))[0]
    a, b = tree("<div><p>1</p><section><p>2</p></section><p>3</p></div>"), tree("<div><section><p>x</p><p>y</p></section><p>z</p></div>")
    assert len(op5_wrapper.tree_match(a, b)) == 5 and len(op5_wrapper.tree_match(a, a)) == a[1]


def test_pages_odd_rows(spark):
    rows = [(1, "http://a/x", "<p>one</p>"), (1, "http://a/x", "<p>one</p>"), (2, None, None), (3, "", ""), (4, "http://a/y", "<article>" + "<p>x</p>" * 5000)]
    df = spark.createDataFrame([(*r, "h", "l") for r in rows], "page_id long, url string, html string, host string, low string")
    got = op5_wrapper.extract(df).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id in (2, 3)} == {0}
    assert next(r for r in got if r.page_id == 4).text.count("x") == 5000
    assert op5_wrapper.extract(df.limit(0)).count() == 0


def test_toxicity_catches_misspellings_it_never_saw():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    bad = ["idiot", "worthless", "pathetic", "disgusting"]

    def doc(words):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 200))]
        for x in words:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w)

    texts = [doc(rng.sample(bad, 2)) for _ in range(150)] + [doc([]) for _ in range(450)]
    model = op6_toxicity.fit(texts, [1] * 150 + [0] * 450)
    odd = [doc([b[:-1] + b[-1] * 2, b + "s"]) for b in bad for _ in range(10)]
    clean = [doc([]) for _ in range(200)]
    assert np.mean([model.score(t) >= op6_toxicity.THRESHOLD for t in odd]) > 0.9
    assert np.mean([model.score(t) >= op6_toxicity.THRESHOLD for t in clean]) < 0.05
    assert model.score(None) == model.score("") == model.score("...") == 0.0


def test_toxicity_query_and_held_out(spark, odd, none):
    rows = op6_toxicity.query(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    model = op6_toxicity.train(odd, labels)
    assert op6_toxicity.score(odd, model).count() == odd.count()
    assert op6_toxicity.accepted(odd, model).columns == odd.columns
    assert op6_toxicity.score(none, op6_toxicity.train(none, labels.limit(0))).count() == 0


@pytest.mark.parametrize("block,group", [(10**6, 10**6), (40, 7)])
def test_topk_against_brute_force(spark, block, group):
    rng = np.random.default_rng(1)
    vecs = rng.normal(0, 0.2, (220, 6))
    vecs[50:120] = vecs[3]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 6), (1050, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "v") for r in rows], "vec_id long, embedding array<double>, v string")
    v = op8_topk.quantized(df)
    got = sorted(map(tuple, op8_topk.topk(v, v.where("vec_id % 50 = 0"), 5, block, group).collect()))
    q = np.floor(256 * vecs).astype(int)
    want = []
    for i in range(0, 220, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(220) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_topk_of_large_components_and_of_nothing(spark):
    """Scores near 2^59 keep their order."""
    rng = np.random.default_rng(5)
    vecs = np.round(rng.normal(0, 3e5, (300, 64)), 3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    v = op8_topk.quantized(df)
    q = np.floor(256 * vecs).astype(np.int64).tolist()
    got = sorted(map(tuple, op8_topk.topk(v, v.where("vec_id % 50 = 0"), 5, 100, 3).collect()))
    want = []
    for i in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(300) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want
    assert op8_topk.topk(v.limit(0), v.limit(0)).count() == 0


def test_threshold_algorithm_stops_early():
    ids = np.arange(4000)
    vecs = np.zeros((4000, 3), np.int64)
    vecs[:, 0] = ids[::-1]
    s, i, share = op8_topk.threshold_topk(ids, vecs, np.array([-1]), np.array([[2, 1, 0]]), 5)
    assert i.tolist() == [[0, 1, 2, 3, 4]] and share < 0.2


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    path = op9_packing.default_tokenizer()
    model, own = Tokenizer.from_file(path), op9_packing._ids_of(path)
    for t in ["", "It's I'LL “quoted”, naïve İstanbul x́y \x1c <|ENDOFTEXT|> 12ab ½ 漢字, é 한", "thre### (THE)&&& Ünï!", "a b　c\x85e"]:
        assert own([t.encode()])[0].tolist() == model.encode(t, add_special_tokens=False).ids
    assert op9_packing.pack(none, path).count() == 0
    for kwargs in ({}, {"max_segments": 3, "max_loss": 2000, "open_bins": 2}):
        rows = op9_packing.pack(odd.where("doc_id IS NOT NULL AND doc_id NOT IN (5, 8)"), path, **kwargs).collect()
        texts = {r.doc_id: r.text for r in odd.collect()}
        for doc in {r.doc_id for r in rows}:
            ids = np.array([*model.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        seqs = {}
        for r in rows:
            seqs.setdefault(r.sequence_id, []).append(r)
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 4096
            if kwargs:
                assert len(s) <= 3 and sum(r.loss_tokens for r in s) <= 2000
            else:
                n = sum(r.length for r in s)
                assert n & (n - 1) == 0


def test_turns_under_three_limits(spark):
    rows = [(c, k, ("user", "assistant", None)[k % 3], "some words of a turn " * (1 + 37 * c % 50)) for c in range(60) for k in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    seqs = {}
    for r in op9_packing.pack_turns(turns, op9_packing.default_tokenizer(), max_segments=5, max_loss=700).collect():
        seqs.setdefault(r.sequence_id, []).append(r)
    assert all(len(s) <= 5 and sum(r.loss_tokens for r in s) <= 700 and sum(r.length for r in s) <= 4096 for s in seqs.values())
    assert any(r.loss_tokens == r.length for s in seqs.values() for r in s) and any(r.loss_tokens == 0 for s in seqs.values() for r in s)
    assert max(sum(r.length for r in s) for s in seqs.values()) > 700


def brute_hits(words, items):
    hit, found = [False] * len(words), set()
    for i, w in items:
        n = min(len(w), op10_fm_index.WINDOW)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit[at : at + n] = [True] * n
                    found.add(i)
    return hit, sorted(found)


def test_fm_index_against_brute_force():
    rng = random.Random(4)
    vocab = [b"a", b"b", b"c", b"the", b"zz"]
    items = [(str(i), [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 13, 20]))]) for i in range(12)]
    docs = []
    for _ in range(25):
        d = [rng.choice([*vocab, b"other"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            d += rng.choice(items)[1]
        docs.append(d)
    got, found = op10_fm_index.search_shard(docs, op10_fm_index.Phrases(items))
    for d, h, f in zip(docs, got, found):
        assert (h.tolist(), f) == brute_hits(d, items)


def test_benchmark_in_pieces_and_odd_rows(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, None), (3, "..."), (4, "short text here"), (5, "Word0 WORD1 word2")], "item_id long, text string")
    plain = sorted(map(str, op10_fm_index.contamination(odd, bench).collect()))
    monkeypatch.setattr(op10_fm_index, "PIECE_BYTES", 10)
    assert plain == sorted(map(str, op10_fm_index.contamination(odd, bench).collect()))
    by = {(r.doc_id, r.n_words): r for r in op10_fm_index.contamination(odd, bench).collect()}
    assert by[8, 3].contaminated and by[8, 3].n_hit == 3 and not by[1, 300].contaminated and by[1, 300].n_hit == 3
    assert by[4, 0].n_hit == 0 and not by[4, 0].contaminated
    kept = op10_fm_index.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert op10_fm_index.contamination(none, bench).count() == 0 and op10_fm_index.contamination(odd, bench.limit(0)).count() == odd.count()


def test_text_beside_the_heaviest_block_stays():
    tail = "<body><div id=w><div class=b><p>" + "long text " * 50 + "</p></div><div class=tail><p>last paragraph</p></div></div>"
    assert op5_wrapper.main_text(tail).endswith("\nlast paragraph")
    two = "<body><article><p>" + "a b c " * 40 + "</p></article><article><p>short one</p></article>"
    assert op5_wrapper.main_text(two).endswith("\nshort one")


def test_names_count_whole():
    page = "<article><p>x</p>" + "".join(f"<div class='{c}'>{c}</div>" for c in ("share-price", "related-work", "social-history", "banner-image", "share-buttons", "comment-list", "ad-slot-3", "site_footer")) + "</article>"
    assert op5_wrapper.main_text(page) == "x\nshare-price\nrelated-work\nsocial-history\nbanner-image"


def test_headings_of_articles_stay_on_every_page(spark):
    rows = [(k, "http://one.org/", f"<body><div class=top>Site</div><article><h2>Summary</h2><p>Body {k} of page {k}</p></article></body>") for k in range(10)]
    got = op5_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Summary\nBody {k} of page {k}" for k in range(10)}


@pytest.mark.parametrize("piece", ["<div>", "</b>", '<a "x ', "<a 'x \" ", "<svg>", "<![CDATA[", "<", "<!", "<p></x>", "<title>"])
def test_odd_pages_are_parsed_in_linear_time(piece):
    import time

    start = time.perf_counter()
    op5_wrapper.main_text("<div>" * 4000 + piece * (300_000 // len(piece)))
    assert time.perf_counter() - start < 20


def plain_match(a, b):
    """Size of a largest match of two signatures, by plain recursion."""
    if a[0] != b[0]:
        return 0

    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), plain_match(x[0], y[0]) + lists(x[1:], y[1:]))

    return 1 + lists(a[2], b[2])


def test_tree_match_against_plain_recursion():
    rng = random.Random(60)

    def grow(depth):
        kids = tuple(grow(depth - 1) for _ in range(rng.randrange(4))) if depth else ()
        return ((rng.choice("ab"), ""), 1 + sum(k[1] for k in kids), kids)

    for _ in range(200):
        a, b = (((("r", ""), 1 + sum(k[1] for k in kids), kids)) for kids in (tuple(grow(2) for _ in range(3)) for _ in range(2)))
        assert len(op5_wrapper.tree_match(a, b)) == plain_match(a, b)


def test_words_by_the_model_alone_have_the_tokenizer_s_ids():
    ids = op9_packing.PieceIds(op9_packing.default_tokenizer())
    assert ids.direct
    words = ["the", "Upper", "éàß", "éa", "ﬁn", "ǆ", "ǅ", "ʰa", "ночь", "漢字", "한글", "ªº", "σς", "İ", "ı", "it's", "a1", "7", "...", "x" * 300, "ñ" * 200, "ẛ̣", "Ω", "𝒜b", "𐐨"]
    asked: list[str] = []
    whole = ids._encoded
    ids._encoded = lambda new: asked.extend(new) or whole(new)
    got = [x.tolist() for x in ids([w.encode() for w in words])]
    assert got == whole(words)
    assert not {"the", "éàß", "ночь", "漢字"} & set(asked) and "éa" in asked


def test_toxicity_fit_holds_blocks():
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 2000, 1000)) for _ in range(600)]
    tracemalloc.start()
    try:
        model = op6_toxicity.fit(texts, [k % 2 for k in range(600)], rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weight.any()
    assert peak < 24e6, peak  # 12 bytes a word are kept; 600000 words
