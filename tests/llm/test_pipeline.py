"""The pipeline's stages one by one against brute force on the smallest tables."""

import zlib

import corpus_pipeline as cp
from memloom.llm import op2_order_minhash, op6_toxicity, op9_packing, op10_fm_index
from memloom.llm.common import cut, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = table(spark, SF, "documents")
    names, before = docs.columns, docs.collect()
    out = {}
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF))
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == names
    model = op6_toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert {r.doc_id for r in out["toxicity"]} == {r.doc_id for r in before if model.score(r.text) < op6_toxicity.THRESHOLD}
    seen, kept = [], {}
    for r in sorted(out["toxicity"], key=lambda r: r.doc_id):
        lines = []
        for line in r.text.split("\n"):
            s = {w for w in line.split(" ") if w}
            if not (s and any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen)):
                lines.append(line)
            if s:
                seen.append(s)
        kept[r.doc_id] = "\n".join(lines)
    assert {r.doc_id: r.text for r in out["line_dedup"]} == kept
    grams, stays = [], set()
    for d in sorted(kept):
        w = op2_order_minhash.words(kept[d])
        g = op2_order_minhash.coded(w)
        if not any(w == v or op2_order_minhash.similar(g, h) for v, h in grams):
            stays.add(d)
        grams.append((w, g))
    assert {r.doc_id for r in out["near_dedup"]} == stays
    items = op10_fm_index.Phrases([(str(r.item_id), op10_fm_index.words(r.text)) for r in table(spark, SF, "benchmark").collect()])
    hits = op10_fm_index.search_shard([op10_fm_index.words(kept[d]) for d in sorted(stays)], items)[0]
    clean = {d for d, h in zip(sorted(stays), hits) if not op10_fm_index.judged(h)}
    assert {r.doc_id for r in out["decontamination"]} == clean
    ids = op9_packing._ids_of(op9_packing.default_tokenizer())
    texts = {r.doc_id: r.text for r in out["decontamination"]}
    for r in out["packing"]:
        own = [*ids([texts[r.doc_id].encode()])[0].tolist(), 2]
        assert r.doc_tokens == len(own)
        part = b"".join(int(i).to_bytes(4, "little") for i in own[r.start : r.start + r.length])
        assert zlib.crc32(part) == r.ids_crc32
