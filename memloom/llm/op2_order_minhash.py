"""Near-duplicate documents by Order MinHash.

A document is its sequence of words. Each of its k-word shingles is labelled with its occurrence number; a
sketch takes the L least labelled shingles under a hash and keeps their text order, so that agreement
tells of edit similarity, not only of shared content. Documents of equal word sequences are merged into
one node first. Nodes that share a sketch meet that bucket's least node, and the least
node of the sub-bucket that also shares the next sketch: the one they share most sketches with at once, the others if they are
in different classes after that. Members of a bucket that are in different classes
after that are compared with each other, block by block in Python, so that no two nodes of a bucket are left
both unmatched and uncompared; nothing emits the pairs of a bucket. A candidate pair is verified by banded alignment of the two word sequences (bit-parallel longest common
subsequence; the band is as wide as the limit allows): aligned / (a + b - aligned) >= 0.8. One changed word thus costs
one word, not the five shingles that hold it. Verified links
join nodes into classes.

Defined results: null, empty and wordless texts form one class, that of the empty word sequence, and are
linked to nothing; texts shorter than k words are one shingle; repeated rows
share a class; n_links counts the verified links of a word sequence (pairs that earlier links already put in
one class aren't compared, so it isn't the number of its near-duplicates); a null doc_id counts as the least one
(and is returned as null); an empty table gives no rows; other columns are ignored (classes) or kept (deduplicate).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, light, table
from .graph import components

K, L, SKETCHES = 5, 2, 16
BLOCK = 512
_LEAST = -(1 << 63)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.array([int(x) | 1 for x in np.random.default_rng(11).integers(1 << 62, (1 << 63) - 1, SKETCHES + K + 2)], np.uint64)


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded(ws: list[bytes]) -> np.ndarray:
    """Hashes of the words in text order."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def shingles(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word shingles of coded words in text order; a shorter text is one shingle."""
    if len(h) < k:
        return _mix(np.array([(h * _ODD[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)) if len(h) else h
    return _mix(sum((h[i : len(h) - k + 1 + i] * _ODD[i] for i in range(k)), np.zeros(len(h) - k + 1, np.uint64)))


def sketches(docs: list[np.ndarray]) -> np.ndarray:
    """One row of SKETCHES values for each shingle sequence; all sequences have a shingle at least."""
    sizes = np.array([len(d) for d in docs])
    first, grams = np.cumsum(sizes) - sizes, np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), sizes)
    own = _mix(grams + doc.astype(np.uint64) * _ODD[SKETCHES + K])
    order = np.argsort(own, kind="stable")
    same = np.concatenate([[False], own[order][1:] == own[order][:-1]])
    runs = np.arange(len(own)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))
    nth = np.empty(len(own), np.uint64)
    nth[order] = runs.astype(np.uint64)
    label = _mix(grams + nth * _ODD[SKETCHES + K + 1])
    out = np.empty((len(docs), SKETCHES), np.uint64)
    place = np.arange(len(grams))
    for s in range(SKETCHES):
        y = label * _ODD[s]
        least, spots = [], []
        for _ in range(L):
            low = np.minimum.reduceat(y, first)
            at = np.minimum.reduceat(np.where(y == np.repeat(low, sizes), place, len(grams)), first)
            least.append(label[at])
            spots.append(at)
            y[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        spots, least = np.stack(spots, 1), np.stack(least, 1)
        by_place = np.argsort(spots, axis=1, kind="stable")
        key = np.zeros(len(docs), np.uint64)
        for i in range(L):
            key = _mix(key * _ODD[0] + np.take_along_axis(least, by_place, 1)[:, i])
        out[:, s] = _mix(key + np.uint64(s))
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of a and b over pairs (i, j) with |i - j| <= band, by bit vectors that slide along the band."""
    a, b = a.tolist(), b.tolist()
    spots: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        spots.setdefault(x, []).append(j)
    wide: dict[int, int] = {}
    base, width, done = 0, 2 * band + 2048, 0
    ones = (1 << width) - 1
    v = ones
    for i, x in enumerate(a):
        if i - band - base >= 1024:  # columns left of the band are final
            drop = i - band - base
            done += drop - (v & ((1 << drop) - 1)).bit_count()
            v = (v >> drop) | (((1 << drop) - 1) << (width - drop))
            base += drop
            wide.clear()
        at = spots.get(x)
        if at is None:
            continue
        low, high = max(i - band, base), i + band
        if len(at) <= 4:
            m = 0
            for j in at:
                if low <= j <= high:
                    m |= 1 << (j - base)
        else:
            if x not in wide:
                wide[x] = sum(1 << (j - base) for j in at[bisect_left(at, base) : bisect_left(at, base + width)])
            m = wide[x] & (((1 << (high - low + 1)) - 1) << (low - base))
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return done + width - v.bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """aligned / (a + b - aligned) >= 0.8 for two word sequences."""
    need = -(-4 * (len(a) + len(b)) // 9)
    if not len(a) or not len(b) or need > min(len(a), len(b)):
        return False
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    if sum(min(n, cb[x]) for x, n in ca.items()) < need:
        return False
    return aligned(a, b, max(len(a), len(b)) - need) >= need


def _slices(batch: pa.RecordBatch, columns: tuple[int, ...], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns).tolist() if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        size, end = 0, at
        while end < batch.num_rows and (end == at or size < limit):
            size += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _id() -> Column:
    """doc_id, a null as the least number."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id")


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), node (two hashes of the word sequence), n words, sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, (2,)):
                split = [words(t) for t in part.column(2).to_pylist()]
                node = [xxhash.xxh3_128_intdigest(b" ".join(w)) for w in split]
                coded_ = [coded(w) for w in split]
                grams = [shingles(h) for h in coded_]
                full = [k for k, g in enumerate(grams) if len(g)]
                rows: list = [[] for _ in grams]
                if full:
                    for k, r in zip(full, sketches([grams[k] for k in full]).view(np.int64).tolist()):
                        rows[k] = r
                signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([signed(x >> 64) for x in node], pa.int64()),
                        pa.array([signed(x & ((1 << 64) - 1)) for x in node], pa.int64()),
                        pa.array(map(len, coded_), pa.int64()),
                        pa.array(rows, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "mark", "k1", "k2", "n", "sketch"],
                )

    rows = docs.select(_id(), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, k1 long, k2 long, n long, sketch array<long>")


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for part in _slices(batch, (1, 2)):
                keep = []
                for ta, tb in zip(part.column(1), part.column(2)):
                    if ta != last[0]:
                        last = (ta, coded(words(ta.as_py())))
                    keep.append(similar(last[1], coded(words(tb.as_py()))))
                yield part.select(["pair"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("pair", F.col("ta").cast("binary").alias("ta"), F.col("tb").cast("binary").alias("tb")).mapInArrow(run, pairs.select("pair").schema)


_ID = "struct<doc_id:long,mark:long,k1:long,k2:long>"
_OPEN = f"key long, band long, p long, q long, place int, role int, block long, id {_ID}, label {_ID}, n long, sketch array<long>"
_ARROW = pa.struct([(c, pa.int64()) for c in ("doc_id", "mark", "k1", "k2")])
_GROUP = ["key", "band", "p", "q"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one group after another; the partitions are sorted by _GROUP."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and any(row[c] != rows[0][c] for c in _GROUP):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _uncompared(rows: list[dict]) -> np.ndarray:
    """Pairs of a group that may be similar by length, are of different classes, and share no earlier sketch (where they meet as well)."""
    n, role, block = (np.array([r[c] for r in rows], np.int64) for c in ("n", "role", "block"))
    codes: dict = {}
    label = np.array([codes.setdefault(tuple(r["label"].values()), len(codes)) for r in rows])
    sketch = np.array([r["sketch"] for r in rows], np.int64)
    fits = (label[:, None] != label) & (9 * np.minimum(n[:, None], n) >= 4 * (n[:, None] + n)) & (role[:, None] == 0)
    fits &= (role == 1) | (np.arange(len(n))[:, None] < np.arange(len(n)))
    if rows[0]["p"] != rows[0]["q"]:
        fits &= block[:, None] != block
    for s in range(rows[0]["place"]):
        fits &= sketch[:, s, None] != sketch[:, s]
    return np.argwhere(fits)


def _labelled(grams: np.ndarray) -> np.ndarray:
    """Words marked with their occurrence number: distinct, so that common ones count as a multiset does."""
    order = np.argsort(grams, kind="stable")
    at = np.arange(len(grams))
    first = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    return _mix(grams[order] + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _ODD[SKETCHES + K + 1])


def _similar_pairs(docs: dict[int, np.ndarray], pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those of the pairs (sorted by their first) that are similar; common words are counted against all partners of a document at once."""
    names = sorted(docs)
    sizes = np.array([len(docs[k]) for k in names])
    words_, ids = np.unique(np.concatenate([_labelled(docs[k]) for k in names]), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    place = {k: i for i, k in enumerate(names)}
    own = np.zeros(len(words_), bool)
    for a, partners in ((a, pairs[pairs[:, 0] == a, 1].tolist()) for a in np.unique(pairs[:, 0]).tolist()):
        mine = ids[start[place[a]] : start[place[a]] + sizes[place[a]]]
        own[mine] = True
        for b in partners:
            i, need = place[b], -(-4 * (len(docs[a]) + len(docs[b])) // 9)
            if own[ids[start[i] : start[i] + sizes[i]]].sum() >= need and aligned(docs[a], docs[b], max(len(docs[a]), len(docs[b])) - need) >= need:
                yield a, b
        own[mine] = False


def _groups(member: DataFrame) -> DataFrame:
    """Rows (key, id, label, n and others) of members of buckets, dealt out in groups (_GROUP) in which pairs of different classes meet once.

    Similar texts differ in length by a factor of 1.25 at most, so they lie in one band of lengths (role 0) or in neighbours
    (the longer one's role is 0, the other's 1; two of role 1 meet in their own band). The members of a bucket's band lie in
    blocks of about BLOCK (fewer long ones), by role and by whether they are of its largest class. Two blocks meet only if one
    has role 0 and one isn't of the largest class. So the rows of a bucket of near copies grow with its members and with what
    is left over, not with the square of its members.
    """
    own = F.floor(F.log("n") / F.log(F.lit(1.2501)))
    banded = member.withColumn("at", F.explode(F.array(F.struct(own.alias("band"), F.lit(0).alias("role")), F.struct((own + 1).alias("band"), F.lit(1).alias("role")))))
    banded = banded.select("at.band", "at.role", *member.columns)
    counts = banded.groupBy("key", "band", "label").agg(F.count("*").alias("m"), F.sum("role").alias("m1"))
    top = F.struct("m", "label", "m1")
    counts = counts.groupBy("key", "band").agg(F.max(top).alias("top"), F.sum("m").alias("m"), F.sum("m1").alias("m1")).where("m1 < m AND top.m < m")
    block = F.greatest(F.lit(8.0), F.least(F.lit(float(BLOCK)), 1e6 / F.pow(F.lit(1.25), F.col("band"))))
    left1, left0 = F.col("m1") - F.col("top.m1"), F.col("m") - F.col("top.m") - F.col("m1") + F.col("top.m1")
    sizes = {"l1": left1, "l0": left0, "h0": F.col("top.m") - F.col("top.m1"), "h1": F.col("top.m1")}  # left over or of the largest class, by role
    counts = counts.select("key", "band", F.col("top.label").alias("main"), *[F.ceil(x / block).alias(c) for c, x in sizes.items()])
    spread = banded.join(counts, ["key", "band"]).withColumn("large", F.col("label") == F.col("main"))
    # Blocks are numbered l1, l0, h0, h1, so that those that a block meets are a range.
    ranges = {"l1": ("0", "l1", "l1 + l0 + h0"), "l0": ("l1", "0", "l1 + l0 + h0 + h1"), "h0": ("l1 + l0", "0", "l1 + l0"), "h1": ("l1 + l0 + h0", "l1", "l1 + l0")}
    kind = "CASE WHEN large AND role = 1 THEN {h1} WHEN large THEN {h0} WHEN role = 1 THEN {l1} ELSE {l0} END"
    spread = spread.withColumns({"block": F.expr(kind.format(**{c: f"{x[0]} + pmod(xxhash64(id), {c})" for c, x in ranges.items()})), "from": F.expr(kind.format(**{c: x[1] for c, x in ranges.items()})), "to": F.expr(kind.format(**{c: x[2] for c, x in ranges.items()}))})
    spread = spread.where("from < to").withColumn("other", F.explode(F.expr("sequence(CAST(from AS BIGINT), CAST(to AS BIGINT) - 1)")))
    return spread.select("*", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))


def _rest(nodes: DataFrame, met: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket that its leader left in different classes: all such pairs are compared, in groups.

    met: the members (key, place, id) of sketches' buckets, without their leaders.
    """
    known = nodes.join(components(links), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "n", "sketch")
    member = cut(met.join(known, "id"))
    many = member.groupBy("key").agg(*[f(f"label.{k}").alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("k1", "k2")]).where("min_k1 < max_k1 OR min_k2 < max_k2").select("key")
    spread = _groups(member.join(many, "key", "left_semi")).select(*_GROUP, "place", "role", "block", "id", "label", "n", "sketch")

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            used = np.unique(_uncompared(rows)).tolist() if len(rows) > 1 else []
            if used:
                yield pa.RecordBatch.from_pylist([rows[k] for k in used], schema=pa.schema([(x, {"place": pa.int32(), "role": pa.int32(), "id": _ARROW, "label": _ARROW, "sketch": pa.list_(pa.int64())}.get(x, pa.int64())) for x in rows[0]]))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            pairs = _uncompared(rows)
            if not len(pairs):
                continue
            docs = {k: coded(words(rows[k]["text"])) for k in np.unique(pairs).tolist()}
            found = [{"a": rows[a]["id"], "b": rows[b]["id"]} for a, b in _similar_pairs(docs, pairs)]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("a", _ARROW), ("b", _ARROW)]))

    rest = cut(grouped(spread).mapInArrow(needed, _OPEN))
    full = grouped(rest.join(texts.select("id", F.col("text").cast("binary").alias("text")), "id"))
    return full.mapInArrow(compared, f"a {_ID}, b {_ID}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, k1, k2) and the verified links (a, b) of nodes, a node being (least doc_id, its mark, k1, k2)."""
    rows = cut(_sketched(docs))
    nodes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "mark", "sketch", "n")).alias("x"))
    nodes = cut(nodes.select(F.struct("x.doc_id", "x.mark", "k1", "k2").alias("id"), F.col("x.sketch").alias("sketch"), F.col("x.n").alias("n")))
    keys = F.concat(F.col("sketch"), F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda i: F.xxhash64(F.get("sketch", i), F.get("sketch", (i + 1) % SKETCHES))))
    member = nodes.select("id", F.posexplode(keys).alias("place", "key"))
    leader = member.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1")
    met = cut(member.join(light(cut(leader)), "key").select("key", "place", "id", "a", "size"))
    pairs = cut(met.where("a < id").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared")))
    # each node first meets the leader it shares most with; other leaders only where their classes still differ
    likely = cut(pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("shared"), "a")).alias("a")))
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", "id.doc_id", "id.mark"))
    texts = docs.select(_id(), F.xxhash64("text").alias("mark"), "text").join(light(needed), ["doc_id", "mark"]).select("id", "text")
    texts = cut(texts.dropDuplicates(["id"]))
    check = lambda some: cut(_verified(some.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select(F.struct("a", "b").alias("pair"), "ta", "tb")).select("pair.a", "pair.b"))
    first = check(likely.select("a", "b"))
    label = components(first)
    known = met.join(label, "id", "left").select("key", "a", "id", F.coalesce("label", "id").alias("label"))
    open_ = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")  # buckets of more than one class
    left = known.join(open_, "key", "left_semi").where("a < id").join(label.select(F.col("id").alias("a"), F.col("label").alias("top")), "a", "left")
    apart = left.where(F.col("label") != F.coalesce("top", "a")).select("a", F.col("id").alias("b")).distinct().join(likely, ["a", "b"], "left_anti")
    first = cut(first.unionByName(check(cut(apart.select("a", "b")))))
    return rows, cut(first.unionByName(_rest(nodes, met.where(f"place < {SKETCHES} AND size > 2 AND a <> id").select("key", "place", "id"), first, texts)))


def classes(docs: DataFrame) -> DataFrame:
    """Per row of docs its class, see _classes."""
    return _classes(docs)[1]


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as linked() returns them, and one row per row of docs: doc_id, mark (hash of the text), class_id (least doc_id), n_links of its word sequence, first (the row that stands for its class)."""
    rows, links = linked(docs)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    label = cut(components(links).join(degree, "id").select("id.k1", "id.k2", "label", "n_links"))
    own = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "mark")).alias("own"))
    known = own.join(label, ["k1", "k2"], "left").select("k1", "k2", "own", F.when(F.col("label").isNull(), F.col("own")).otherwise(F.struct("label.doc_id", "label.mark")).alias("top"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    back = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return rows, rows.select("doc_id", "mark", "k1", "k2").join(known, ["k1", "k2"]).select(
        back("doc_id").alias("doc_id"), "mark", back("top.doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), (F.struct("doc_id", "mark") == F.struct("top.doc_id", "top.mark")).alias("first")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The first document of each class, every column as it was."""
    names = docs.columns
    rows, found = _classes(docs)
    spare = cut(found.where("NOT first").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct())
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__mark": F.xxhash64("text")})
    own = light(spare)
    kept = marked.join(own, (marked["__id"].eqNullSafe(own["__id"])) & (marked["__mark"] == own["__mark"]), "left_anti")
    if rows.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():  # rows that repeat an id and its text
        kept = kept.dropDuplicates(["__id", "__mark"])
    return kept.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL = None
