"""Benchmark decontamination by an FM-index of each training shard.

A shard is one Arrow batch of documents. Its words are coded over the alphabet of the benchmark's own
words; any other word cannot lie in a phrase, so it separates runs, and runs shorter than the shortest
phrase are left out. The rest is indexed whole: suffix array (prefix doubling), Burrows-Wheeler
transform in a wavelet matrix, suffix positions sampled every SAMPLE places and at each run's start.
All phrases are searched backwards at once; occurrences are located through the samples and merged into
removal spans. Nothing is shuffled: a shard answers for its own documents.

Defined results: null or wordless text gives zero counts, the hash of the empty string and
contaminated = false; an item without words has no phrase, one without item_id takes no part; repeated doc_ids or item_ids are judged row
by row (items of the same id count once); other columns are ignored by `contamination` and kept by
`decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 13
SAMPLE = 16
#: Benchmark text held by a task at a time; a larger benchmark is searched in several pieces of this size.
PIECE_BYTES = 32 << 20

# Words: ASCII digits, letters and every byte of a non-ASCII character; A-Z in lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,length:long>>"


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of any symbol in any prefix of a sequence, vectorised over queries."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(np.int32)
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(place), place
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, right = self.ones[level], ((symbol >> b) & 1).astype(bool)
            lo, hi = ones[low], ones[high]
            low = np.where(right, self.zeros[level] + lo, low - lo)
            high = np.where(right, self.zeros[level] + hi, high - hi)
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. Separators (0) differ from each other by place, so no comparison runs past one."""
    n, seps = len(text), np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(seps)
    rank[seps] = np.arange(len(seps))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:] if step < n else nxt[:0]
        key = rank * (n + len(seps) + int(text.max(initial=0)) + 2) + nxt + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """text: symbols 0 to symbols-1, where 0 ends each run (the last symbol is 0)."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        sa = suffix_array(text)
        self.n, self.bwt = len(text), text[sa - 1]
        self.tree = WaveletMatrix(self.bwt, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        kept = (sa % sample == 0) | (text[sa - 1] == 0)
        self.kept = np.where(kept, np.cumsum(kept) - 1, -1)
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of phrases, all of one length."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(high > low)
            if not len(live):
                break
            c = phrases[live, k]
            low[live], high[live] = self.before[c] + self.tree.rank(c, low[live]), self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            slot = self.kept[rows[todo]]
            done = slot >= 0
            out[todo[done]] = self.samples[slot[done]] + steps[todo[done]]
            todo = todo[~done]
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
        return out


class Phrases:
    """The windows of some benchmark items: distinct phrases by length, and the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.ids = sorted({i for i, w in items if w})
        place = {x: k for k, x in enumerate(self.ids)}
        self.code: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, ws in items:
            coded = [self.code.setdefault(w, len(self.code) + 1) for w in ws]
            for k in range(max(1, len(coded) - WINDOW + 1) if coded else 0):
                found.setdefault(tuple(coded[k : k + WINDOW]), set()).add(place[item])
        self.groups = []
        for length in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == length]
            holders = [sorted(found[p]) for p in own]
            starts = np.concatenate([[0], np.cumsum([len(h) for h in holders])]).astype(np.int64)
            self.groups.append((length, np.array(own, np.int64), starts, np.array([x for h in holders for x in h], np.int64)))
        self.shortest = min((g[0] for g in self.groups), default=0)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def search_shard(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[np.ndarray], list[list[str]]]:
    """For each document: which words are hit, and the items with occurring windows."""
    sizes = np.array([len(d) for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    get, flat = phrases.code.get, np.zeros(int(first[-1]), np.int32)
    for d, at in zip(docs, first):
        flat[at : at + len(d)] = np.fromiter((get(w, 0) for w in d), np.int32, len(d))
    cover = np.zeros(len(flat) + 1, np.int32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    if phrases.groups and len(flat):
        edge = np.diff(np.concatenate([[0], (flat > 0).view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= phrases.shortest
        begin, end = begin[long], end[long]
        if len(begin):
            place = _ranges(begin, end - begin + 1)  # each run with the separator behind it
            text = np.where(place < len(flat), flat[np.minimum(place, len(flat) - 1)], 0).astype(np.int64)
            text[np.cumsum(end - begin + 1) - 1] = 0
            index = FMIndex(text, len(phrases.code) + 1)
            for length, rows, starts, holders in phrases.groups:
                low, high = index.search(rows)
                hits = np.flatnonzero(high > low)
                counts = high[hits] - low[hits]
                at = place[index.locate(_ranges(low[hits], counts))]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                doc = np.searchsorted(first, at, side="right") - 1
                pair = np.unique(np.stack([doc, np.repeat(hits, counts)]), axis=1)
                n = starts[pair[1] + 1] - starts[pair[1]]
                held.append((np.repeat(pair[0], n), holders[_ranges(starts[pair[1]], n)]))
    hit = np.cumsum(cover[:-1]) > 0
    items: list[list[str]] = [[] for _ in docs]
    if held:
        for d, i in np.unique(np.stack([np.concatenate(x) for x in zip(*held)]), axis=1).T:
            items[d].append(phrases.ids[i])
    return [hit[at : at + n] for at, n in zip(first, sizes)], items


def _pieces(benchmark: DataFrame) -> list[Phrases]:
    """The benchmark in pieces of bounded size; rows come to the driver one partition at a time."""
    out, items, size = [], [], 0
    for item, text in benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        items.append((item, words(text)))
        size += len(text or "")
        if size >= PIECE_BYTES:
            out, items, size = [*out, Phrases(items)], [], 0
    return [*out, Phrases(items)] if items or not out else out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): SCHEMA, where spans are the maximal runs of hit words."""
    context = docs.sparkSession.sparkContext
    held = [context.broadcast(p) for p in _pieces(benchmark)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                coded = [words(t) for t in part.column(1).to_pylist()]
                hits = [np.zeros(len(d), bool) for d in coded]
                items: list[set[str]] = [set() for _ in coded]
                for piece in held:
                    got, own = search_shard(coded, piece.value)
                    for k in range(len(coded)):
                        hits[k] |= got[k]
                        items[k].update(own[k])
                yield _rows(part.column(0).to_pylist(), hits, [sorted(x) for x in items])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(judge, SCHEMA)


def judged(hit: np.ndarray) -> bool:
    n = int(hit.sum())
    return n > 0 and 20 * n >= len(hit)


def _slices(batch: pa.RecordBatch, column: int = 1, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Shards of about `limit` bytes of text, whole documents each."""
    at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    while at < batch.num_rows:
        size, end = 0, at
        while end < batch.num_rows and (end == at or size < limit):
            size += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _rows(ids: list, hits: list[np.ndarray], items: list[list[str]]) -> pa.RecordBatch:
    n_hit = [int(h.sum()) for h in hits]
    spans = []
    for h, n in zip(hits, n_hit):
        if n:
            edge = np.diff(np.concatenate([[0], h.view(np.int8), [0]]))
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
        else:
            spans.append([])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(h) for h in hits], pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            pa.array([judged(h) for h in hits], pa.bool_()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without its contaminated rows, every column as it was. The text travels with the verdict, so nothing is joined."""
    names = docs.columns
    context = docs.sparkSession.sparkContext
    held = [context.broadcast(p) for p in _pieces(benchmark)]
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                coded = [words(t) for t in part.column(at).to_pylist()]
                hits = [np.zeros(len(d), bool) for d in coded]
                for piece in held:
                    for mine, got in zip(hits, search_shard(coded, piece.value)[0]):
                        mine |= got
                yield part.filter(pa.array([not judged(h) for h in hits]))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("spans")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, least(len(w), 13) AS size, unnest([array_to_string(w[k : k + least(len(w), 13) - 1], ' ') FOR k IN range(1, greatest(len(w) - 11, 2))]) AS phrase FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, sizes WHERE len(w) >= size),
x AS (SELECT g.doc_id, g.k, g.size, p.item_id FROM g JOIN p ON p.size = g.size AND p.phrase = array_to_string(g.w[g.k : g.k + g.size - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM x) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM x) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
