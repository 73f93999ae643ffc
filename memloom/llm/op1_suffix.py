"""Exact substring dedup by blockwise suffix sorting with a difference cover.

Every LENGTH-byte window of the corpus that also starts earlier is removed. Windows are dealt into
suffix buckets by their anchor, the leftmost least GRAM-byte hash inside the window, so equal windows
meet wherever they are. Runs of windows with one anchor form a span.

1. Spans whose whole content also occurs earlier are found by hash and are done: copies cost one row for
   each slice of text, not their bytes.
2. The first occurrences of different spans that share an anchor are the suffixes left to sort. A task
   takes whole buckets up to a bounded size, lays them out with anchors aligned, and ranks the substrings
   at the positions of a difference cover (residues COVER modulo PERIOD) by doubling. Then one column of
   suffixes at a time is sorted: long ties are resolved by the precomputed cover ranks, with the few bytes
   before and behind compared directly.
3. A bucket of more than HOT different spans (the edge of a very common passage) is not gathered: its
   windows are dealt out one by one, by the hash of their content.

Defined results: null text counts as empty; texts shorter than LENGTH lose nothing; repeated rows (same
doc_id and text) are one document and alike; different texts of one doc_id are ordered by their hash; a null
doc_id counts as the least one and stays null in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table

LENGTH, GRAM = 100, 20
STARTS = LENGTH - GRAM + 1
PERIOD, COVER = 7, (0, 1, 3)
HOT = 20_000
BLOCK = 30_000
_SLICE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.uint64
_LEAST = -(1 << 63)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _WORD)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _WORD(31))) * _WORD(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _WORD(29))) * _WORD(0x94D049BB133111EB)
    return x ^ (x >> _WORD(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts (ends: for each byte, where its text ends): the first and last start of each
    run of windows with one anchor, the anchor's place and its gram's hash."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, np.zeros(0, _WORD)
    up, down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, _WORD)
    np.cumsum((data.astype(_WORD) + _WORD(1)) * up[:n], out=sums[1:])
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=_WORD)
    least, width = key, 1
    while width * 2 <= STARTS:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(key) - STARTS + 1], least[STARTS - width : STARTS - width + len(key) - STARTS + 1])
    at = (least & _PLACE).astype(np.int64)
    start = np.arange(len(at))
    live = ends[: len(at)] - start >= LENGTH
    fresh = live & np.concatenate([[True], (at[1:] != at[:-1]) | ~live[:-1]])
    last = live & np.concatenate([(at[1:] != at[:-1]) | ~live[1:], [True]])
    first = np.flatnonzero(fresh)
    return first, np.flatnonzero(last), at[first], gram[at[first]]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, list[bytes], int]]:
    """(row numbers, pieces of texts, and each piece's offset): pieces of one text overlap by LENGTH - 1 bytes."""
    rows, texts, offsets, size = [], [], [], 0
    for r, value in enumerate(batch.column(column)):
        text = value.as_py() or b""
        for at in range(0, max(1, len(text) - LENGTH + 1), _SLICE):
            piece = text[at : at + _SLICE + LENGTH - 1]
            if size + len(piece) > 2 * _SLICE - LENGTH and rows:
                yield np.array(rows), texts, np.array(offsets)
                rows, texts, offsets, size = [], [], [], 0
            rows.append(r)
            texts.append(piece)
            offsets.append(at)
            size += len(piece)
    if rows:
        yield np.array(rows), texts, np.array(offsets)


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, _WORD).view(np.int64)


SPANS = "doc_id long, mark long, h long, s long, start long, lead int, windows int, own boolean"


def _spans(docs: DataFrame) -> DataFrame:
    """A row for each span: its text, gram hash h, content hash s, first start, bytes to the anchor and windows.

    own: the slice has the same span earlier, so it is a repeat already; the least row of a slice stands for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for rows, texts, offsets in _slices(batch, 2):
                joined = b"".join(texts)
                sizes = np.array([len(t) for t in texts])
                bounds = np.cumsum(sizes)
                first, last, at, h = anchors(np.frombuffer(joined, np.uint8), np.repeat(bounds, sizes))
                view = memoryview(joined)
                s = _signed([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())])
                h = h.view(np.int64)
                part = np.searchsorted(bounds, first, side="right")
                start = first - (bounds - sizes)[part] + offsets[part]
                doc, mark = ids[rows[part]], marks[rows[part]]
                order = np.lexsort((start, mark, doc, s, h))
                repeat = np.zeros(len(order), bool)
                same = (h[order][1:] == h[order][:-1]) & (s[order][1:] == s[order][:-1]) & ((doc[order][1:] != doc[order][:-1]) | (mark[order][1:] != mark[order][:-1]) | (start[order][1:] != start[order][:-1]))
                repeat[order[1:]] = same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(mark), pa.array(h), pa.array(s), pa.array(start), pa.array((at - first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(repeat)],
                    ["doc_id", "mark", "h", "s", "start", "lead", "windows", "own"],
                )

    return docs.mapInArrow(run, SPANS)


def sort_block(spans: list[tuple[int, bytes, int, int]]) -> list[tuple[int, int, int]]:
    """spans: (bucket, bytes, bytes before the anchor, windows) in order of their place in the corpus.

    Returns (span, first, last) of the runs of windows that an earlier span of the same bucket also holds.
    """
    if any(len(b) != windows + LENGTH - 1 for _, b, _, windows in spans):
        raise ValueError("a span holds exactly the bytes of its windows")
    m, left = len(spans), STARTS - 1
    width = left + LENGTH
    grid = np.zeros((m, width + 16), np.uint8)
    for r, (_, b, lead, _) in enumerate(spans):
        grid[r, left - lead : left - lead + len(b)] = np.frombuffer(b, np.uint8)
    bucket = np.array([x[0] for x in spans], np.int64)
    bucket = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    words = [np.lib.stride_tricks.sliding_window_view(grid, 8, axis=1)]
    word = lambda c: np.ascontiguousarray(words[0][:, c]).view(">u8")[:, 0].astype(_WORD)
    columns = [c for c in range(width - 15) if c % PERIOD in COVER]

    def ranks(pairs: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
        """Ranks of pairs of keys over all sample positions together."""
        cs = list(pairs)
        hi, lo = np.concatenate([pairs[c][0] for c in cs]), np.concatenate([pairs[c][1] for c in cs])
        order = np.lexsort((lo, hi))
        new = np.concatenate([[0], np.cumsum((hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1]))])
        out = np.empty(len(order), np.int64)
        out[order] = new
        return {c: out[k * m : (k + 1) * m] for k, c in enumerate(cs)}

    rank = ranks({c: (word(c), word(c + 8)) for c in columns})  # of 16 bytes
    for shift in (14, 28, 28):  # of 30, 58 and 86 bytes; the shifts are multiples of PERIOD
        rank = ranks({c: (rank[c].astype(_WORD), rank[c + shift].astype(_WORD)) for c in rank if c + shift in rank})
    low = np.array([left - x[2] for x in spans])
    high = low + np.array([x[3] for x in spans])
    flagged = np.zeros((m, STARTS + 1), np.int8)
    for c in range(STARTS):
        rows = np.flatnonzero((low <= c) & (c < high))
        if len(rows) < 2:
            continue
        lead = next(d for d in range(PERIOD) if (c + d) % PERIOD in COVER)
        tie = bucket[rows] << 40 | rank[c + lead][rows]
        order = np.argsort(tie, kind="stable")
        sorted_tie = tie[order]
        meets = np.concatenate([[False], sorted_tie[1:] == sorted_tie[:-1]])
        meets[:-1] |= meets[1:]
        rows = np.sort(rows[order[meets]])
        if len(rows) < 2:
            continue
        keys = (word(c + 92)[rows], word(c + 84)[rows], word(c)[rows], rank[c + lead][rows], bucket[rows])
        order = np.lexsort(keys)
        same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
        flagged[rows[order[1:][same]], c] = 1
    edge = np.diff(flagged, axis=1, prepend=np.zeros((m, 1), np.int8))
    r, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return list(zip(r.tolist(), (first - low[r]).tolist(), (last - 1 - low[r]).tolist()))


RUNS = "doc_id long, mark long, first long, last long"


def _sorted_buckets(spans: DataFrame) -> DataFrame:
    """Runs of repeated windows (their first and last start) among spans (h, doc_id, mark, start, lead, windows, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda x: (x[1], x[2], x[3]))
            got = sort_block([(x[0], x[6], x[4], x[5]) for x in rows])
            columns = [[rows[r][1] for r, _, _ in got], [rows[r][2] for r, _, _ in got], [rows[r][3] + a for r, a, _ in got], [rows[r][3] + b for r, _, b in got]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "mark", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BLOCK and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return spans.select("h", "doc_id", "mark", "start", "lead", "windows", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, RUNS)


def _dealt_windows(spans: DataFrame) -> DataFrame:
    """The same for hot buckets: each window by itself, a slice's repeats merged before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[tuple[int, int, int], tuple] = {}
            out = []
            for h, doc, mark, start, lead, windows, data in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(windows):
                    key, spot = (h, lead - k, xxhash.xxh3_64_intdigest(data[k : k + LENGTH])), (doc, mark, start + k)
                    old = least.setdefault(key, spot)
                    if spot != old:
                        out.append((*key, *max(spot, old), True))
                        least[key] = min(spot, old)
            out += [(*k, *v, False) for k, v in least.items()]
            c = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(_signed(list(c[2]))), *(pa.array(x, pa.int64()) for x in c[3:6]), pa.array(c[6], pa.bool_())], ["h", "place", "w", "doc_id", "mark", "start", "own"])

    dealt = spans.select("h", "doc_id", "mark", "start", "lead", "windows", "bytes").mapInArrow(run, "h long, place int, w long, doc_id long, mark long, start long, own boolean")
    order = Window.partitionBy("h", "place", "w").orderBy("doc_id", "mark", "start")
    later = dealt.where("NOT own").withColumn("gone", F.rank().over(order) > 1).where("gone").unionByName(dealt.where("own"), allowMissingColumns=True)
    return later.select("doc_id", "mark", F.col("start").alias("first"), F.col("start").alias("last"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least number), mark (0 unless some doc_id repeats: then the text's hash) and the text's bytes."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return ids.select("doc_id", (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("mark"), F.col("text").cast("binary").alias("text"))


def _first_pass(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of windows in repeated spans, and the spans left to sort, with the number of each one's bucket."""
    salt = F.when(F.col("own"), F.xxhash64("doc_id", "start")).otherwise(F.lit(0).cast("long"))
    order = Window.partitionBy("h", "s", "salt").orderBy("doc_id", "mark", "start")
    nth = F.when(F.col("own"), F.lit(2)).otherwise(F.rank().over(order))
    ranked = cut(_spans(texts).withColumn("salt", salt).select("doc_id", "mark", "h", "start", "lead", "windows", nth.alias("nth")))
    firsts = ranked.where("nth = 1").drop("nth")
    shared = firsts.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    left = cut(firsts.join(shared, "h"))
    repeats = ranked.where("nth > 1").selectExpr("doc_id", "mark", "start AS first", "start + windows - 1 AS last")
    return repeats, left


def _with_bytes(texts: DataFrame, left: DataFrame) -> DataFrame:
    """left with each span's bytes, read again from the documents."""
    asked = left.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "start", "lead", "windows", "size")).alias("asked"))
    found = texts.join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "text", F.explode(F.array_distinct("asked")).alias("x"))
    return found.select("doc_id", "mark", "x.*", F.expr(f"substring(text, CAST(x.start + 1 AS INT), x.windows + {LENGTH - 1})").alias("bytes"))


def removals(texts: DataFrame) -> DataFrame:
    """Runs of repeated windows of texts (doc_id, mark, text), by their first and last starts."""
    repeats, left = _first_pass(texts)
    filled = cut(_with_bytes(texts, left).distinct())
    runs = _sorted_buckets(filled.where(F.col("size") <= HOT)).unionByName(_dealt_windows(filled.where(F.col("size") > HOT)))
    runs = cut(repeats.unionByName(runs).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs")))
    discard(left, filled)
    return runs


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedupe(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """Per row of docs: OUT. kept holds the remaining bytes joined, or null if they aren't asked for."""
    texts = _texts(docs)
    runs = removals(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text, kept, at, spans = text.as_py() or b"", [], 0, 0
                for x in found or ():
                    first, end = x["first"], x["last"] + LENGTH
                    if first > at or not spans:
                        kept.append(text[at:first])
                        spans += 1
                    at = max(at, end)
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((None if doc == _LEAST else doc, len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None))
            c = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.join(runs, ["doc_id", "mark"], "left").select("doc_id", "text", "runs").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


SQL = None
