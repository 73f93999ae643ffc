"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a piece wherever it is -1 modulo the block size 3 * 2^level, so boundaries
follow the content and those of a level are among those of every finer one. The level is the finest at which the
text has at most 64 pieces; the fingerprint is `level:pieces:pieces:pieces` for that level and the two coarser ones,
two base64 characters (12 bits of the piece's hash) a piece, so every byte of every text counts. Fingerprints are
compared at their finest common level by edit distance of pieces, insertions and deletions costing 1:
likeness = 1 - distance / (pieces of both), 0 without a common level.

To meet the next document by id, rows are dealt into ranges of ids whose exact least ids are known beforehand (one
pass over ids alone), sorted within a range, and streamed; the first documents of a range are also sent to the range
before it. Text is shuffled once and one document at a time is held.

Defined results: null text is empty; documents of one id are ordered by the sha256 of their text; a null id comes
first; a repeated row answers each time, and a document alone is its own next one; an empty text has no pieces, is
like another empty one (1) and like nothing else (0); an empty table gives no rows; other columns are ignored. Rows
of one id are streamed by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

WINDOW, PIECES, LEVELS = 7, 64, 3
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in _ALPHABET for b in _ALPHABET]
_BLOCK, _M32, _M64 = 1 << 18, 2**32 - 1, 2**64 - 1
_STEP, _ROLL, _MIX = 0x9E3779B97F4A7C15, 0x01000193, 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 2**64)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@cache
def _powers(x: int) -> np.ndarray:
    """x^0, x^1, ... modulo 2^64, for the places of a block."""
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(_BLOCK, x, np.uint64), dtype=np.uint64)])


def triggers(data: bytes, pieces: int = PIECES) -> tuple[list[tuple[int, int, int]], int]:
    """(end of piece, level, sum of hashes before it) of the boundaries that can matter, in order, and the least level among them.

    Read in blocks; boundaries of levels that have too many of them already are forgotten, so what is held is bounded.
    """
    ends, levels, sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, base, scale = 0, np.uint64(0), 1
    raw = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), _BLOCK):
            part = raw[max(0, at - WINDOW + 1) : at + _BLOCK].astype(np.uint32) + np.uint32(1)
            lead = min(at, WINDOW - 1)
            roll = np.zeros(len(part), np.uint32)
            for j in range(WINDOW):  # a polynomial of the last bytes
                roll[j:] += part[: max(0, len(part) - j)] * np.uint32(pow(_ROLL, j + 1, 2**32))
            roll ^= roll >> np.uint32(15)
            roll = roll[lead:] * np.uint32(0x2C1B3C6D)
            roll ^= roll >> np.uint32(13)
            terms = part[lead:].astype(np.uint64) * _powers(_STEP)[: len(roll)] * np.uint64(scale)
            prefix = base + np.cumsum(terms, dtype=np.uint64)
            roll[roll == np.uint32(_M32)] = 0  # so that adding 1 doesn't wrap
            roll += np.uint32(1)
            hit = np.flatnonzero((roll & np.uint32((1 << least) - 1)) == 0) if least else np.arange(len(roll))
            hit = hit[roll[hit] % np.uint32(3) == 0]
            third = roll[hit] // np.uint32(3)
            level = np.frexp((third & -third).astype(np.float64))[1] - 1  # the power of two in it
            ends, levels, sums = np.concatenate([ends, at + hit + 1]), np.concatenate([levels, level]), np.concatenate([sums, prefix[hit]])
            while np.count_nonzero(levels >= least) > pieces + 1:
                least += 1
            keep = levels >= least
            ends, levels, sums = ends[keep], levels[keep], sums[keep]
            base, scale = prefix[-1], scale * pow(_STEP, len(roll), 2**64) & _M64
    n = len(raw)
    found = list(zip(ends.tolist(), levels.tolist(), sums.tolist()))
    if n and (not found or found[-1][0] != n):
        found.append((n, 99, int(base)))  # the last piece ends with the text, at every level
    elif n:
        found[-1] = (n, 99, found[-1][2])
    return found, least


def fingerprint(text: str) -> str:
    """level:pieces:pieces:pieces of a text."""
    data = text.encode()
    found, level = triggers(data)
    if not found:
        return ":".join([str(level)] + [""] * LEVELS)
    while sum(1 for _, at, _ in found if at >= level) > PIECES:
        level += 1
    ends, levels = np.array([e for e, _, _ in found], np.int64), np.array([at for _, at, _ in found])
    sums = np.array([total for _, _, total in found], np.uint64)
    parts = []
    for step in range(LEVELS):
        keep = levels >= level + step
        starts, totals = np.concatenate([[0], ends[keep][:-1]]), sums[keep]
        with np.errstate(over="ignore"):
            own = totals - np.concatenate([[np.uint64(0)], totals[:-1]])
            own *= _powers(_BACK)[starts % _BLOCK]
            if len(data) > _BLOCK:
                own *= np.array([pow(_BACK, int(i) // _BLOCK * _BLOCK, 2**64) for i in starts], np.uint64)
            for _ in range(2):
                own = (own ^ own >> np.uint64(32)) * np.uint64(_MIX)
        parts.append("".join(_PAIRS[i] for i in (own >> np.uint64(52)).tolist()))
    return ":".join([str(level), *parts])


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 1 - edit distance / pieces of both, at the finest block size they share."""
    if a == b:
        return 1.0
    (i, *x), (j, *y) = a.split(":"), b.split(":")
    level = max(int(i), int(j))
    if level - int(i) >= LEVELS or level - int(j) >= LEVELS:
        return 0.0
    s, t = x[level - int(i)], y[level - int(j)]
    s, t = [s[k : k + 2] for k in range(0, len(s), 2)], [t[k : k + 2] for k in range(0, len(t), 2)]
    return 2 * common(s, t) / (len(s) + len(t)) if s and t else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows bucket, tail, id, text in order -> a result for every row that is not a tail."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting, out, tailed = None, [], None

    def answer(row: tuple, following: tuple) -> None:
        doc_id, text, print_ = row
        new = edited(text, following[1])
        print_new = print_ if new == text else fingerprint(new)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), print_, print_new, likeness(print_, print_new), likeness(print_, following[2])))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            for bucket, tail, doc_id, text in zip(*(rows[c].to_pylist() for c in ("bucket", "tail", "doc_id", "text"))):
                if tail and tailed == bucket:
                    continue  # another document of the id that the next range begins with
                row = (doc_id, text, fingerprint(text))
                if waiting is not None:
                    answer(waiting, row)
                waiting, tailed = (None, bucket) if tail else (row, tailed)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the least id of every range: as many numbers as there are shuffle partitions
    least = sorted(r.low for r in ids.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("low")).collect())
    bounds = np.array(least, np.int64)

    @F.pandas_udf(T.IntegerType())
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(bounds, keys.to_numpy(np.int64), side="right") - 1).astype(np.int32))

    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("own", bucket_of("key"))
    before = F.when(F.col("own") > 0, F.col("own") - 1).otherwise(F.lit(len(least) - 1))
    begins = F.col("key").isin(least) if least else F.lit(False)
    both = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("tail")), F.struct(before.alias("bucket"), F.lit(True).alias("tail")))
    dealt = rows.withColumn("to", F.explode(F.when(begins, both).otherwise(F.slice(both, 1, 1))))
    dealt = dealt.select("to.bucket", "to.tail", "key", "doc_id", F.sha2("text", 256).alias("hash"), "text").repartition("bucket")
    order = dealt.sortWithinPartitions("bucket", "tail", "key", F.col("doc_id").asc_nulls_first(), "hash")
    return order.select("bucket", "tail", "doc_id", "text").mapInArrow(_stream, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))


SQL = None
