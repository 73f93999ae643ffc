"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks and queries into groups of bounded size; each (block, group) tile is
one task's work, so neither side is ever held whole. A tile sorts one list per dimension and reads all
lists from both ends to growing depths. What a list shows is scored against every query still open; a
query is closed when the sum of its weights times the values at the current depth, the most that an
unseen vector could score, is below its k-th score (not equal: an unseen tie may have a smaller id).
The tiles' best are merged by query.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors meet
only those of their own length; rows of the query's own vec_id are no candidates; a repeated query row
answers once; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
Scores must fit 64 bits, the least number excepted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK, GROUP = 16384, 65536


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v array<long> of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < math.inf), F.lit(False)))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the k best columns by score, then id; with rows of ids or one row for all."""
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, ~scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def threshold_topk(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Scores and ids (-1: none) of each query's k best among vectors, and the share of pairs that were scored."""
    n, worst = len(ids), np.iinfo(np.int64).min
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1]) * n < 2**52
    kind = np.float64 if exact else np.int64
    v, q = vectors.astype(kind), queries.astype(kind)
    lists = np.argsort(v, axis=0, kind="stable")  # ascending: read from the end for positive weights
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    got_s, got_i = np.full((len(q), k), worst, np.int64), np.full((len(q), k), -1, np.int64)
    seen, open_, depth, done, scored = np.zeros(n, bool), np.arange(len(q)), 0, 0, 0
    dims = np.arange(v.shape[1])
    while len(open_) and not (seen.all() and done):
        depth = min(n, max(4, 4 * depth))
        shown = np.zeros(n, bool)
        shown[lists[:depth].ravel()] = True
        shown[lists[n - depth :].ravel()] = True
        if depth == n or not v.shape[1]:
            shown[:] = True
        new = np.flatnonzero(shown & ~seen)
        seen |= shown
        done = 1
        for at in range(0, len(open_), 512):
            part = open_[at : at + 512]
            for c in range(0, len(new), 8192):
                cols = new[c : c + 8192]
                s = q[part] @ v[cols].T
                scored += s.size
                lo, hi = np.searchsorted(ids[cols], query_ids[part]), np.searchsorted(ids[cols], query_ids[part], side="right")
                own = [(r, slice(lo[r], hi[r])) for r in np.flatnonzero(hi > lo)]
                top = min(k, len(cols))
                if exact:  # ties: columns are in order of ids
                    key = s * len(cols) - np.arange(len(cols), dtype=kind)
                    for r, at_own in own:
                        key[r, at_own] = -np.inf
                    pick = np.argpartition(-key, top - 1, axis=1)[:, :top]
                else:  # score and place together would not fit 64 bits
                    for r, at_own in own:
                        s[r, at_own] = worst
                    pick = np.argsort(~s, axis=1, kind="stable")[:, :top]
                own_s = np.take_along_axis(s, pick, 1).astype(np.int64)
                none = np.zeros(pick.shape, bool)
                for r, at_own in own:
                    none[r] = (pick[r] >= at_own.start) & (pick[r] < at_own.stop)
                own_s[none] = worst
                own_i = np.where(none, -1, ids[cols][pick])
                got_s[part], got_i[part] = _best(np.concatenate([got_s[part], own_s], 1), np.concatenate([got_i[part], own_i], 1), k)
        if depth < n:
            bound = up[open_] @ v[lists[n - depth], dims] + down[open_] @ v[lists[depth - 1], dims]
            open_ = open_[bound >= got_s[open_, k - 1]]
    return got_s, got_i, scored / max(1, n * len(q))


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each row of queries (both vec_id, v)."""
    sizes = {"block": max(1, math.ceil(vectors.count() / block)), "group": max(1, math.ceil(queries.count() / group))}
    deal = lambda name: F.pmod(F.xxhash64("vec_id", "v", F.lit(name)), F.lit(sizes[name])).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(sizes[name] - 1)))
    c = vectors.select("vec_id", "v", F.size("v").alias("n"), deal("block").alias("block"), every("group").alias("grp"))
    q = queries.distinct().select("vec_id", "v", F.size("v").alias("n"), deal("group").alias("grp")).select("*", every("block").alias("block"))

    def tile(cand: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(cand) or not len(asked):
            return pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []}).astype("int64")
        width = len(cand["v"].iloc[0])
        s, i, _ = threshold_topk(cand["vec_id"].to_numpy(), np.stack(cand["v"].to_list()).reshape(-1, width), asked["vec_id"].to_numpy(), np.stack(asked["v"].to_list()).reshape(-1, width), k)
        keep = i >= 0 if (cand["vec_id"] >= 0).all() else s > np.iinfo(np.int64).min
        rows = np.nonzero(keep)[0]
        return pd.DataFrame({"query_id": asked["vec_id"].to_numpy()[rows], "mark": asked["mark"].to_numpy()[rows], "vec_id": i[keep], "score": s[keep]})

    q = q.withColumn("mark", F.xxhash64("v"))
    best = c.groupBy("n", "grp", "block").cogroup(q.groupBy("n", "grp", "block")).applyInPandas(tile, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantized(table(spark, sf_dir, "embeddings"))
    return topk(v, v.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
