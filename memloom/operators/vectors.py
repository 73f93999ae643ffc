"""Vector operators: cosine, centroids, nearest neighbours, softmax attention, assignment to centroids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.shared import cut


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; 0 for null vectors, zero norms and unequal lengths."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def finite(v: str) -> Column:
    return F.col(v).isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)))


def centroid(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, centroid, n): element-wise mean of the finite vectors of each key. One row per key and dimension is shuffled after a partial sum."""
    rows = df.where(finite(vec)).select(key, F.posexplode(vec).alias("pos", "x"))
    means = rows.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))


def unit_rows(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_list()).astype(float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def spanning_links(vectors: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """Links (a, b) with the components of all pairs of vectors (id, vec) of cosine >= threshold; cosines are rounded to 6 places.

    Each task compares all pairs of two blocks and returns a forest that connects what they connect, so no
    pair is left out and the links of a pair of blocks are fewer than its vectors.
    """
    n = max(1, math.ceil(vectors.count() / block))
    own = vectors.where(finite("vec")).select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})

    def forest(g: pd.DataFrame) -> pd.DataFrame:
        ids, u = g["id"].to_numpy(), unit_rows(g["vec"])
        left, links = np.arange(len(ids)), []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                k = todo.pop()
                hit = np.round(u[left] @ u[k], 6) >= threshold
                found, left = left[hit], left[~hit]
                links += [(ids[k], ids[j]) for j in found if ids[k] != ids[j]]
                todo += found.tolist()
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("p", "q").applyInPandas(forest, "a long, b long")


def dealt(candidates: DataFrame, queries: DataFrame, block: int, within: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tile (within, b, g) each row belongs to: every block of candidates meets every block of queries, of the same group only."""
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))  # noqa: E731  # of one type on both sides, as int 0 and long 0 go to different tasks
    if within is None:
        c, q = candidates.withColumn("grp", F.lit(0)), queries.withColumn("grp", F.lit(0))
        nb, ng = (F.lit(max(1, math.ceil(x.count() / block))) for x in (candidates, queries))
        c, q = c.withColumns({"nb": nb, "ng": ng}), q.withColumns({"nb": nb, "ng": ng})
    else:
        c, q = (x.withColumn("grp", F.col(within).alias("grp")) for x in (candidates, queries))
        size = lambda x, n: x.groupBy("grp").agg(F.ceil(F.count("*") / block).alias(n))
        sizes = size(c, "nb").join(size(q, "ng"), "grp")
        c, q = c.join(sizes, "grp"), q.join(sizes, "grp")
    c = c.where(finite("vec")).select("id", "vec", "grp", deal("id", F.col("nb")).alias("b"), every(F.col("ng")).alias("g"))
    q = q.where(finite("vec")).select("qid", F.col("vec").alias("qvec"), "grp", deal("qid", F.col("ng")).alias("g"), every(F.col("nb")).alias("b"))
    return c, q


def nearest(candidates: DataFrame, queries: DataFrame, k: int | None, threshold: float = -1.0, block: int = 4096, order: str = "best", among: str = "all", within: str | None = None, places: int | None = 6) -> DataFrame:
    """(qid, id, sim, rank): the first k candidates (id, vec) of each query (qid, vec) with a cosine >= threshold, exactly.

    order: "best" (by cosine, ties by id), "first" (by id) or "last" (by id, downwards); k None: all of them.
    among: "all" candidates, the "other" ones (id <> qid) or the "earlier" ones (id < qid); within: only candidates
    with the same value in that column (null: none).
    Cosines are rounded to `places` (None: as they are). Both sides are dealt into blocks; a task multiplies one block of
    each, so neither side is collected or broadcast, and a hot group is spread over its pairs of blocks.
    """
    c, q = dealt(candidates, queries, block, within)

    def tile(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        x = x.sort_values("id", ascending=order != "last")
        ids, qids = x["id"].to_numpy(), y["qid"].to_numpy()
        sims = unit_rows(y["qvec"]) @ unit_rows(x["vec"]).T
        sims = sims if places is None else np.round(sims, places)
        good = sims >= threshold
        if among != "all":
            good &= ids[None, :] < qids[:, None] if among == "earlier" else ids[None, :] != qids[:, None]
        if k is None:
            r, j = np.nonzero(good)
        else:
            cost = np.where(good, -sims if order == "best" else 0.0, np.inf)
            top = np.argsort(cost, axis=1, kind="stable")[:, :k]
            r, at = np.nonzero(np.take_along_axis(good, top, 1))
            j = top[r, at]
        return pd.DataFrame({"qid": qids[r], "id": ids[j], "sim": sims[r, j]})

    found = c.groupBy("grp", "b", "g").cogroup(q.groupBy("grp", "b", "g")).applyInPandas(tile, "qid long, id long, sim double")
    if k is None:
        return found
    by = {"best": [F.desc("sim"), F.col("id")], "first": [F.col("id")], "last": [F.desc("id")]}[order]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col("rank") <= k)


def similarity_counts(vectors: DataFrame, edges: list[float], block: int = 4096) -> DataFrame:
    """(bucket, n): how many pairs of vectors (id, vec) have a cosine, rounded to 6 places, in each bucket; bucket i holds edges[i - 1] <= cosine < edges[i].

    Each task counts the pairs of two blocks, so a task returns len(edges) + 1 rows at most.
    """
    n = max(1, math.ceil(vectors.count() / block))
    own = vectors.where(finite("vec")).select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("own"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})

    def count(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        u = unit_rows(g["vec"])
        side = g["own"].to_numpy()
        sims = np.round(u @ u.T, 6)[np.triu_indices(len(g), 1)] if p == q else np.round(u[side == p] @ u[side == q].T, 6).ravel()
        bucket, times = np.unique(np.searchsorted(edges, sims, side="right"), return_counts=True)
        return pd.DataFrame({"bucket": bucket, "n": times})

    return dealt.groupBy("p", "q").applyInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def attend(vectors: DataFrame, within: str, keep: int = 5, block: int = 4096) -> DataFrame:
    """(query, id, soft): softmax attention of each vector (id, vec) to the others of its group, scores dot / sqrt(dimension) rounded to 6 places.

    Kept are shares of at least a tenth of the mean share with a positive score, the `keep` best, ties by id.
    A task returns its blocks' best rows and, per query, the count, greatest score and sum that make up the
    softmax; no group is gathered.
    """
    c, q = dealt(vectors, vectors.select(F.col("id").alias("qid"), "vec", within), block, within)

    def tile(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame(columns=["qid", "id", "raw", "n", "most", "total"])
        x = x.sort_values("id")
        ids, qids = x["id"].to_numpy(), y["qid"].to_numpy()
        a, b = (np.stack(v.to_list()).astype(float) for v in (y["qvec"], x["vec"]))
        raw = np.where(ids[None, :] == qids[:, None], -np.inf, np.round(a @ b.T / math.sqrt(a.shape[1]), 6))
        most = raw.max(axis=1)
        some = np.isfinite(most)
        sums = pd.DataFrame({"qid": qids[some], "id": None, "raw": None, "n": np.isfinite(raw[some]).sum(1), "most": most[some], "total": np.exp(raw[some] - most[some, None]).sum(1)})
        top = np.argsort(-raw, axis=1, kind="stable")[:, :keep]
        r, at = np.nonzero(np.take_along_axis(raw, top, 1) > 0)
        best = pd.DataFrame({"qid": qids[r], "id": ids[top[r, at]], "raw": raw[r, top[r, at]], "n": None, "most": None, "total": None})
        return pd.concat([sums.astype(object), best.astype(object)])

    out = cut(c.groupBy("grp", "b", "g").cogroup(q.groupBy("grp", "b", "g")).applyInPandas(tile, "qid long, id long, raw double, n long, most double, total double"))
    sums = out.where("id IS NULL")
    peak = sums.groupBy("qid").agg(F.sum("n").alias("n"), F.max("most").alias("peak"))
    total = sums.select("qid", "most", "total").join(peak, "qid").groupBy("qid", "n", "peak").agg(F.sum(F.col("total") * F.exp(F.col("most") - F.col("peak"))).alias("total"))
    soft = out.where("id IS NOT NULL").select("qid", "id", "raw").join(total, "qid").select(F.col("qid").alias("query"), "id", "n", (F.exp(F.col("raw") - F.col("peak")) / F.col("total")).alias("soft"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("soft"), "id"))
    return soft.where(F.col("soft") >= 0.1 / F.col("n")).withColumn("rank", order).where(F.col("rank") <= keep).select("query", "id", "soft")


def assign(vectors: DataFrame, centroids: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """vectors (id, vec) with the best of centroids (cid, centroid) if its cosine passes the threshold, else null; ties by cid."""
    found = nearest(centroids.select(F.col("cid").alias("id"), F.col("centroid").alias("vec")), vectors.select(F.col("id").alias("qid"), "vec"), 1)
    good = F.col("sim") > threshold if strict else F.col("sim") >= threshold
    best = found.select(F.col("qid").alias("id"), F.when(good, F.col("id")).alias("cid"), "sim")
    return vectors.select("id").join(best, "id", "left")


def attention(scores: DataFrame, key: str, score: str, keep: int = 5) -> DataFrame:
    """Softmax of scores within a key; rows of at least a tenth of the mean share and a positive raw score, the `keep` best."""
    w = Window.partitionBy(key)
    soft = F.exp(F.col(score) - F.max(score).over(w))
    out = scores.withColumn("n", F.count("*").over(w)).withColumn("soft", soft).withColumn("soft", F.col("soft") / F.sum("soft").over(w))
    out = out.where((F.col("soft") >= 0.1 / F.col("n")) & (F.col(score) > 0))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("soft"), "id"))).where(F.col("rank") <= keep)


def ema_fold(df: DataFrame, key: str, order: str, vec: str) -> DataFrame:
    """Running centroid of each key: v1, then v + a (x - v) with a = min(1 / n, 0.1); another dimension starts anew."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.transform(vec, lambda x: x.cast("double")).alias("v")))).alias("vs"))
    start = F.struct(F.expr("CAST(array() AS array<double>)").alias("v"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(F.size(s["v"]) == F.size(x["v"]), s["n"] + 1).otherwise(F.lit(1))
        a = F.when(n == 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0) / n, F.lit(0.1)))
        moved = F.when(n == 1, x["v"]).otherwise(F.zip_with(s["v"], x["v"], lambda p, q: p + a * (q - p)))
        return F.struct(moved.alias("v"), n.alias("n"))

    return rows.select(key, F.aggregate("vs", start, step, lambda s: s["v"]).alias("vec"))


def subject_offsets(points: DataFrame) -> DataFrame:
    """(parent, subject, offset, n): the centroid of each subject's vectors less that of its siblings' under the same parent.

    points: (parent, subject, vec), null or non-finite vectors left out. A subject without siblings has its own centroid as
    offset; n counts its vectors. Sums of a parent less a subject's own give its siblings', so no two subjects are paired.
    """
    rows = points.where(finite("vec")).where("parent IS NOT NULL AND subject IS NOT NULL").select("parent", "subject", F.posexplode("vec").alias("pos", "x"))
    own = rows.groupBy("parent", "subject", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    every = own.groupBy("parent", "pos").agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"))
    rest = (F.col("ps") - F.col("s")) / F.nullif(F.col("pn") - F.col("n"), F.lit(0))
    parts = own.join(every, ["parent", "pos"]).withColumn("o", F.col("s") / F.col("n") - F.coalesce(rest, F.lit(0.0)))
    return parts.groupBy("parent", "subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda z: z["o"]).alias("offset"), F.max("n").alias("n"))


def local_queries(queries: DataFrame, offsets: DataFrame, coefficient: float = 0.3, cold: int = 20) -> DataFrame:
    """queries (qid, subject, vec) moved by `coefficient` of their subject's offset (subject, offset, n); unmoved below `cold` vectors or without one."""
    met = queries.join(offsets.select("subject", "offset", "n"), "subject", "left")
    moved_ = F.zip_with(F.transform("vec", lambda x: x.cast("double")), "offset", lambda x, o: x + coefficient * o)
    return met.select("qid", "subject", F.when((F.col("n") >= cold) & (F.size("offset") == F.size("vec")), moved_).otherwise(F.transform("vec", lambda x: x.cast("double"))).alias("vec"))


def after_moves(parents: DataFrame, moves: DataFrame, most: float = 0.1) -> DataFrame:
    """(id, vec, n) of parents (id, vec, n) after nodes moved between them: moves (ord, vec, source, target), in order.

    The old parent loses the node's share, (n vec - v) / (n - 1), if it had more than one; the new one takes it in by
    v's weight least(1 / (n + 1), most), from a zero vector if it had none. A move without a vector, or of another length
    than the parent's, changes nothing there. A parent's own moves are folded in their order, ties by vector.
    """
    sound = moves.where(finite("vec")).select("ord", F.transform("vec", lambda x: x.cast("double")).alias("v"), "source", "target")
    each = sound.select("ord", "v", F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(True).alias("leaves")), F.struct(F.col("target").alias("id"), F.lit(False).alias("leaves")))).alias("e"))
    own = each.where("e.id IS NOT NULL").groupBy("e.id").agg(F.array_sort(F.collect_list(F.struct("ord", "e.leaves", "v"))).alias("moves"))
    start = parents.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).join(own, "id", "left")

    def step(s: Column, m: Column) -> Column:
        n, v = s["n"], m["v"]
        fits = s["vec"].isNull() | (F.size(s["vec"]) == F.size(v))
        base = F.coalesce(s["vec"], F.transform(v, lambda _: F.lit(0.0)))
        a = F.least(1.0 / (n + 1), F.lit(most))
        out = F.struct(F.zip_with(base, v, lambda x, y: (x * n - y) / F.nullif(n - 1, F.lit(0))).alias("vec"), (n - 1).alias("n"))
        into = F.struct(F.zip_with(base, v, lambda x, y: (1 - a) * x + a * y).alias("vec"), (n + 1).alias("n"))
        leaves = m["leaves"] & (n > 1) & s["vec"].isNotNull()
        return F.when(fits & leaves, out).when(fits & ~m["leaves"], into).otherwise(s)

    folded = F.aggregate(F.coalesce("moves", F.expr("CAST(array() AS array<struct<ord: bigint, leaves: boolean, v: array<double>>>)")), F.struct("vec", "n"), step)
    return start.withColumn("s", F.when(F.col("moves").isNull(), F.struct("vec", "n")).otherwise(folded)).select("id", "s.vec", "s.n")
