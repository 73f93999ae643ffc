"""Density clustering by mutual-reachability trees.

A group of up to BLOCK vectors is one task's work. Of a larger group the same tree is built from pairs of blocks:
core distances are merged from each pair's nearest, then each pair of blocks gives the least spanning tree of its own
distances, and trees of neighbouring pairs are merged until one is left, as the tree of a union of edges lies in the
union of their trees. No task holds a matrix of distances. Only the tree, one edge a vector, is gathered for a group.
Labels are those of the whole group either way (equal distances may be merged in another order).
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from memloom.operators import vectors
from memloom.sources.shared import cut
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, blocks of a group unless they were larger than TILE, and vectors that a tree meets at once (they stay in a core's cache).
BLOCK, PARTS, TILE, STEP = 4000, 12, 16384, 2048


def _cores(u: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """The least k distances of each row of u to the rows of v, in order; fewer if v has fewer."""
    out = []
    for i in range(0, len(u), 256):
        dist = np.clip(1 - u[i : i + 256] @ v.T, 0, 2)
        out.append(np.sort(np.partition(dist, k - 1, axis=1)[:, :k] if len(v) > k else dist, axis=1))
    return np.concatenate(out)


def _own_tree(u: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): the least spanning tree of the rows of u by mutual reachability (Prim)."""
    n = len(u)
    near, link, open_ = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    a, b, w, j = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1), 0
    for k in range(n - 1):
        open_[j], near[j] = False, np.inf
        reach = np.maximum(np.maximum(np.minimum(1 - u @ u[j], 2), core), core[j])  # cores are 0 at least
        closer = np.flatnonzero((reach < near) & open_)
        near[closer], link[closer] = reach[closer], j
        j = int(near.argmin())
        a[k], b[k], w[k] = link[j], j, near[j]
    return a, b, w


def _cross_tree(u: np.ndarray, v: np.ndarray, cu: np.ndarray, cv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): the least spanning tree of the distances between rows of u and rows of v; a counts rows of u, b of v."""
    n = len(u) + len(v) - 1
    sides = ((u, cu, np.full(len(u), np.inf), np.zeros(len(u), int), np.ones(len(u), bool)), (v, cv, np.full(len(v), np.inf), np.zeros(len(v), int), np.ones(len(v), bool)))
    ends, w, side, j = np.zeros((2, n), int), np.zeros(n), 0, 0
    for k in range(n):
        x, core, own, _, open_ = sides[side]
        open_[j], own[j] = False, np.inf
        y, others, near, link, free = sides[1 - side]
        reach = np.maximum(np.maximum(np.minimum(1 - y @ x[j], 2), others), core[j])
        closer = np.flatnonzero((reach < near) & free)
        near[closer], link[closer] = reach[closer], j
        at = [int(s[2].argmin()) for s in sides]
        side = int(sides[1][2][at[1]] < sides[0][2][at[0]])
        j = at[side]
        ends[side, k], ends[1 - side, k], w[k] = j, sides[side][3][j], sides[side][2][j]
    return ends[0], ends[1], w


def least_tree(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b, w) that are a least spanning forest, equal w by a and b (Boruvka)."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, w))
    x, y = ends[: len(a)][order], ends[len(a) :][order]
    live, kept, none = np.arange(len(order)), [np.zeros(0, int)], len(order)
    while True:
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return order[np.concatenate(kept)]
        first = np.full(len(ids), none)
        np.minimum.at(first, x, np.arange(len(live)))
        np.minimum.at(first, y, np.arange(len(live)))
        first[first == none] = -1
        some = np.flatnonzero(first >= 0)
        e = first[some]
        kept.append(live[np.unique(e)])
        root = np.arange(len(ids))
        root[some] = np.where(x[e] == some, y[e], x[e])
        both = (root[root] == np.arange(len(ids))) & (np.arange(len(ids)) < root)  # two that chose one another
        root[both] = np.flatnonzero(both)
        while not np.array_equal(far := root[root], root):
            root = far
        x, y = root[x], root[y]


def tree_clusters(x: np.ndarray, min_cluster_size: int, min_samples: int) -> np.ndarray:
    """Labels (-1 for noise) of cosine-distance density clusters, chosen by excess of mass."""
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a, b, w = _own_tree(u, _cores(u, u, min(min_samples, n - 1) + 1)[:, -1])
    return labels_of(a, b, w, n, min_cluster_size)


def labels_of(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, min_cluster_size: int) -> np.ndarray:
    """Labels of the n vectors that the edges (a, b) of length w of a spanning tree join. No recursion: clusters can be nested thousands deep."""
    order = np.lexsort((b, a, w))
    parent, size = array("q", range(2 * n - 1)), array("q", [1]) * n + array("q", [0]) * (n - 1)
    left, right = array("q", [0]) * (n - 1), array("q", [0]) * (n - 1)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in range(n - 1):
        p, q = find(int(a[order[k]])), find(int(b[order[k]]))
        left[k], right[k] = p, q
        parent[p] = parent[q] = n + k
        size[n + k] = size[p] + size[q]
    levels = (1 / np.maximum(w[order], 1e-12)).tolist()

    # From the top: each cluster, its stability, and the two that it splits into. Parents come before their children.
    top, heads, todo = 2 * n - 2, [], [(2 * n - 2, 0.0, -1)]
    while todo:
        i, birth, above = todo.pop()
        if above >= 0:
            heads[above][2].append(len(heads))
        stable, j, heads_of = 0.0, i, []
        while j >= n:
            kids, level = (left[j - n], right[j - n]), levels[j - n]
            big = [c for c in kids if size[c] >= min_cluster_size]
            if len(big) == 1:
                stable += (level - birth) * size[kids[0] if kids[1] == big[0] else kids[1]]
                j = big[0]
                continue
            stable += (level - birth) * size[j]
            if len(big) == 2:
                heads_of = [(c, level, len(heads)) for c in reversed(big)]
            break
        heads.append([i, stable, []])
        todo += heads_of
    splits = [False] * len(heads)
    for k in range(len(heads) - 1, -1, -1):
        if heads[k][2]:
            below = sum(heads[c][1] for c in heads[k][2])
            if below > heads[k][1]:
                heads[k][1], splits[k] = below, True
    labels, todo, count = np.full(n, -1), [0], 0
    while todo:
        k = todo.pop()
        if splits[k]:
            todo += reversed(heads[k][2])
        elif heads[k][0] != top:
            below = [heads[k][0]]
            while below:
                j = below.pop()
                if j < n:
                    labels[j] = count
                else:
                    below += (left[j - n], right[j - n])
            count += 1
    return labels


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_list()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _tiles(rows: DataFrame, blocks: int, f: Callable, schema: str) -> DataFrame:
    """f on each pair of blocks (two frames sorted by id; the same one twice on the diagonal) of each group."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = own.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        p, q = g["p"].iloc[0], g["q"].iloc[0]
        return f(g[g["own"] == p], g[g["own"] == q])

    return dealt.groupBy("grp", "p", "q").applyInPandas(run, schema)


def _spanning_tree(rows: DataFrame, min_samples: int) -> DataFrame:
    """(grp, a, b, w): the least spanning tree of each group of rows (grp, id, vec) by mutual reachability."""
    most = rows.groupBy("grp").count().agg(F.max("count")).first()[0]
    blocks, k = max(math.ceil(most / TILE), min(PARTS, math.ceil(most / BLOCK))), min_samples + 1

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"grp": [], "id": [], "d": []})
        u, v = _unit(x["vec"]), _unit(y["vec"])
        one = lambda rows, d: pd.DataFrame({"grp": rows["grp"], "id": rows["id"], "d": list(d)})
        return one(x, _cores(u, v, k)) if x["own"].iloc[0] == y["own"].iloc[0] else pd.concat([one(x, _cores(u, v, k)), one(y, _cores(v, u, k))])

    def edges(grp: int, p: int, q: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        at = least_tree(a, b, w)
        return pd.DataFrame({"grp": grp, "p": p, "q": q, "a": a[at], "b": b[at], "w": w[at]})

    def forest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"grp": [], "p": [], "q": [], "a": [], "b": [], "w": []})
        sides = [[(f["id"].to_numpy()[i : i + STEP], _unit(f["vec"].iloc[i : i + STEP]), f["core"].to_numpy()[i : i + STEP]) for i in range(0, len(f), STEP)] for f in (x, y)]
        same, found = x["own"].iloc[0] == y["own"].iloc[0], []
        for i, (ids, u, cu) in enumerate(sides[0]):
            for j, (others, v, cv) in enumerate(sides[1]):
                if same and j <= i:
                    if j == i:
                        a, b, w = _own_tree(u, cu)
                        found.append((ids[a], ids[b], w))
                    continue
                a, b, w = _cross_tree(u, v, cu, cv)
                found.append((ids[a], others[b], w))
        a, b, w = (np.concatenate(c) for c in zip(*found))
        return edges(x["grp"].iloc[0], x["p"].iloc[0], x["q"].iloc[0], np.minimum(a, b), np.maximum(a, b), w)

    def merged(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return edges(*key, *(g[c].to_numpy() for c in "abw"))

    near = _tiles(rows, blocks, nearest, "grp long, id long, d array<double>").groupBy("grp", "id").agg(F.sort_array(F.flatten(F.collect_list("d"))).alias("d"))
    core = near.select("grp", "id", F.element_at("d", F.least(F.lit(k), F.size("d"))).alias("core"))
    points = rows.join(core, ["grp", "id"]).select("grp", "id", "vec", "core")
    schema = "grp long, p int, q int, a long, b long, w double"
    tree = _tiles(points, blocks, forest, schema)
    while blocks > 1:  # trees of 8 x 8 pairs of blocks, until one is left
        tree, blocks = tree.groupBy("grp", F.shiftright("p", 3).alias("p"), F.shiftright("q", 3).alias("q")).applyInPandas(merged, schema), math.ceil(blocks / 8)
    return cut(tree.select("grp", "a", "b", "w"))


def density_clusters(points: DataFrame, group: str, min_cluster_size: int = 3, min_samples: int = 2) -> DataFrame:
    """(grp, id, cluster) of points (group, id, vec), ids being unique; cluster -1 is noise."""
    rows = points.select(F.col(group).cast("long").alias("grp"), F.col("id").cast("long").alias("id"), "vec")
    large = rows.groupBy("grp").count().where(F.col("count") > BLOCK).select("grp")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        labels = tree_clusters(np.stack(g["vec"].to_list()).astype(float), min_cluster_size, min_samples)
        return pd.DataFrame({"grp": g["grp"].to_numpy(), "id": g["id"].to_numpy(), "cluster": labels})

    def extract(ids: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        order = np.sort(ids["id"].to_numpy())
        labels = labels_of(np.searchsorted(order, tree["a"]), np.searchsorted(order, tree["b"]), tree["w"].to_numpy(), len(order), min_cluster_size)
        return pd.DataFrame({"grp": ids["grp"].iloc[0], "id": order, "cluster": labels})

    schema = "grp long, id long, cluster int"
    small = rows.join(large, "grp", "left_anti").groupBy("grp").applyInPandas(run, schema)
    if not large.limit(1).count():
        return small
    big = rows.join(large, "grp")
    tree = _spanning_tree(big, min_samples)
    return small.unionByName(big.select("grp", "id").groupBy("grp").cogroup(tree.groupBy("grp")).applyInPandas(extract, schema))


def silhouette(labelled: DataFrame, block: int = 4096) -> DataFrame:
    """(grp, id, cluster, silhouette) of vectors (grp, id, vec) with a cluster: cosine silhouettes, exactly, without pairs of vectors.

    The mean distance of a vector to a cluster is 1 less its product with the cluster's mean unit vector, so each vector
    meets the sums of clusters, in blocks, and keeps the two nearest of them.
    Defined results: noise (a cluster below 0 or null) and vectors that are null, not finite or of norm 0 take no part;
    a vector alone in its cluster has 0, as have all vectors of a group with one cluster; ids are unique within a group.
    """
    u = F.transform("vec", lambda x: x.cast("double") / vectors.norm("vec"))
    rows = labelled.where("cluster >= 0").where(vectors.finite("vec")).where(vectors.norm("vec") > 0)
    rows = cut(rows.select("grp", "id", "cluster", u.alias("vec")).withColumn("key", F.monotonically_increasing_id()))
    parts = rows.select("grp", "cluster", F.posexplode("vec").alias("pos", "x")).groupBy("grp", "cluster", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = parts.groupBy("grp", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sum"), F.max("n").alias("n"))
    sums = cut(sums)
    means = sums.select("grp", F.col("cluster").cast("long").alias("id"), F.transform("sum", lambda x: x / F.col("n")).alias("vec"))

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"qid": [], "id": [], "dot": []}).astype({"qid": "int64", "id": "int64", "dot": "float64"})
        dots = np.stack(y["qvec"].to_list()) @ np.stack(x["vec"].to_list()).T
        top = np.argsort(-dots, axis=1, kind="stable")[:, :2]
        k = top.shape[1]
        return pd.DataFrame({"qid": np.repeat(y["qid"].to_numpy(), k), "id": x["id"].to_numpy()[top].ravel(), "dot": np.take_along_axis(dots, top, 1).ravel()})

    c, q = vectors.dealt(means, rows.select(F.col("key").alias("qid"), "vec", "grp"), block, "grp")
    two = c.groupBy("grp", "b", "g").cogroup(q.groupBy("grp", "b", "g")).applyInPandas(near, "qid long, id long, dot double")
    other = two.join(rows.select(F.col("key").alias("qid"), "cluster"), "qid").where("id <> cluster").groupBy(F.col("qid").alias("key")).agg((1 - F.max("dot")).alias("b"))
    own = rows.join(sums, ["grp", "cluster"]).withColumn("a", (F.col("n") - vectors.dot("vec", "sum")) / F.nullif(F.col("n") - 1, F.lit(0)))
    most = F.greatest("a", "b")
    whole = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (most > 0), (F.col("b") - F.col("a")) / F.nullif(most, F.lit(0.0))).otherwise(0.0)
    return own.join(other, "key", "left").select("grp", "id", "cluster", whole.alias("silhouette"))


def clustered(points: DataFrame, group: str, sizes: tuple[int, ...] = (3, 2), min_samples: int = 2) -> DataFrame:
    """density_clusters with the first minimum size; groups that come out without any cluster are tried again with the next, alone."""
    found, left = None, points
    for k, size in enumerate(sizes):
        out = cut(density_clusters(left, group, size, min_samples))
        some = out.where("cluster >= 0").select("grp").distinct()
        last = k == len(sizes) - 1
        kept = out if last else out.join(some, "grp", "left_semi")
        found = kept if found is None else found.unionByName(kept)
        if last or not out.join(some, "grp", "left_anti").limit(1).count():
            break
        left = left.join(some.withColumnRenamed("grp", group), group, "left_anti")
    return found


def build_tree(points: DataFrame, max_depth: int = 3, min_cluster_size: int = 3) -> DataFrame:
    """(id, path): points (id, vec) clustered level by level; each level is one grouped map, noise is a floating leaf of its group."""
    level = points.withColumn("path", F.lit("root"))
    for _ in range(max_depth):  # each level is written out, as the next one reads it several times
        keys = level.select("path").distinct().select("path", F.xxhash64("path").alias("grp"))
        found = density_clusters(level.join(keys, "path").select("grp", "id", "vec"), "grp", min_cluster_size)
        step = F.when(F.col("cluster") >= 0, F.concat("path", F.lit("/c"), F.col("cluster").cast("string"))).otherwise(F.col("path"))
        level = cut(level.join(found.select("id", "cluster"), "id").select("id", "vec", step.alias("path")))
    return level.select("id", "path")


def relaxed(points: DataFrame, group: str, start: int = 5, attempts: int = 3, most_noise: float = 0.5) -> DataFrame:
    """density_clusters with smaller minimum sizes, one attempt after another, while more than most_noise is noise."""
    for k in range(attempts):
        out = cut(density_clusters(points, group, max(2, start - 2 * k), max(1, 2 - k)))
        noise = out.agg(F.avg((F.col("cluster") < 0).cast("double"))).first()[0]
        if noise is None or noise <= most_noise:
            break
    return out
