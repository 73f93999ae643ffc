"""Exact k-means over integer vectors with Elkan's bounds.

Centroids start as the k vectors of the least hashes. Every vector carries its cluster, an upper bound of the
distance to its centroid and k lower bounds of the distances to all; they are rows of a table that each round
reads and writes once, so nothing but k centroids is held on the driver. A round moves the bounds by how far
the centroids moved, skips what the triangle inequality settles, and computes the rest as exact integers.
Bounds are rounded away from the truth (float32, one step outwards) and a centroid is skipped only where a
bound is strictly beyond the vector's own distance, so ties still go to the smaller number, exactly as if
all distances had been computed. Sums of a round's clusters come out of the same pass as rows of kind 1.

Defined results: vectors that are null, of another length than dims, or hold a null or non-finite component take
no part, nor do rows without vec_id; a repeated row counts and answers each time; fewer vectors than k give as many
centroids; equal start hashes are ordered by the vector; an empty table gives no rows; other columns are ignored.
Components beyond 64 bits stay at the limit, and so do distances and inertias.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, table

DIMS, K, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
_WIDE = 2**62
_STATE = "vec_id long, v array<long>, cluster int, distance long, upper float, lower array<float>, computed int, n long, kind int"


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v array<long> of the rows that take part."""
    sound = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < math.inf, F.lit(False)))
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dims) & sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the least sha256, in that order: at most k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def _exact(*parts: np.ndarray) -> type:
    """int64 where squared distances of these vectors fit, else Python's integers."""
    top = max((max(abs(int(p.max(initial=0))), abs(int(p.min(initial=0)))) for p in parts), default=0)
    return np.int64 if parts[0].shape[1] * 4 * top * top < 2**62 else object


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, one to one."""
    kind = _exact(a, b)
    d = a.astype(kind) - b.astype(kind)
    return (d * d).sum(axis=1)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


class Centroids:
    """A round's centroids: half the distances between them and how far each came, rounded to the safe side."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None) -> None:
        k = len(now)
        self.at = now
        between = np.stack([_root(squared(now, np.broadcast_to(c, now.shape))) for c in now]) if k else np.zeros((0, 0))
        self.half = _down(between / 2)
        apart = self.half + np.where(np.eye(k, dtype=bool), np.float32(np.inf), np.float32(0))
        self.gap = apart.min(axis=1, initial=np.float32(np.inf))
        self.moved = np.zeros(k, np.float32) if before is None else np.where((now == before).all(axis=1), np.float32(0), _up(_root(squared(now, before))))


def first(v: np.ndarray, c: Centroids) -> tuple:
    """cluster, distance, upper, lower, computed of vectors without bounds: every distance."""
    d2 = np.stack([squared(v, np.broadcast_to(x, v.shape)) for x in c.at], axis=1)
    cluster = np.argmin(d2, axis=1)  # the first of equal ones
    d = d2[np.arange(len(v)), cluster]
    root = _root(d2)
    return cluster.astype(np.int32), d, _up(_root(d)), _down(root), np.full(len(v), len(c.at), np.int32)


def settle(v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids, finish: bool) -> tuple:
    """One round of Elkan's algorithm over vectors with their bounds. finish: all own distances are computed, needed once at the end."""
    cluster, n = cluster.copy(), len(v)
    distance = distance.astype(object) if _exact(v, c.at) is object else distance.copy()
    stay = c.moved == 0
    lower = np.where(stay, lower, _down(lower - c.moved)) if n else lower
    upper = np.where(stay[cluster], upper, _up(upper + c.moved[cluster]))
    computed = np.zeros(n, np.int32)
    rest = np.flatnonzero(upper >= c.gap[cluster])
    fresh = np.arange(n) if finish else rest
    if len(fresh):
        distance[fresh] = squared(v[fresh], c.at[cluster[fresh]])
        exact = _root(distance[fresh])
        upper[fresh], lower[fresh, cluster[fresh]] = _up(exact), _down(exact)
        computed[fresh] += 1
    for j in range(len(c.at)):
        own = cluster[rest]
        ask = rest[(own != j) & (lower[rest, j] <= upper[rest]) & (c.half[own, j] <= upper[rest])]
        if not len(ask):
            continue
        d2 = squared(v[ask], np.broadcast_to(c.at[j], (len(ask), v.shape[1])))
        lower[ask, j] = _down(_root(d2))
        computed[ask] += 1
        near = (d2 < distance[ask]) | ((d2 == distance[ask]) & (j < cluster[ask]))
        won = ask[near]
        cluster[won], distance[won], upper[won] = j, d2[near], _up(_root(d2[near]))
    return cluster, distance, upper, lower, computed


def _arrays(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array([min(int(i), 2**63 - 1) for i in x] if x.dtype == object else x, pa.int64())


def assign(state: DataFrame, c: Centroids, started: bool, finish: bool) -> DataFrame:
    """Rows of vectors (kind 0) with new clusters and bounds, and per task one row of sums for each of its clusters (kind 1)."""
    k, width = c.at.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, top = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        names = ["vec_id", "v", "cluster", "distance", "upper", "lower", "computed", "n", "kind"]

        def totals() -> pa.RecordBatch:
            has = np.flatnonzero(counts)
            none = [pa.nulls(len(has), t) for t in (pa.int64(), pa.float32(), pa.list_(pa.float32()))]
            columns = [pa.array([0] * len(has), pa.int64()), _lists(sums[has], pa.int64()), pa.array(has, pa.int32()), *none, pa.nulls(len(has), pa.int32()), pa.array(counts[has]), pa.array([1] * len(has), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = _arrays(part["v"], np.int64, width)
                if started:
                    known = [part[x].to_numpy(zero_copy_only=False) for x in ("cluster", "distance", "upper")]
                    cluster, d, upper, lower, computed = settle(v, *known, _arrays(part["lower"], np.float32, k), c, finish)
                    computed = computed + part["computed"].to_numpy(zero_copy_only=False)
                else:
                    cluster, d, upper, lower, computed = first(v, c)
                size = max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))
                if (int(counts.sum()) + len(v)) * max(top, size) >= _WIDE:
                    yield totals()
                    sums[:], counts[:], top = 0, 0, 0
                if len(v) * size < _WIDE:
                    top = max(top, size)
                    order = np.argsort(cluster, kind="stable")
                    has, begin = np.unique(cluster[order], return_index=True)
                    sums[has] += np.add.reduceat(v[order], begin, axis=0)
                    counts += np.bincount(cluster, minlength=k)
                else:  # sums of these would not fit: a row each
                    for row, j in zip(v, cluster):
                        sums[j], counts[j] = row, 1
                        yield totals()
                        sums[j], counts[j] = 0, 0
                columns = [part["vec_id"], part["v"], pa.array(cluster, pa.int32()), _long(d), pa.array(upper), _lists(lower, pa.float32()), pa.array(computed, pa.int32()), pa.nulls(len(v), pa.int64()), pa.array(np.zeros(len(v), np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names)
        yield totals()

    columns = ["vec_id", "v", "cluster", "distance", "upper", "lower", "computed"] if started else ["vec_id", "v"]
    return state.select(*columns).mapInArrow(run, _STATE)


def moved(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floor of every non-empty cluster's mean; k rows of dims sums reach the driver."""
    rows = state.where("kind = 1").select("cluster", "n", F.posexplode("v").alias("pos", "x"))
    sums = rows.groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    now = before.copy()
    for r in sums.collect():
        now[r["cluster"], r["pos"]] = int(r["x"]) // r["n"]
    return now


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """vectors (vec_id, v array<long> of dims) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and computed: how many distances its rounds cost."""
    spark, state = vectors.sparkSession, None
    at = starts(vectors, k, seed)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed int")
    c = Centroids(at)
    for step in range(rounds + 1):
        new = cut(assign(vectors if state is None else state.where("kind = 0"), c, state is not None, step == rounds), "zstd")
        if state is not None:
            discard(state)
        state = new
        if step < rounds:
            c = Centroids(moved(state, c.at), c.at)
    every = state.where("kind = 0")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = {r["cluster"]: int(r["d"]) for r in every.groupBy("cluster").agg(total.alias("d")).collect()}  # at most k rows
    rows = [(j, min(by[j], 2**63 - 1), min(sum(by.values()), 2**63 - 1), hashlib.sha256(",".join(map(str, c.at[j])).encode()).hexdigest()) for j in sorted(by)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return every.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(integers(table(spark, sf_dir, "embeddings"))).drop("computed")


def _sql() -> str:
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {K})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := CAST({square} AS BIGINT), j := j)) AS m FROM v, c{i} GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT j, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT j, list({floor} ORDER BY p) AS c
FROM (SELECT m.j AS j, p, sum(v[p]) AS s, count(*) AS n FROM a{i}, range(1, {DIMS + 1}) t(p) GROUP BY 1, 2) GROUP BY j) n USING (j))""")
    last = f"""SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON m.j = j"""
    return "WITH " + ",\n".join(steps) + "\n" + last


SQL = _sql()
