"""Approximate nearest neighbours through an inverted file that lives as a table.

`build` fits unit centroids on a bounded sample, puts every vector into its nearest cell and writes two tables:
codes (cell, block, id, code: one byte a component of the residual, scale) in order of cells, and the unit vectors by id.
`search` reads the codes of each query's nearest cells only, scores them in blocks, and ranks the best again on the
vectors themselves, so returned cosines are exact and only membership is approximate. `calibrated` finds how many
cells reach a recall against the exact search; with all cells and no cut before the second ranking the result is exact.

Defined results: vectors that are null, without a finite component, or of norm 0 are not indexed and not searched;
cosines have 6 places, ties go to the smaller id; a cell of any size is dealt out in blocks; an empty table gives an
index without rows, and a search there no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from memloom.operators.vectors import finite, nearest, norm, unit_rows
from memloom.sources.shared import cut
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most cells, sampled vectors for each cell, and vectors in a block of a cell.
CELLS, SAMPLE, BLOCK = 4096, 64, 8192


@dataclass
class Index:
    """codes, vectors and cell sizes are tables; centroids are at most CELLS rows."""

    codes: DataFrame
    vectors: DataFrame
    sizes: DataFrame
    centroids: np.ndarray

    @property
    def count(self) -> int:
        return self.sizes.agg(F.sum("n")).first()[0] or 0


def _fitted(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means on the sample; an empty cell takes the worst placed vector."""
    at = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ at.T).argmax(1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        lost = np.flatnonzero(np.bincount(near, minlength=len(at)) == 0)
        worst = np.argsort((sample * at[near]).sum(1), kind="stable")[: len(lost)]
        sums[lost[: len(worst)]] = sample[worst]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 0, sums / np.where(size > 0, size, 1), at)
    return at


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Index of vectors (id, vec), written under path. cells: the square root of their number, at most CELLS, unless given."""
    kept = vectors.where(finite("vec")).where(norm("vec") > 0).select("id", "vec")
    total = kept.count()
    cells = min(CELLS, cells or max(1, math.isqrt(total)), max(1, total))
    want = cells * sample
    share = min(1.0, 4 * want / max(1, total))
    by_hash = F.xxhash64("id", F.lit("sample"))
    chosen = kept.where(F.pmod(by_hash, F.lit(1 << 20)) <= share * (1 << 20)).orderBy(by_hash, "id").limit(want).toPandas()
    at = _fitted(unit_rows(chosen["vec"]), cells) if len(chosen) else np.zeros((0, 0))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                u = unit_rows(f["vec"])
                cell = (u @ at.T).argmax(1)
                rest = u - at[cell]
                scale = np.abs(rest).max(axis=1) / 127
                code = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": f["id"], "code": [c.tobytes() for c in code], "scale": scale, "vec": list(u)})

    placed = cut(kept.mapInPandas(place, "cell int, id long, code binary, scale double, vec array<double>"))
    placed.select("id", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    blocks = placed.select("cell", "id", "code", "scale").join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int")).drop("n")
    blocks.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/codes")
    spark = vectors.sparkSession
    spark.createDataFrame([(json.dumps(at.tolist()),)], "centroids string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    at = np.array(json.loads(spark.read.parquet(f"{path}/centroids").first()[0]), float)
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("codes", "vectors", "sizes")), at)


def _probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(qid, qvec, cell): each query's nearest cells."""
    at, take = index.centroids, min(probes, len(index.centroids))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f) and take:
                u = unit_rows(f["vec"])
                cells = np.argsort(-(u @ at.T), axis=1, kind="stable")[:, :take]
                yield pd.DataFrame({"qid": np.repeat(f["qid"].to_numpy(), take), "qvec": [x for x in u for _ in range(take)], "cell": cells.ravel().astype(np.int32)})

    asked = queries.where(finite("vec")).where(norm("vec") > 0).select("qid", "vec").dropDuplicates(["qid"])
    return asked.mapInPandas(near, "qid long, qvec array<double>, cell int")


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, refine: int | None = 8, threshold: float = -1.0, other: bool = False) -> DataFrame:
    """(qid, id, sim, rank): up to k vectors of each query (qid, vec) with a cosine >= threshold. other: not the one of id = qid.

    refine: k * refine vectors of a cell's block are ranked again on their true cosines; None: all of them.
    """
    probed = cut(_probed(index, queries, probes))
    at, keep = index.centroids, None if refine is None else k * refine
    empty = pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "guess": pd.Series(dtype="float64")})

    def score(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if codes.empty or asked.empty:
            return empty
        u, cell = np.stack(asked["qvec"].to_list()), int(codes["cell"].iloc[0])
        rest = np.frombuffer(b"".join(codes["code"]), np.int8).reshape(len(codes), -1)
        ids, qids = codes["id"].to_numpy(), asked["qid"].to_numpy()
        parts = []
        for i in range(0, len(u), 256):
            guess = (u[i : i + 256] @ at[cell])[:, None] + (u[i : i + 256] @ rest.T.astype(float)) * codes["scale"].to_numpy()
            if other:
                guess[ids[None, :] == qids[i : i + 256, None]] = -np.inf
            top = np.argsort(-guess, axis=1, kind="stable")[:, : keep or len(ids)]
            best = np.take_along_axis(guess, top, 1)
            r, j = np.nonzero(np.isfinite(best))
            parts.append(pd.DataFrame({"qid": qids[i : i + 256][r], "id": ids[top[r, j]], "guess": best[r, j]}))
        return pd.concat(parts)

    sized = index.sizes.select("cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).alias("block"))
    dealt = probed.join(sized, "cell")
    found = index.codes.join(probed.select("cell").distinct(), "cell", "left_semi").groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInPandas(score, "qid long, id long, guess double")
    if keep is not None:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("guess"), "id"))).where(F.col("n") <= keep)
    vec = probed.select("qid", "qvec").dropDuplicates(["qid"])
    both = found.select("qid", "id").join(index.vectors, "id").join(vec, "qid")
    sim = F.round(F.aggregate(F.zip_with("vec", "qvec", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z), 6)
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))
    return both.select("qid", "id", sim.alias("sim")).where(F.col("sim") >= threshold).withColumn("rank", order).where(F.col("rank") <= k)


def read_share(index: Index, queries: DataFrame, probes: int) -> float:
    """Share of all (query, vector) pairs whose codes a search reads."""
    asked = _probed(index, queries, probes)
    read, n = asked.join(index.sizes, "cell").agg(F.sum("n"), F.countDistinct("qid")).first()
    return (read or 0) / max(1, n * index.count)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (qid, id) that were found."""
    total = exact.count()
    return found.join(exact.select("qid", "id"), ["qid", "id"], "left_semi").count() / total if total else 1.0


def calibrated(index: Index, queries: DataFrame, k: int, goal: float = 0.95, sample: int = 200, other: bool = False) -> tuple[int, float]:
    """(probes, recall) : the fewest cells, doubling, whose recall@k on `sample` of the queries reaches the goal."""
    chosen = cut(queries.select("qid", "vec").orderBy(F.xxhash64("qid"), "qid").limit(sample))
    exact = cut(nearest(index.vectors, chosen, k, among="other" if other else "all"))
    probes = 1
    while True:
        got = recall(search(index, chosen, k, probes, other=other), exact)
        if got >= goal or probes >= len(index.centroids):
            return min(probes, max(1, len(index.centroids))), got
        probes *= 2
