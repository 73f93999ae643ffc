"""Greedy and sequential operators: MMR, diverse selection, bootstrap, confidence fold, chunk packing, sequence ratio."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL = 20


def mmr(cand: DataFrame, keep: int, balance: float = 0.55, pool: int = POOL) -> DataFrame:
    """Maximal marginal relevance per query over the `pool` best of (query, id, text, score): character-set Jaccard as redundancy.

    The pool is the feature's own bound, so a group in Python is small.
    """
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = cand.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= pool)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn").reset_index(drop=True)
        low, high = g["score"].min(), g["score"].max()
        rel = np.full(len(g), 0.5) if np.isclose(low, high, rtol=1e-9) else ((g["score"] - low) / (high - low)).to_numpy()
        chars = [set(x.strip()) for x in g["text"]]
        chosen: list[int] = []
        worth: list[float] = []
        while len(chosen) < min(keep, len(g)):
            gain = {i: balance * rel[i] - (1 - balance) * max((len(chars[i] & chars[j]) / len(chars[i] | chars[j]) if chars[i] and chars[j] else 0.0 for j in chosen), default=0.0) for i in range(len(g)) if i not in chosen}
            i = max(gain, key=lambda k: (gain[k], -k))
            chosen.append(i)
            worth.append(round(float(gain[i]), 6))
        return pd.DataFrame({"query": g["query"].iloc[chosen].to_numpy(), "id": g["id"].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1), "mmr": worth})

    return top.groupBy("query").applyInPandas(pick, "query string, id long, rank int, mmr double")


def diverse(items: DataFrame) -> DataFrame:
    """Of (grp, id, source, kind, score), by score: each item with a source or a kind not seen before in its group.

    Only the best item of a source and the best of a kind can be chosen, so the greedy walk is two aggregates: an item is
    taken iff it is its source's first or its kind's first; ties by id. A group of any size is summed up before it is shuffled.
    """
    item = F.struct("score", (-F.col("id")).alias("__id"), "source", "kind")
    first = lambda c: items.groupBy("grp", c).agg(F.max(item).alias("x"))
    taken = [first(c).select("grp", (-F.col("x.__id")).alias("id"), "x.source", "x.kind") for c in ("source", "kind")]
    return taken[0].unionByName(taken[1]).distinct()


def bootstrap_ci(values: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(grp, n, low, high): percentile interval of the mean. Resamples are Poisson weights drawn per row on the executors, so no group is gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for grp, g in b.dropna().groupby("grp"):
                ids = pd.util.hash_pandas_object(g["value"], index=False).to_numpy()
                rng = np.random.default_rng([seed, int(ids.sum() % (1 << 32)), len(ids)])
                w = rng.poisson(1.0, (resamples, len(g)))
                s, n = sums.setdefault(grp, (np.zeros(resamples), np.zeros(resamples)))
                s += w @ g["value"].to_numpy(float)
                n += w.sum(1)
        for grp, (s, n) in sums.items():
            yield pd.DataFrame({"grp": grp, "i": range(resamples), "s": s, "n": n})

    parts = values.mapInPandas(run, "grp string, i int, s double, n double")
    means = parts.groupBy("grp", "i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.groupBy("grp").agg(F.count("*").alias("resamples"), F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


def confidence_fold(log: DataFrame, start: float = 0.5) -> DataFrame:
    """Fold of a use log (k, ts, tie, recalled, clicked, negated) in order: (k, confidence, misses, action).

    click: +0.05 up to 1; recall: x0.99; neither: x0.997 and a miss; negated: x0.5; from three misses on an extra x0.95.
    """
    rows = log.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ts", "tie", "recalled", "clicked", "negated"))).alias("log"))

    def step(s: Column, e: Column) -> Column:
        c = s["c"]
        moved = F.when(e["negated"], c * 0.5).when(e["clicked"], F.least(c + 0.05, F.lit(1.0))).when(e["recalled"], c * 0.99).otherwise(c * 0.997)
        misses = F.when(e["clicked"] | e["recalled"], F.lit(0)).otherwise(s["m"] + 1)
        return F.struct(F.when(misses >= 3, moved * 0.95).otherwise(moved).alias("c"), misses.alias("m"))

    end = F.aggregate("log", F.struct(F.lit(start).alias("c"), F.lit(0).alias("m")), step)
    out = rows.select("k", end.alias("e")).select("k", F.round("e.c", 6).alias("confidence"), F.col("e.m").alias("misses"))
    action = F.when(F.col("confidence") < 0.1, "remove").when(F.col("confidence") < 0.3, "review").when(F.col("confidence") < 0.5, "demote").when(F.col("confidence") > 0.95, "promote").otherwise("keep")
    return out.withColumn("action", action)


def sequence_ratio(a: str, b: str) -> Column:
    """Ratcliff-Obershelp similarity of two text columns; no built-in expression says it."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, p or "", q or "").ratio(), 6) for p, q in zip(x, y)])

    return ratio(a, b)


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(id, chunk, text): paragraphs packed into chunks of at most `size` characters; longer paragraphs are cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["text"]):
                held, n = "", 0
                for p in (text or "").split("\n"):
                    parts = [p[k : k + size] for k in range(0, len(p), size)] or [""]
                    for x in parts:
                        if held and len(held) + 1 + len(x) > size:
                            out.append((i, n, held))
                            held, n = x, n + 1
                        else:
                            held = f"{held}\n{x}" if held else x
                if held:
                    out.append((i, n, held))
            yield pd.DataFrame(out, columns=["id", "chunk", "text"])

    return docs.mapInPandas(run, "id long, chunk int, text string")
