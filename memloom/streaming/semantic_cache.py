"""A semantic cache as a stream operator: lookups by meaning, stored results, expiry by last hit, eviction by hits.

Keyed state: one cache for each fingerprint (the set of results an entry may name), at most max_entries entries of it.
A request whose context and query are near enough to those of an entry, the oldest entry first, is a hit and renews
it; any other request is stored with its own result. Entries that have not been hit for ttl go, by a timer in event
time as well as before each lookup; past max_entries the one with the fewest hits goes, the longest unhit first.

Requests of one micro-batch and key are taken by time, then id. A late one, older than what its key has seen, is
answered as of the latest time its key has seen; one behind the watermark that held for the batch before (`delay`
before the latest time of the batches before that, of any key) gets no answer, as Structured Streaming leaves it out.
Defined results: a null context meets only entries without one; a vector that is null, has a null or non-finite component or
norm 0 misses and stores nothing; vectors of unequal length never match; a null fingerprint is ''.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Thresholds of context and query, seconds without a hit, entries.
CONTEXT, QUERY, TTL, MOST = 0.90, 0.85, 24 * 3600, 1000
ANSWER = "key string, id long, at timestamp, hit boolean, entry long, hits int, answer string"
_ENTRY = "id long, context array<double>, query array<double>, answer string, hits int, last double"


def unit(v: Iterable[float] | None) -> np.ndarray | None:
    if v is None:
        return None
    x = np.array([np.nan if c is None else c for c in v], float)
    n = np.linalg.norm(x)
    return x / n if np.isfinite(x).all() and n > 0 else np.array([])


def near(a: np.ndarray | None, b: np.ndarray | None, least: float) -> bool:
    """Both absent, or both there with a cosine of at least `least`, to 9 places."""
    if a is None or b is None:
        return a is None and b is None
    return len(a) == len(b) > 0 and round(float(a @ b), 9) >= least


class Cache:
    """Entries in order of their storing; the whole of a key's state."""

    def __init__(self, entries: list[tuple], context: float, query: float, ttl: float, most: int) -> None:
        self.entries = [list(e) for e in entries]
        self.context, self.query, self.ttl, self.most = context, query, ttl, most

    def purge(self, now: float) -> None:
        self.entries = [e for e in self.entries if now - e[5] < self.ttl]

    def ask(self, now: float, id_: int, context: np.ndarray | None, query: np.ndarray | None, answer: str | None) -> tuple:
        """(hit, entry, hits, answer) of a request."""
        self.purge(now)
        if query is None or not len(query) or (context is not None and not len(context)):
            return False, None, None, answer
        for e in self.entries:
            if near(context, e[1], self.context) and near(query, e[2], self.query):
                e[4], e[5] = e[4] + 1, now
                return True, e[0], e[4], e[3]
        self.entries.append([id_, context, query, answer, 1, now])
        while len(self.entries) > self.most:
            self.entries.pop(min(range(len(self.entries)), key=lambda i: (self.entries[i][4], self.entries[i][5])))
        return False, None, None, answer


class _Processor(StatefulProcessor):
    def __init__(self, *settings: float) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", _ENTRY)
        self.seen = handle.getValueState("seen", "at double")

    def _load(self) -> Cache:
        wrap = lambda v: None if v is None else np.array(v, float)
        rows = self.entries.get() if self.entries.exists() else []
        return Cache([(r[0], wrap(r[1]), wrap(r[2]), r[3], r[4], r[5]) for r in rows], *self.settings)

    def _keep(self, cache: Cache) -> None:
        plain = lambda v: None if v is None else v.tolist()
        if cache.entries:
            self.entries.put([(e[0], plain(e[1]), plain(e[2]), e[3], e[4], e[5]) for e in cache.entries])
        else:
            self.entries.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if cache.entries:
            self.handle.registerTimer(int((min(e[5] for e in cache.entries) + cache.ttl) * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seconds", "id"], kind="stable")
        cache, now, out = self._load(), self.seen.get()[0] if self.seen.exists() else -np.inf, []
        for r in batch.itertuples(index=False):
            now = max(now, r.seconds)
            out.append((key[0], r.id, r.at, *cache.ask(now, r.id, unit(r.context), unit(r.query), r.answer)))
        self._keep(cache)
        self.seen.update((now,))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])
        yield frame.astype({"hits": "Int32", "entry": "Int64", "hit": bool})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        cache = self._load()
        cache.purge(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._keep(cache)
        return iter(())

    def close(self) -> None:
        pass


def answers(requests: DataFrame, context: float = CONTEXT, query: float = QUERY, ttl: float = TTL, most: int = MOST, delay: str = "1 hour") -> DataFrame:
    """A stream of requests (key, id, at, context, query, answer) -> key, id, at, hit, entry, hits, answer.

    entry: the id of the request that stored what was found. The session's state store must be RocksDB's.
    """
    plain = requests.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"),
        F.col("id").cast("long").alias("id"),
        F.col("at").cast("timestamp").alias("at"),
        F.unix_micros(F.col("at").cast("timestamp")).cast("double").alias("seconds"),
        *[F.transform(c, lambda x: x.cast("double")).alias(c) for c in ("context", "query")],
        F.col("answer").cast("string").alias("answer"),
    ).withColumn("seconds", F.col("seconds") / 1e6)
    marked = plain.withWatermark("at", delay)
    return marked.groupBy("key").transformWithStateInPandas(_Processor(context, query, ttl, most), outputStructType=ANSWER, outputMode="append", timeMode="eventtime")
