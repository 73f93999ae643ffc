"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's subwords are its character n-grams with boundary marks, hashed into a fixed table of
embeddings; the embeddings of all subwords in a window of a few words are averaged and a linear softmax
over two classes turns the average into the window's odds. A text is toxic if any window is (noisy or),
so two insults in a long text are not averaged away. Embeddings and the linear layer are trained jointly
in numpy, on the driver, on a bounded sample of labelled rows (SAMPLE per class). As the model is linear
in the embeddings, scoring needs one number per subword: the table sent to the executors has a fixed size.

Defined results: null, empty or wordless texts score 0; nulls among labels are no labels; of several
labels of one id the largest counts; without any label of both kinds every score is 0; repeated rows are
scored one by one; other columns are ignored (score) or kept (accepted).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 4, 5)
WINDOW = 2
#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 2500
THRESHOLD = 0.3
#: Words of the sample whose gradients are held at a time.
BLOCK = 1 << 17
#: Words whose sums a worker remembers; beyond it the memory starts anew (scores stay the same).
MEMORY = 250_000

_BREAK = {c: " " for c in range(128) if not chr(c).isalnum()}


def words(text: str | None) -> list[str]:
    return (text or "").lower().translate(_BREAK).split()


def subwords(word: str) -> list[int]:
    """Hashes of the marked word and of its character n-grams (two bytes a character; rarer planes take two units)."""
    w = f"<{word}>".encode("utf-16-le", "surrogatepass")
    return [zlib.crc32(w)] + [zlib.crc32(w[i : i + 2 * n]) for n in GRAMS for i in range(0, len(w) - 2 * n + 2, 2)]


@dataclass
class Model:
    weight: np.ndarray  # per bucket: embedding times the difference of the softmax's two rows
    bias: float

    def __post_init__(self) -> None:
        self._clear()

    def __getstate__(self) -> tuple:
        return self.weight, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.weight, self.bias = state
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.sizes = np.zeros(1024), np.zeros(1024)

    def learn(self, new: list[str]) -> None:
        """Remember the subword sums of words met for the first time."""
        ids = [subwords(w) for w in new]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = self.weight[np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum())) & (BUCKETS - 1)]
        size = len(self.known)
        while size + len(new) > len(self.sums):
            self.sums, self.sizes = np.concatenate([self.sums, self.sums]), np.concatenate([self.sizes, self.sizes])
        self.sums[size : size + len(new)] = np.add.reduceat(flat, np.cumsum(sizes) - sizes, dtype=float)
        self.sizes[size : size + len(new)] = sizes
        self.known.update(zip(new, range(size, size + len(new))))

    def odds(self, ws: list[str]) -> np.ndarray:
        """Log odds of each window."""
        new = [w for w in set(ws) if w not in self.known]
        if new and len(self.known) + len(new) > MEMORY:
            self._clear()
            new = list(set(ws))
        if new:
            self.learn(new)
        ids = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
        at = np.arange(0, len(ws), WINDOW)
        return np.add.reduceat(self.sums[ids], at) / np.add.reduceat(self.sizes[ids], at) + self.bias

    def score(self, text: str | None) -> float:
        ws = words(text)
        if not ws:
            return 0.0
        return float(-np.expm1(-np.logaddexp(0, self.odds(ws)).sum()))


def _blocks(lengths: np.ndarray, per: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Runs of texts of about BLOCK words: texts, words, first word of each window and first window of each text, from the block's start."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        at = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        n, firsts = per[first:last], ends[first:last] - lengths[first:last] - at
        before = np.cumsum(n) - n
        windows = np.repeat(firsts - WINDOW * before, n) + WINDOW * np.arange(int(n.sum()))
        yield slice(first, last), slice(at, int(ends[last - 1])), windows.astype(np.int32), before
        first = last


def fit(texts: list[str | None], toxic: list[int], rounds: int = 40, rate: float = 0.25, decay: float = 1e-6) -> Model:
    """Full-batch Adam on embeddings and linear layer together."""
    place: dict[str, int] = {}
    coded, ys = [], []
    for text, kind in zip(texts, toxic):
        if ws := words(text):
            coded.append(np.fromiter((place.setdefault(w, len(place)) for w in ws), np.int32, len(ws)))
            ys.append(float(kind))
    y = np.array(ys)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -1000.0)
    lengths, flat = np.array([len(d) for d in coded]), np.concatenate(coded)
    gram = (np.fromiter((i for w in place for i in subwords(w)), np.uint32) & (BUCKETS - 1)).astype(np.int32)
    sizes = np.fromiter((len(subwords(w)) for w in place), np.int32, len(place))
    del coded, place
    held = np.zeros(BUCKETS, np.int32)
    held[gram] = 1
    used = np.flatnonzero(held)
    held[used] = np.arange(len(used))
    np.take(held, gram, out=gram)
    starts = np.cumsum(sizes) - sizes
    per = -(-lengths // WINDOW)
    blocks = list(_blocks(lengths, per))
    vocabulary = [(a, b) for a in range(0, len(sizes), BLOCK // 8) for b in [min(len(sizes), a + BLOCK // 8)]]
    word_sum, by_word = np.empty(len(sizes), np.float32), np.empty(len(sizes))
    random = np.random.default_rng(7)
    table_, head = random.normal(0, 0.1, (len(used), DIM)).astype(np.float32), random.normal(0, 0.1, (2, DIM))
    bias = np.array([0.0, np.log(0.5 / per.mean())])
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    parameters = [table_, head, bias]
    first_moment, second_moment = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for k in range(1, rounds + 1):
        slope = head[1] - head[0]
        scalar = table_ @ slope.astype(np.float32)
        for a, b in vocabulary:
            part = gram[starts[a] : starts[b - 1] + sizes[b - 1]]
            word_sum[a:b] = np.add.reduceat(scalar[part], starts[a:b] - starts[a])
        by_word[:], by_bias = 0, 0.0
        for docs, part, windows, firsts in blocks:
            ids = flat[part]
            share, width = 1.0 / np.add.reduceat(sizes[ids], windows), np.diff(windows, append=len(ids))
            z = np.add.reduceat(word_sum[ids], windows, dtype=float) * share + bias[1] - bias[0]
            total = np.add.reduceat(np.logaddexp(0, z), firsts)
            # loss: -log(1 - exp(-total)) for toxic texts, total for the others
            by_total = balance[docs] * np.where(y[docs] > 0, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-9), 1.0) / len(y)
            by_z = np.repeat(by_total, per[docs]) / (1 + np.exp(-np.clip(z, -50, 50)))
            by_word += np.bincount(ids, np.repeat(by_z * share, width), len(sizes))
            by_bias += by_z.sum()
        by_scalar = np.zeros(len(used))
        for a, b in vocabulary:
            part = gram[starts[a] : starts[b - 1] + sizes[b - 1]]
            by_scalar += np.bincount(part, np.repeat(by_word[a:b], sizes[a:b]), len(used))
        by_slope = by_scalar @ table_
        grads = [np.outer(by_scalar, slope).astype(np.float32) + decay * table_, np.stack([-by_slope, by_slope]) + decay * head, np.array([-by_bias, by_bias])]
        for p, g, m, v in zip(parameters, grads, first_moment, second_moment):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-10)).astype(p.dtype)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = table_ @ (head[1] - head[0]).astype(np.float32)
    return Model(weight, float(bias[1] - bias[0]))


def _held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of docs that are not held out, `sample` of each class at most (by the ids' hashes)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~_held_out())
    counts = dict(known.groupBy("toxic").count().collect()) if known is not None else {}
    parts = []
    for kind in (0, 1):
        share = min(1.0, sample / max(1, counts.get(kind, 0)))
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
        # a little more than the share, then the least hashes: the same rows in every run
        parts.append(known.where((F.col("toxic") == kind) & (place < int(min(1.0, 1.2 * share) * 1_000_000))).orderBy(place, "doc_id").limit(sample))
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    got = sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1] or ""))
    return fit([r[1] for r in got], [r[2] for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(s >= THRESHOLD) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, every column as it was."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([held.value.score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


SQL = None
