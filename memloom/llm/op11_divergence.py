"""Source divergence audit over an integer dictionary of terms.

Documents are counted in Arrow batches: terms get integers of the batch's own dictionary, pairs of document and
term are sorted as integers, and one row per language, source and term leaves a task. Rows of terms that enough
documents of the language hold are sorted by range, so that places in the order are global integer ids, in the
order of UTF-8 bytes. Ids are dealt into chunks of so many terms that a dense table of all sources stays within
`cells` numbers; a task looks up its chunk's terms by searchsorted, fills one count vector per source by bincount
and works on whole vectors. Each chunk returns sums for pairs of sources and its best terms; Spark adds the sums
and merges the best. Neither a dictionary nor the list of sources is ever broadcast or collected.

Defined results: null text, lang and source are ''; groups without terms take part in pairs with their smoothed
shares; a language without kept terms has pairs of value 0 and no terms; a repeated row counts as another document;
equal values are ordered by item; an empty table gives no rows; other columns are ignored. All arithmetic is exact
while a value fits 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LEAST_DOCS, UNIT, TOP, CELLS = 3, 10**9, 200, 1 << 19
_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text counted at a time, and of counts that a task holds after it has merged them.
_SLICE, _HELD = 1 << 20, 8 << 20
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _count(part: pa.RecordBatch) -> pa.Table:
    """One row per language, source and term of these documents, and one of term '' for each group."""
    lang, source = pc.dictionary_encode(part["lang"]), pc.dictionary_encode(part["source"])
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    words = pc.split_pattern_regex(pc.ascii_lower(part["text"]), _GAP)
    sizes = np.diff(words.offsets.to_numpy())
    terms = pc.dictionary_encode(words.flatten())
    ids, width = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    pairs, n = np.unique(doc * width + ids, return_counts=True)  # a row per document and term
    keys, at = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)
    docs = np.bincount(at, minlength=len(keys))
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, n)
    seen = np.unique(group)
    of = np.concatenate([keys // max(1, width), seen])
    word = pa.concat_arrays([terms.dictionary.take(pa.array(keys % max(1, width))), pa.array([""] * len(seen), pa.string())])
    columns = [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), word]
    zero = np.zeros(len(seen), np.int64)
    found = pa.table([*columns, pa.array(np.concatenate([total, zero])), pa.array(np.concatenate([docs, zero]))], schema=_COUNTS)
    real = np.concatenate([pc.not_equal(terms.dictionary, "").to_numpy(zero_copy_only=False)[keys % max(1, width)], np.ones(len(seen), bool)])
    return found.filter(pa.array(real))


def _merge(tables: list[pa.Table]) -> pa.Table:
    merged = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return merged.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTS.names)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of one task, merged while they fit `_HELD`."""
    pool = pa.default_memory_pool()
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:  # about 1 MB of text at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, side="right")))
            held.append(_count(batch.slice(at, to - at)))
            size += held[-1].nbytes
            at = to
            if size > 2 * _HELD:
                held = [_merge(held)]
                size = held[0].nbytes
                if size > _HELD:
                    yield from held.pop().to_batches(max_chunksize=16384)
                    size = 0
                pool.release_unused()  # else workers that wait keep it beside the executor's heap
    if held:
        yield from _merge(held).to_batches(max_chunksize=16384)
    held.clear()
    pool.release_unused()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences and docs documents, summed per task only; a row of term '' for each group."""

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return plain.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def dictionary(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, source, n, id from 0 in UTF-8 order of a language's terms) and all groups (lang, source).

    Counts meet once, by language and term; what is left is sorted by range and numbered in place, and each range
    learns how many terms lie before it.
    """
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumn("all_docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where((F.col("term") == "") | (F.col("all_docs") >= least_docs))
    counts = cut(counts.select("lang", "term", "source", "n"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, part = (None, None), -1, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term = batch["lang"], batch["term"]
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.not_equal(term.slice(1), term.slice(0, len(term) - 1))).to_numpy(zero_copy_only=False)
            fresh[0] = (lang[0].as_py(), term[0].as_py()) != last
            places = place + np.cumsum(fresh)
            last, place = (lang[-1].as_py(), term[-1].as_py()), int(places[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(np.full(len(places), part, np.int32))], [*batch.schema.names, "place", "part"])

    ordered = counts.where("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    ordered = cut(ordered.mapInArrow(number, "lang string, term string, source string, n long, place long, part int"))
    ranges = ordered.groupBy("lang", "part").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    before = F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ordered.join(ranges.select("lang", "part", (before - F.col("low")).alias("shift")), ["lang", "part"]).select("lang", "term", "source", "n", (F.col("place") + F.col("shift")).alias("id"))
    return ids, counts.where("term = ''").select("lang", "source")


def share(count: np.ndarray, total: np.ndarray | int, unit: int = UNIT) -> np.ndarray:
    """1 + floor(unit * (count + 1) / total), exactly."""
    if len(count) and int(count.max()) >= 2**62 // unit:
        total = np.broadcast_to(total, count.shape)
        return np.array([1 + unit * (int(c) + 1) // int(t) for c, t in zip(count.ravel(), total.ravel())], np.int64).reshape(count.shape)
    return 1 + unit * (count + 1) // total


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: every group against each other one of its language, and its `top` most over-used terms."""
    kept, groups = dictionary(docs, least_docs)
    kept = kept.select("lang", "term", "source", "n", "id")
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    per_lang = totals.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("total").alias("lang_total"))
    terms = kept.groupBy("lang").agg((F.max("id") + 1).alias("terms"))
    per_lang = per_lang.join(terms, "lang", "left").select("lang", "sources", "lang_total", F.coalesce("terms", F.lit(0)).alias("terms"))
    per_lang = cut(per_lang.withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("sources"))).cast("long")))
    chunked = kept.join(per_lang.select("lang", "width"), "lang").select("lang", "term", "source", "n", "id", F.floor(F.col("id") / F.col("width")).cast("long").alias("chunk"))
    last = F.greatest(F.lit(0), F.ceil(F.col("terms") / F.col("width")) - 1).cast("long")
    # every chunk meets its language's sources: sources x chunks rows, at most sources^2 x terms / cells
    dealt = totals.join(per_lang, "lang").select("lang", "source", "total", "lang_total", F.col("terms").alias("kept"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))

    def chunk(rows: pa.Table, about: pa.Table) -> pa.Table:
        names = about["source"].combine_chunks()
        lang, kept_terms, of_lang = (about[c][0].as_py() for c in ("lang", "kept", "lang_total"))
        # the dictionary of this chunk: its terms in order; rows find their place in it by searchsorted
        number = rows["id"].to_numpy()
        ids, first = np.unique(number, return_index=True)
        of = pc.index_in(rows["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        at, n = np.searchsorted(ids, number), rows["n"].to_numpy()
        counts = np.zeros((len(names), len(ids)), np.int64)
        if n.sum() < 2**52:
            for i in range(len(names)):  # bincount adds doubles: exact below 2^53
                counts[i] = np.bincount(at[of == i], weights=n[of == i], minlength=len(ids))
        else:
            np.add.at(counts, (of, at), n)
        everyone = share(counts.sum(axis=0), of_lang + kept_terms) if len(ids) else np.zeros(0, np.int64)
        p = share(counts, about["total"].to_numpy()[:, None] + kept_terms) if len(ids) else counts
        words, out = rows["term"].combine_chunks().take(pa.array(first)), []
        for i in range(len(names)):
            others = np.delete(np.arange(len(names)), i)
            sums = np.array([int(gain(p[i], p[j]).sum()) for j in others], np.int64)
            over = np.flatnonzero((counts[i] > 0) & (p[i] > everyone))
            f = gain(p[i][over], everyone[over])
            best = np.argsort(-f, kind="stable")[:top]  # equal values stay in order of ids, which is that of UTF-8
            for part, item, value in (("pair", names.take(pa.array(others)), sums), ("term", words.take(pa.array(over[best])), f[best])):
                out.append(pa.table([pa.array([x] * len(value), pa.string()) for x in (lang, names[i].as_py(), part)] + [item, pa.array(value)], schema=_FOUND))
        return pa.concat_tables(out).combine_chunks()

    found = chunked.groupBy("lang", "chunk").cogroup(dealt.groupBy("lang", "chunk")).applyInArrow(chunk, "lang string, source string, part string, item string, value long")
    found = cut(found)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, CAST(coalesce(sum(n) FILTER (WHERE k.term IS NOT NULL), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, term, t.n FROM t JOIN k USING (lang, term)) k USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS c, 1 + 1000000000 * (CAST(coalesce(t.n, 0) AS HUGEINT) + 1) // (g.n + v.v) AS p, 1 + 1000000000 * (k.n + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.s = a.source AND f.o = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
