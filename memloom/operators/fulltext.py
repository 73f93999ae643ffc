"""Full-text search over a stored inverted index: all words first, any word where nothing holds all of them.

Documents are numbered by id, so a larger number is newer. A row of the index is one term in one block of 2^BITS
neighbouring documents: how many hold it, the greatest count in one, and, in columns of their own, which and how often.
Blocks lie at the same documents for every term. Searches first meet the two numbers alone: for AND, the blocks of the
rarest word that hold the others too; for OR, the sum of the words' greatest scores in a block, an upper bound for each
of its documents. The blocks of the best bounds are scored, their k-th score closes all blocks below it, and the rest is
scored as well, so results are exact and a frequent word's list is read only in blocks that can still matter.

A word in a document scores 2 w tf div (tf + 1) with w = round(256 ln(1 + documents / documents with it)).

Defined results: words are runs of letters, digits and _ in lower case; null texts and queries without words find
nothing; words that no document holds count for confidence and rule out AND; a repeated query row answers once per id
(its words together); repeated document rows are documents of their own, those of one id in order of their text's hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from memloom.operators.tree import numbered
from memloom.sources.shared import cut
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS, SEEDS = 12, 2
WORD = r"[\p{L}\p{N}_]+"


@dataclass
class Index:
    """documents (doc, id), postings (term, block, n, most, at array, tf array), terms (term, df)."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    bits: int


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def build(docs: DataFrame, path: str, bits: int = BITS) -> Index:
    """Index of docs (id, text), written under path."""
    placed = numbered(docs.select("id", "text", F.xxhash64("text").alias("mark")), "id", "mark", to="doc")
    placed.select("doc", "id").write.mode("overwrite").parquet(f"{path}/documents")
    said = placed.select("doc", F.explode(words("text")).alias("term")).groupBy("doc", "term").agg(F.count("*").cast("int").alias("tf"))
    said = said.select("term", F.shiftright("doc", bits).alias("block"), F.col("doc").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("at"), "tf")
    rows = said.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.array_sort(F.collect_list(F.struct("at", "tf"))).alias("p"))  # 2^bits places at most
    rows = rows.select("term", "block", "n", "most", F.col("p.at").alias("at"), F.col("p.tf").alias("tf"))
    rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    return load(spark, path, bits)


def load(spark: SparkSession, path: str, bits: int = BITS) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("documents", "postings", "terms")), bits)


def _score(weight: str, tf: str | Column) -> Column:
    tf = F.col(tf) if isinstance(tf, str) else tf
    return F.floor(2 * F.col(weight) * tf / (tf + 1)).cast("long")


def asked(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, words, df, w): the distinct words of each query; df and w null for words of no document."""
    said = queries.select("qid", F.explode(words("text")).alias("term")).distinct()
    said = said.join(said.groupBy("qid").agg(F.count("*").alias("words")), "qid").join(index.terms, "term", "left")
    total = index.documents.count()
    return cut(said.select("qid", "term", "words", "df", F.round(256 * F.log(1 + F.lit(float(total)) / F.col("df"))).cast("long").alias("w")))


def _heads(index: Index) -> DataFrame:
    return index.postings.select("term", "block", "n", "most")


def blocks_with_all(index: Index, said: DataFrame) -> DataFrame:
    """(qid, block) where every word of the query occurs, from the blocks of its rarest one; lists themselves are not read."""
    full = said.groupBy("qid", "words").agg(F.count("df").alias("known"), F.min_by("term", F.struct("df", "term")).alias("term")).where("known = words")
    begun = full.join(_heads(index), "term").select("qid", "block", "words")
    met = begun.join(said.select("qid", "term"), "qid").join(_heads(index).select("term", "block"), ["term", "block"])
    return met.groupBy("qid", "block", "words").agg(F.count("*").alias("found")).where("found = words").select("qid", "block")


def _all_words(index: Index, said: DataFrame, k: int) -> DataFrame:
    lists = blocks_with_all(index, said).join(said.select("qid", "term"), "qid").join(index.postings.select("term", "block", "n", "at"), ["term", "block"])
    both = lists.groupBy("qid", "block").agg(F.array_sort(F.collect_list(F.struct("n", "at"))).alias("ls"))  # a list for each word, the shortest first
    common = F.aggregate(F.slice("ls", 2, F.size("ls")), F.col("ls")[0]["at"], lambda a, x: F.array_intersect(a, x["at"]))
    hits = both.select("qid", "block", F.explode(common).alias("at")).select("qid", (F.shiftleft("block", index.bits) + F.col("at")).alias("doc"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("doc")))).where(F.col("rank") <= k)


def bounds(index: Index, said: DataFrame) -> DataFrame:
    """(qid, block, bound): no document of the block scores more; from the two numbers of each list's block."""
    heads = said.where("df IS NOT NULL").join(_heads(index).select("term", "block", "most"), "term")
    return heads.groupBy("qid", "block").agg(F.sum(_score("w", "most")).alias("bound"))


def _scored(index: Index, said: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, doc, score, hits) of all documents in the blocks (qid, block) that hold a word."""
    lists = blocks.join(said.select("qid", "term", "w"), "qid").join(index.postings.select("term", "block", "at", "tf"), ["term", "block"])
    each = lists.select("qid", "block", "w", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("qid", (F.shiftleft("block", index.bits) + F.col("p.at")).alias("doc"), _score("w", F.col("p.tf")).alias("s"))
    return each.groupBy("qid", "doc").agg(F.sum("s").alias("score"), F.count("*").alias("hits"))


def open_blocks(index: Index, said: DataFrame, k: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """The scored documents of each query's best blocks, and its other blocks (qid, block) whose bound reaches their k-th score."""
    every = cut(bounds(index, said).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), F.desc("block")))))
    best = cut(_scored(index, said, every.where(F.col("n") <= seeds).select("qid", "block")))
    kth = best.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("n") == k).select("qid", F.col("score").alias("kth"))
    rest = every.where(F.col("n") > seeds).join(kth, "qid", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0)))  # an equal score may be newer
    return best, rest.select("qid", "block")


def search(index: Index, queries: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, mode, score, confidence, rank) for queries (qid, text).

    Mode 'and': the k newest documents with all words. Where there is none, mode 'or': the k best scores, ties to the newer.
    confidence: the share of the query's words that the document holds, 4 places.
    """
    said = asked(index, queries)
    exact = cut(_all_words(index, said, k))
    weights = said.groupBy("qid").agg(F.first("words").alias("words"))
    found = exact.select("qid", "doc", F.lit("and").alias("mode"), F.lit(None).cast("long").alias("score"), F.lit(1.0).alias("confidence"), "rank")
    open_ = cut(said.join(exact.select("qid").distinct(), "qid", "left_anti"))
    best, rest = open_blocks(index, open_, k)
    scored = best.unionByName(_scored(index, open_, rest)).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc")))).where(F.col("rank") <= k)
    loose = scored.join(weights, "qid").select("qid", "doc", F.lit("or").alias("mode"), "score", F.round(F.col("hits") / F.col("words"), 4).alias("confidence"), "rank")
    return found.unionByName(loose).join(index.documents, "doc").select("qid", "id", "mode", "score", "confidence", "rank")
