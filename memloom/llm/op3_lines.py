"""Line dedup by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its space-separated tokens, ordered by rarity: occurrences are counted over the whole
corpus in CELLS hash cells, and tokens are sorted by the power of two of their cell's count, then by hash
(any one order gives exact results; this one puts rare tokens first without a join on every token). Lines of
equal sets form classes before anything is joined, so copies meet no copies.

Two sets of sizes a, b with Jaccard >= 0.8 share o >= 4(a + b)/9 tokens and differ in d = a + b - 2o. Each
differing token parts at most two triples of tokens that are neighbours in the common order, so o - 2 - 2d
triples are common as well: at least one, but for sets of 4 and 5 tokens, which meet by all 4. The prefix filter
works on these triples: it indexes the first ones of each line, as many as that bound asks for. A triple of
neighbours is far rarer than a token, so lists stay short when the corpus outgrows its vocabulary. Keys that only
one line has are dropped at once.
The length filter, the positional filter (what can follow the first common triple) and a map of 128 parities of
tokens (each differing token flips one bit) leave the candidates. Their lines are read again
from the documents, and Jaccard is verified on the tokens themselves.

A line is removed if an earlier line (smaller doc_id, or the same document and a smaller line number),
removed or not, is similar. One earlier match decides, so each line first meets the earliest line and the NEAR lines
before it in its keys' lists, and the one whose map of parities differs least is verified. Lines that find
no match there are held against the others of these; lists longer than that are joined with all their earlier lines, where the
join itself compares lengths and those maps. There a pair that shares many keys meets once for nearly all of them: it is left
out at a key if the keys before it (the last, the least or the greatest of those in long lists) are equal, for it meets at
these as well. Large groups of similar lines thus cost a few comparisons a line. A key of more than
SPLIT lines is dealt out in blocks. Small tables are sent to every task (common.light)
instead of dealing out the other side.

Defined results: null text has no lines; a line without tokens stays and matches nothing; rows that
repeat doc_id and text are one position and don't remove each other; different texts of one doc_id are
ordered by their hash; a null doc_id counts as the least one; an empty table gives no rows; other columns
are ignored (lines) or kept (dedupe).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, light, table

CELLS = 1 << 16
SPLIT = 4096
#: Lines before it in a key's list that a line is held against at once.
NEAR = 12
_HASH = 58
#: A map of 128 bits, of which each token flips one: bits that differ between two lines are at most the tokens that do.
PARITY = {"p0": 0, "p1": 64}
#: A posting is one number: place of the line, its size (at most SIZE) and the triple's place in it (at most PLACE).
SIZE, PLACE = 127, 31
_LEAST = -(1 << 63)


def _levels(base: DataFrame) -> tuple[list[int], int, int, int]:
    """Power of two of each hash cell's count, least and greatest __id, and a number no text has more lines than.

    The table that comes to the driver has CELLS rows at most. Words that only a line break parts count as one here:
    the order needs no more, and lines are split before their tokens are.
    """
    word = base.select(F.explode(F.split("text", " ")).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell"))
    out = [0] * CELLS
    for r in word.groupBy("cell").count().collect():
        out[r["cell"]] = r["count"].bit_length()
    least, most, size = base.agg(F.min("__id"), F.max("__id"), F.max(F.octet_length("text"))).first()
    return out, least or 0, most or 0, (size or 0) + 1


def _tokens(line: str, levels: list[int]) -> str:
    """Sorted distinct token codes of a line: level, then hash."""
    level = f"CAST(from_json('{json.dumps(levels, separators=(',', ':'))}', 'ARRAY<TINYINT>')[CAST(xxhash64(w) & {CELLS - 1} AS INT)] AS LONG)"
    return f"sort_array(array_distinct(transform(array_remove(split({line}, ' '), ''), w -> shiftleft({level}, {_HASH}) | (xxhash64(w) & {(1 << _HASH) - 1}))))"


#: Tokens of the prefix: two more than its triples, which are the first n - 1 - max(1, ceil(2s / 9) - 2) for s = n + ceil(4n / 5).
_PREFIX = "IF(n < 4, null, slice(toks, 1, n + 1 - greatest(1, (2 * (n + (4 * n + 4) div 5) + 8) div 9 - 2)))"
_KEY = f"& {(1 << 48) - 1}"


_PARITY = [f"IF(n < 4, 0L, aggregate(toks, 0L, (m, x) -> IF((x & 64) = {half}, m ^ shiftleft(1L, CAST(x & 63 AS INT)), m))) AS {name}" for name, half in PARITY.items()]


_DIFFER = " + ".join(f"bit_count(x_{m} ^ y_{m})" for m in PARITY)
#: Filters of a pair that shares a key: by length, by what can follow the key if it is the first common one (of any similar
#: pair, one key passes), by the bits of their maps that differ.
_CLOSE = f"5 * least(x_n, y_n) >= 4 * greatest(x_n, y_n) AND 1 + least(x_n - 3 - x_at, y_n - 3 - y_at) >= 5 * ((4 * (x_n + y_n) + 8) div 9) - 2 * (x_n + y_n) - 2 AND 9 * ({_DIFFER}) <= x_n + y_n"


def _identified(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with __id (null: the least number) and __mark (the text's hash if some id repeats, else 0), and whether some id repeats."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    twice = docs.select(own.alias("id")).groupBy("id").count().where("count > 1").limit(1).count() > 0
    return docs.withColumns({"__id": own, "__mark": (F.coalesce(F.xxhash64("text"), F.lit(0)) if twice else F.lit(0)).cast("long")}), twice


def _postings(lines: DataFrame) -> DataFrame:
    """key and v of each triple of the prefix; a line of 5 tokens also has each 4 of them, to meet the line of these."""
    triples = lines.where("n > 4").select("id", "prefix", F.posexplode("prefix").alias("at", "tok")).where("at < size(prefix) - 2")
    triples = triples.selectExpr(f"xxhash64(tok, get(prefix, at + 1), get(prefix, at + 2)) {_KEY} AS key", f"id * {PLACE + 1} + least(at, {PLACE}) AS v")
    fours = lines.where("n <= 5").selectExpr("id", "explode(IF(n = 4, array(xxhash64(prefix)), transform(prefix, t -> xxhash64(array_remove(prefix, t))))) AS key")
    return triples.unionByName(fours.selectExpr(f"key {_KEY} AS key", f"id * {PLACE + 1} AS v"))


def _shared(lines: DataFrame) -> DataFrame:
    """Postings (key, v) of keys that more lines have, the number m of their list, that of the blocks it is dealt out in, and the earliest and the NEAR postings before them there.

    Postings that meet nothing are left out: those with none before them, but for long lists, whose every posting _met reads.
    """
    p = _postings(lines).repartition("key")  # dealt out and read once; a sort by this one number is all that the counts need
    shared = p.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")
    shared = shared.withColumn("blocks", F.expr(f"IF(m > 3, m div {SPLIT} + 1, 1L)")).withColumn("block", F.pmod(F.xxhash64("v"), "blocks"))
    order = Window.partitionBy("key", "block").orderBy("v")
    before = F.array_compact(F.array(F.first("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), *[F.lag("v", k).over(order) for k in range(1, NEAR + 1)]))
    return cut(shared.withColumn("before", before).where(f"m > {NEAR + 1} OR blocks > 1 OR size(before) > 0"), "zstd")


#: Size and place in a posting; sizes from SIZE on are one number there, so the length filter may let more pairs pass than _CLOSE.
_ALIKE = "5 * least(x_n, y_n) >= 4 * greatest(x_n, y_n)"
_FOLLOW = f"(greatest(x_n, y_n) = {SIZE} OR 1 + least(x_n - 3 - x_at, y_n - 3 - y_at) >= 5 * ((4 * (x_n + y_n) + 8) div 9) - 2 * (x_n + y_n) - 2)"


def _verified(pairs: DataFrame, reps: DataFrame, base: DataFrame) -> DataFrame:
    """The distinct x of the pairs (x, y) of line ids whose token sets are similar, judged on the tokens themselves."""
    pairs = cut(pairs.select("x", "y"))
    needed = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    wanted = reps.select("id", "__id", "__mark", "line").join(needed, "id").groupBy("__id", "__mark").agg(F.collect_list(F.struct("id", "line")).alias("wanted"))
    wanted = cut(wanted)
    split = base.join(light(wanted), ["__id", "__mark"]).select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
    sets = cut(split.select("w.id", F.expr("array_distinct(array_remove(split(all[w.line], ' '), ''))").alias("toks")))
    both = pairs.join(sets.select(F.col("id").alias("y"), F.col("toks").alias("ty")), "y").join(sets.select(F.col("id").alias("x"), F.col("toks").alias("tx")), "x")
    out = cut(both.where("9 * size(array_intersect(tx, ty)) >= 4 * (size(tx) + size(ty))").select("x").distinct())
    discard(pairs, wanted, sets)
    return out


def _similar_to_earlier(reps: DataFrame, base: DataFrame) -> list[DataFrame]:
    """Tables of x: ids of the lines of reps that are similar to an earlier one."""
    shared = _shared(reps)
    small = reps.select("id", "n", *PARITY)
    posting = [f"{c}.v div {PLACE + 1} AS {c}" for c in "xy"] + [f"{c}.v % {PLACE + 1} AS {c}_at" for c in "xy"] + [f"{c}.v div {PLACE + 1} % {SIZE + 1} AS {c}_n" for c in "xy"]
    met = shared.select(F.struct("v").alias("x"), F.explode("before").alias("y")).select("x", F.struct(F.col("y").alias("v")).alias("y")).selectExpr(*posting)
    alike = cut(met.where(f"y < x AND {_ALIKE} AND {_FOLLOW}").select("x", "y").distinct())
    side = lambda c: small.select(F.col("id").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("n", *PARITY)])
    met = alike.join(side("x"), "x").join(side("y"), "y").where(f"{_ALIKE} AND 9 * ({_DIFFER}) <= x_n + y_n")
    near = cut(met.select("x", "y", F.expr(_DIFFER).alias("d")))
    best = cut(near.groupBy("x").agg(F.min_by("y", F.struct("d", "y")).alias("y")))
    matched = _verified(best, reps, base)
    long = shared.where(f"m > {NEAR + 1} OR blocks > 1").withColumn("id", F.expr(f"v div {PLACE + 1}"))
    long = cut(long.join(small, "id").select("key", "v", "m", "blocks", "block", "n", *PARITY), "zstd")
    others = near.join(matched, "x", "left_anti").join(best, ["x", "y"], "left_anti").select("x", "y")
    rest = _verified(others.unionByName(_met(long, matched)).distinct(), reps, base)
    discard(shared, long, alike, near, best)
    return [matched, rest]


def _met(shared: DataFrame, matched: DataFrame) -> DataFrame:
    """Pairs (x, y) of an unmatched line and an earlier one that is close to it, both in one of the lists that are longer than what a line meets at once."""
    order = Window.partitionBy("id").orderBy("v", "key")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    long = shared.where(f"m > {NEAR + 1} OR blocks > 1").withColumn("id", F.expr(f"v div {PLACE + 1}"))
    long = cut(long.withColumns({"last": F.lag("key").over(order), "low": F.min("key").over(earlier), "high": F.max("key").over(earlier)}), "zstd")
    names = ("n", *PARITY, "last", "low", "high")
    side = lambda c: long.select("key", "block", "blocks", "id", F.col("id").alias(c), F.expr(f"v % {PLACE + 1}").alias(f"{c}_at"), *[F.col(k).alias(f"{c}_{k}") for k in names])
    left = side("x").join(light(matched).withColumnRenamed("x", "id"), "id", "left_anti").drop("id", "blocks")
    every = side("y").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("id", "blocks")
    first = " AND ".join(f"NOT coalesce(x_{k} = y_{k}, false)" for k in ("last", "low", "high"))
    return left.join(every, ["key", "block"]).where(f"y < x AND {_CLOSE} AND {first}").select("x", "y")


def _placed(base: DataFrame, twice: bool) -> DataFrame:
    """__id, __mark, line (number from 0), words, place (in order of the documents and their lines) and toks of each line with a token."""
    levels, least, most, width = _levels(base)
    split = lambda df: df.select("__id", "__mark", F.posexplode(F.split("text", "\n")).alias("line", "words")).where("ltrim(words) <> ''")
    if not twice and (most - least + 1) * width * (SIZE + 1) * (PLACE + 1) < 1 << 63:
        place = (F.col("__id") - F.lit(least).cast("long")) * F.lit(width).cast("long") + F.col("line")
        lines = split(base)
    else:
        # Numbers that Spark gives to rows in order of the documents.
        place = F.monotonically_increasing_id()
        lines = split(base.repartitionByRange("__id", "__mark").sortWithinPartitions("__id", "__mark"))
    return lines.select("__id", "__mark", "line", place.alias("place"), F.expr(_tokens("words", levels)).alias("toks"))


def removals(docs: DataFrame, twice: bool) -> DataFrame:
    """Per document (__id, __mark) with removed lines: removed array<int> (line numbers from 0)."""
    base = docs.where("text IS NOT NULL").select("__id", "__mark", "text")
    base = base.dropDuplicates(["__id", "__mark"]) if twice else base
    lines = _placed(base, twice).withColumn("n", F.size("toks"))
    wide = cut(lines.selectExpr("__id", "__mark", "line", f"place * {SIZE + 1} + least(n, {SIZE}) AS id", "n", "xxhash64(toks) AS k1", "hash(toks) AS k2", f"{_PREFIX} AS prefix", *_PARITY), "zstd")
    dups = cut(wide.groupBy("k1", "k2", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    spot = ("__id", "__mark", "line")
    copies = cut(wide.join(light(dups), ["k1", "k2", "n"]).where("id <> first").select(*spot))
    reps = cut(wide.where("prefix IS NOT NULL").join(light(dups), ["k1", "k2", "n"], "left").where("first IS NULL OR id = first").select(*spot, "id", "prefix", "n", *PARITY), "zstd")
    discard(wide, dups)
    late = _similar_to_earlier(reps, base)
    found = late[0].unionByName(late[1]).distinct().withColumnRenamed("x", "id")
    gone = copies.unionByName(reps.select(*spot, "id").join(found, "id").select(*spot))
    out = cut(gone.groupBy("__id", "__mark").agg(F.sort_array(F.collect_set("line")).alias("__removed")))
    discard(copies, reps, *late)
    return out


def dedupe(docs: DataFrame) -> DataFrame:
    """docs with the removed lines taken out of text and n_chars, where there is one, set anew; every other column as it was."""
    names = docs.columns
    out, twice = _identified(docs)
    kept = "IF(__removed IS NULL, text, array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(__removed, i)), '\\n'))"
    # Texts are dealt out once and not sorted, whatever the size: a table of removals that is sent to every task at one size is too large for it at another.
    out = out.join(removals(out, twice).hint("shuffle_hash"), ["__id", "__mark"], "left").withColumn("text", F.expr(kept))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: its lines, how many are removed, and their numbers."""
    rows, twice = _identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    lines = rows.select("__id", "__mark", "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    return lines.join(removals(rows, twice), ["__id", "__mark"], "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("__removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, k, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS s FROM l),
c AS (SELECT s, min((doc_id, k)) AS id, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s),
w AS (SELECT id, n, unnest(s) AS w FROM c),
f AS (SELECT w, count(*) AS df FROM w GROUP BY w),
r AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS pos FROM w JOIN f USING (w)),
p AS (SELECT * FROM r WHERE pos <= n - ((4 * n + 4) // 5) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
v AS (SELECT a, b FROM cand JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
k AS (SELECT DISTINCT b AS id FROM v),
h AS (SELECT t.doc_id, t.k, (t.doc_id, t.k) <> c.id OR k.id IS NOT NULL AS gone FROM t JOIN c ON t.s = c.s LEFT JOIN k ON k.id = c.id),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (gone) AS removed FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
coalesce(g.removed, '') AS removed_lines FROM documents d LEFT JOIN g USING (doc_id)
"""
