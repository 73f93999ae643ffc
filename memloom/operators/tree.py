"""Trees of any depth as interval labels: descendants, cascades, listings and subtree depths without recursion.

A node's label is [low, high]: its place in preorder (siblings by id) and that of its last descendant, so a
subtree is a range. Ancestors are found by pointer doubling, 2^r levels after r rounds. A tree of at most SHALLOW
levels sorts its paths; a deeper one ranks its Euler tour as a linked list: every SPLIT-th element stands for the
stretch behind it, stretches are measured by doubling, and the list of those elements is ranked the same way. Rounds
grow with the logarithm of depth or size. Places come from a sort by range, so no parent, root or level is one task's
work. Nodes on a cycle, or below one, have no label and are reported by `cycles`.

Defined results: a node whose parent isn't in the table is a root; null ids are left out; an id that repeats counts
once, with the least of its parents; an empty table gives no rows.
"""

from __future__ import annotations

from memloom.sources.shared import cut
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHALLOW, SPLIT, BLOCK_BITS = 32, 32, 16


def numbered(rows: DataFrame, *order: str, to: str = "place") -> DataFrame:
    """rows with their place from 0 in the whole order: a sort by range, and one sum for each range."""
    own = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    own = own.withColumns({"__part": F.shiftrightunsigned("__m", 33), "__at": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = own.groupBy("__part").agg(F.max("__at").alias("__last"))  # one row for each range
    before = F.coalesce(F.sum(F.col("__last") + 1).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(sizes.select("__part", before.alias("__before")), "__part").withColumn(to, F.col("__before") + F.col("__at")).drop("__m", "__part", "__at", "__before")


def _plain(nodes: DataFrame) -> DataFrame:
    """id, parent (null for roots), one row an id."""
    own = nodes.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.col("parent").cast("long")).alias("parent"))
    known = own.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return cut(own.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent")))


def ancestors(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """(id, top, depth, up), and whether up is there: the root of every node that has one, its depth, and its path upwards in trees of at most SHALLOW levels."""
    return _climbed(_plain(nodes))


def _climbed(plain: DataFrame) -> tuple[DataFrame, bool]:
    now = cut(plain.select("id", F.col("parent").alias("next"), F.coalesce(F.col("parent"), F.col("id")).alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.array("id").alias("up")))
    left, shallow, rounds = now.where("next IS NOT NULL").count(), True, 1
    while left:
        if rounds > SHALLOW.bit_length():  # paths of more levels are not carried along
            shallow = False
        jump = now.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("top").alias("t2"), F.col("depth").alias("d2"), F.col("up").alias("u2"))
        met = now.join(jump, "next", "left")
        has = F.col("next").isNotNull()
        now = cut(
            met.select(
                "id",
                F.col("n2").alias("next"),
                F.when(has, F.col("t2")).otherwise(F.col("top")).alias("top"),
                (F.col("depth") + F.when(has, F.col("d2")).otherwise(0)).alias("depth"),
                (F.when(has, F.concat("up", "u2")).otherwise(F.col("up")) if shallow else F.array("id")).alias("up"),
            )
        )
        still = now.where("next IS NOT NULL").count()
        if still == left:  # a level that exists would have been reached: what is left has no root
            break
        left, rounds = still, rounds + 1
    return now.where("next IS NULL").drop("next"), shallow


def cycles(nodes: DataFrame) -> DataFrame:
    """(id) of the nodes that no root reaches: on a cycle of parents or below one."""
    plain = _plain(nodes)
    return plain.select("id").join(_climbed(plain)[0], "id", "left_anti")


def ranked(links: DataFrame) -> DataFrame:
    """(e, rank): how many elements follow each element e of linked lists (e, next; null: the last one)."""
    if links.limit(4 * SPLIT).count() < 4 * SPLIT:
        stands = F.lit(True)
    else:
        stands = F.pmod(F.xxhash64("e", F.lit("list")), F.lit(SPLIT)) == 0
    marked = cut(links.select("e", "next", stands.alias("stands")))
    if not marked.where("NOT stands").limit(1).count():
        return _doubled(marked.select("e", "next"))
    steps = marked.join(marked.select(F.col("e").alias("next"), F.col("stands").alias("s2")), "next", "left")
    # to: the next standing element (null: none follows); open while the walk is under way
    now = cut(steps.select("e", F.col("next").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("far"), (F.col("next").isNotNull() & ~F.col("s2")).alias("open")))
    while now.where("open").limit(1).count():
        jump = now.select(F.col("e").alias("to"), F.col("to").alias("t2"), F.col("far").alias("f2"), F.col("open").alias("o2"))
        moved = now.where("open").join(jump, "to").select("e", F.col("t2").alias("to"), (F.col("far") + F.col("f2")).alias("far"), F.col("o2").alias("open"))
        now = cut(now.where("NOT open").unionByName(moved))
    heads = now.join(marked.where("stands").select("e"), "e", "left_semi").select("e", F.col("to").alias("next"), "far")
    outer = _weighted(heads)
    return now.join(outer.withColumnRenamed("e", "to"), "to", "left").select("e", (F.col("far") + F.coalesce("rank", F.lit(0))).alias("rank"))


def _doubled(links: DataFrame) -> DataFrame:
    return _weighted(links.select("e", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("far")))


def _weighted(links: DataFrame) -> DataFrame:
    """(e, rank) of lists whose steps (e, next) are far long: doubling until every pointer is at an end."""
    now = cut(links.select("e", "next", F.col("far").alias("rank")))
    while now.where("next IS NOT NULL").limit(1).count():
        jump = now.select(F.col("e").alias("next"), F.col("next").alias("n2"), F.col("rank").alias("r2"))
        now = cut(now.join(jump, "next", "left").select("e", F.col("n2").alias("next"), (F.col("rank") + F.coalesce("r2", F.lit(0))).alias("rank")))
    return now.select("e", "rank")


def _toured(nodes: DataFrame) -> DataFrame:
    """(id, low, high) of a forest by its Euler tour: node v is entered as 2v and left as 2v + 1 (of its number)."""
    placed = cut(numbered(nodes.select("id", "parent"), "parent", "id", to="v"))  # roots first, siblings side by side
    up = placed.join(placed.select(F.col("id").alias("parent"), F.col("v").alias("pv")), "parent", "left").select("id", "v", "pv")
    first = up.where("pv IS NOT NULL").groupBy(F.col("pv").alias("v")).agg(F.min("v").alias("child"))
    beside = up.select((F.col("v") - 1).alias("v"), F.col("v").alias("sibling"), F.col("pv").alias("sp"))
    known = cut(up.join(first, "v", "left").join(beside, "v", "left"))
    enter = known.select((F.col("v") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("v") * 2 + 1).alias("next"))
    leave = known.select((F.col("v") * 2 + 1).alias("e"), F.when(F.col("sp").eqNullSafe(F.col("pv")) & F.col("sibling").isNotNull(), F.col("sibling") * 2).otherwise(F.col("pv") * 2 + 1).alias("next"))
    after = cut(ranked(enter.unionByName(leave)))
    order = after.where("e % 2 = 0").select((F.col("e") / 2).cast("long").alias("v"), F.col("rank").alias("behind")).join(after.where("e % 2 = 1").select(((F.col("e") - 1) / 2).cast("long").alias("v"), F.col("rank").alias("rest")), "v")
    # between entering and leaving a node lie two elements for each of its descendants
    sized = order.join(known.select("v", "id"), "v").select("id", "behind", ((F.col("behind") - F.col("rest") + 1) / 2).cast("long").alias("size"))
    return numbered(sized.withColumn("at", -F.col("behind")), "at", to="low").select("id", "low", (F.col("low") + F.col("size") - 1).alias("high"))


def label(nodes: DataFrame) -> DataFrame:
    """(id, parent, top, depth, low, high) of every node of a forest (id, parent) that a root reaches."""
    plain = _plain(nodes)
    found, shallow = _climbed(plain)
    reached = plain.join(found.select("id", "top", "depth", "up"), "id")
    if shallow:
        paths = cut(reached.withColumn("path", F.reverse("up")))
        below = paths.select(F.explode("up").alias("id")).groupBy("id").agg(F.count("*").alias("size"))
        low = numbered(paths.select("id", "parent", "top", "depth", "path"), "path", to="low")
        return cut(low.join(below, "id").select("id", "parent", "top", "depth", "low", (F.col("low") + F.col("size") - 1).alias("high")))
    return cut(reached.select("id", "parent", "top", "depth").join(_toured(reached), "id").select("id", "parent", "top", "depth", "low", "high"))


def descendants(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, level): every node in the subtree of each root (root), itself at level 0; nested roots each have their own rows.

    A range join by equal keys: subtrees are told apart by the power of two of their size, up to 2^BLOCK_BITS; one
    covers two blocks of that width, a larger one as many as it has, and nodes take part once for each power that occurs.
    """
    asked = roots.select("root").distinct().join(labels.select(F.col("id").alias("root"), F.col("low").alias("l"), F.col("high").alias("h"), F.col("depth").alias("d")), "root")
    bits = F.least(F.lit(BLOCK_BITS), F.ceil(F.log2(F.col("h") - F.col("l") + 1))).cast("int")
    asked = cut(asked.withColumn("bits", bits))
    kinds = [r.bits for r in asked.select("bits").distinct().collect()]  # BLOCK_BITS + 1 at most
    if not kinds:
        return asked.select("root", F.col("root").alias("id"), F.col("d").alias("level")).limit(0)
    shift = lambda c: F.expr(f"shiftright({c}, bits)")
    blocks = asked.withColumn("block", F.explode(F.sequence(shift("l"), shift("h"))))
    cells = labels.select("id", "low", "depth", F.explode(F.array(*[F.lit(b) for b in sorted(kinds)])).alias("bits")).withColumn("block", shift("low"))
    return blocks.join(cells, ["bits", "block"]).where("low BETWEEN l AND h").select("root", "id", (F.col("depth") - F.col("d")).alias("level"))


def removed(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of all nodes that go when the roots (root) are deleted with what hangs below them."""
    return descendants(labels, roots).select("id").distinct()


def lineages(labels: DataFrame, deepest: int | None = None) -> DataFrame:
    """(id, path array from the root to the node, depth), for nodes down to a depth if one is given; its size is that of all paths."""
    kept = labels if deepest is None else labels.where(F.col("depth") <= deepest)
    pairs = descendants(kept, kept.select(F.col("id").alias("root")))
    path = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("level", "root")))), lambda s: s["root"])
    return pairs.groupBy("id").agg(path.alias("path")).join(kept.select("id", "depth"), "id").select("id", "path", "depth")
