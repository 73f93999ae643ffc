"""Operators of knowledge upkeep: causal links, quality gates of merges and moves, conflicts, rule judges, mentions, small domains, bulk inserts."""

from __future__ import annotations

from memloom.functions import content, text
from memloom.functions.dialect import SPARK
from memloom.operators import vectors
from memloom.sources.shared import cut
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords and dates that the merge gate looks for, and short words that name no skill.
KEYWORD = "[一-鿿]{2,}|[a-zA-Z]{4,}"
DATE = r"[0-9０-９]{4}[年/-][0-9０-９]{1,2}[月/-]?[0-9０-９]{0,2}"
AMBIGUOUS = ("ai", "ml", "llm", "rag", "api", "agent", "system", "dev", "ops", "data")


def causal_links(units: DataFrame, new: str | None = None, least: float = 0.6) -> DataFrame:
    """Links between members of a group, from each unit that states a cause to every other member.

    units: grp, unit_id, text, and the boolean column `new` if only links with a new member are wanted. A unit's
    first pair of each kind with confidence >= least is what counts; of several groups with the same two units the
    least group decides. Returns from_id, to_id, kind, confidence, grp, cause, effect, enriched_to_text.
    """
    u = units.select("grp", "unit_id", "text", (F.col(new) if new else F.lit(True)).alias("fresh"))
    pairs = u.select("grp", "unit_id", "fresh", F.posexplode(F.filter(content.causal_pairs("text"), lambda p: p["confidence"] >= least)).alias("at", "p"))
    first = pairs.groupBy("grp", "unit_id", "fresh", F.col("p.kind").alias("kind")).agg(F.min_by("p", "at").alias("p"))
    source = first.select("grp", F.col("unit_id").alias("from_id"), F.col("fresh").alias("own"), "kind", F.col("p.confidence").alias("confidence"), F.col("p.cause").alias("cause"), F.col("p.effect").alias("effect"))
    met = source.join(u.select("grp", F.col("unit_id").alias("to_id"), F.col("text").alias("to_text"), "fresh"), "grp").where("from_id <> to_id AND (own OR fresh)")
    best = met.groupBy("from_id", "to_id", "kind").agg(F.min_by(F.struct("confidence", "grp", "cause", "effect", "to_text"), "grp").alias("x")).select("from_id", "to_id", "kind", "x.*")
    return best.withColumn("enriched_to_text", content.enriched(F.col("to_text"), F.array("cause", "effect"))).drop("to_text")


def valid_merges(merges: DataFrame, members: DataFrame) -> DataFrame:
    """merge_id and reason (null: the merge passes) of merges (merge_id, merged) over their members (merge_id, text).

    Reasons: empty (no text or no members), joined (over 0.8 of the members' length), dated (all members have a date, so has
    the merge, and it is not under half their length), uncovered (keywords: of up to 3 members one must share some; of more,
    0.15 on average).
    """
    keys = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(KEYWORD), F.lit(0)))
    m = merges.select("merge_id", F.coalesce("merged", F.lit("")).alias("merged")).withColumn("keys", keys(F.col("merged")))
    each = members.where("text IS NOT NULL").select("merge_id", "text").join(m, "merge_id").withColumn("own", keys(F.col("text")))
    share = F.size(F.array_intersect("own", "keys")) / F.greatest(F.size("own"), F.lit(1))
    agg = each.groupBy("merge_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total"), F.sum(F.col("text").rlike(DATE).cast("int")).alias("dated"), F.max(share).alias("top"), F.avg(share).alias("mean"))
    n = F.length("merged")
    reason = (
        F.when(F.col("n").isNull() | (F.col("merged") == ""), "empty")
        .when(n > F.col("total") * 0.8, "joined")
        .when((F.col("dated") == F.col("n")) & F.col("merged").rlike(DATE) & (n >= F.col("total") * 0.5), "dated")
        .when((F.size("keys") > 0) & F.when(F.col("n") <= 3, F.col("top") <= 0).otherwise(F.col("mean") < 0.15), "uncovered")
    )
    return m.join(agg, "merge_id", "left").select("merge_id", reason.alias("reason"))


def valid_moves(moves: DataFrame, entries: DataFrame, least: int = 20) -> DataFrame:
    """Rows of moves (entry_id, tags array<string>) whose entry (entry_id, text) exists, has `least` characters and gets a tag that says something."""
    known = entries.where(F.length("text") >= least).select("entry_id")
    return moves.join(known, "entry_id", "left_semi").where(F.exists("tags", lambda t: F.coalesce(t != "", F.lit(False))))


def conflicts(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows of pairs (new_text, old_text, sim, others kept) above the threshold with the same condition, where one text negates and the other doesn't."""
    same = F.expr(text.same_condition(SPARK, text.condition(SPARK, "new_text"), text.condition(SPARK, "old_text")))
    return pairs.where((F.col("sim") > threshold) & same & (content.negated(F.col("new_text")) != content.negated(F.col("old_text"))))


def _passes(op: Column, arg: Column, r: Column, tools: Column) -> Column:
    name = F.concat(F.lit(r"\Q"), arg, F.lit(r"\E"))
    section = F.concat(F.lit(r"(?iUm)^\s{0,3}(#{1,6}\s*.*"), name, F.lit(r"|\*\*.*"), name, F.lit(r".*\*\*\s*:?)\s*$"))
    label = F.concat(F.lit(r"(?iUm)^\s*"), name, F.lit(r"\s*:"))
    called = F.exists(tools, lambda t: F.lower(t) == F.lower(arg)) | F.regexp_like(r, F.concat(F.lit(r"(?iU)\btool_call\s*:\s*\Q"), F.lower(arg), F.lit(r"\E\b")))
    return (
        F.when(op == "section_present", F.regexp_like(r, section) | F.regexp_like(r, label))
        .when(op == "regex", F.regexp_like(r, arg))
        .when(op == "max_chars", F.length(r) <= arg.try_cast("long"))
        .when(op == "min_chars", F.length(r) >= arg.try_cast("long"))
        .when(op == "contains", F.contains(F.lower(r), F.lower(arg)))
        .when(op == "tool_called", called)
        .otherwise(True)
    )


def rule_judge(responses: DataFrame, checks: DataFrame) -> DataFrame:
    """id, hard (1 if all checks pass), soft (share passed) and rationale of responses (id, judge_id, response, tools) by checks (judge_id, pos, op, arg).

    A null response counts as empty, null tools as none; unknown kinds of checks pass; a response whose judge has no checks scores 0.
    """
    r = responses.select("id", "judge_id", F.coalesce("response", F.lit("")).alias("response"), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"))
    judged = r.join(checks, "judge_id").withColumn("ok", F.coalesce(_passes(F.col("op"), F.col("arg"), F.col("response"), F.col("tools")), F.lit(False)))
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("pos", F.concat_ws("=", "op", "arg").alias("what")))))
    agg = judged.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("passed"), failed.alias("failed"))
    said = F.when(F.col("n").isNull(), "no checks").when(F.col("passed") == F.col("n"), "all checks passed").otherwise(F.concat(F.lit("failed: "), F.array_join(F.transform("failed", lambda f: f["what"]), ", ")))
    return r.select("id").join(agg, "id", "left").select("id", F.when(F.col("passed") == F.col("n"), 1.0).otherwise(0.0).alias("hard"), F.coalesce(F.col("passed") / F.col("n"), F.lit(0.0)).alias("soft"), said.alias("rationale"))


def mentions(messages: DataFrame, skills: DataFrame) -> DataFrame:
    """id, skill of messages (id, text) that name a skill (skill): its whole last part, or all of its telling words if there are two or more.

    A message is tried only against skills whose longest word it holds, so nothing is crossed. Skills without a Latin
    letter or digit in their last part are none.
    """
    words = lambda c: F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")
    s = skills.select("skill", F.lower(F.substring_index("skill", "/", -1)).alias("leaf")).distinct().withColumn("all", words(F.col("leaf")))
    s = s.withColumn("telling", F.filter("all", lambda w: ~w.isin(*AMBIGUOUS) & (F.length(w) >= 3))).where(F.size("all") > 0)
    longest = lambda c: F.expr(f"element_at(array_sort({c}, (a, b) -> length(a) - length(b)), -1)")
    s = s.withColumn("keys", F.array_distinct(F.array_compact(F.array(longest("all"), F.when(F.size("telling") > 1, longest("telling")))))).withColumn("key", F.explode("keys"))
    m = messages.where("text IS NOT NULL").select("id", F.lower("text").alias("low"))
    # words travel with ids alone; a message meets its candidates, all at once, and is split once for them
    met = m.select("id", F.explode(F.array_distinct(words(F.col("low")))).alias("key")).join(s.select("skill", "leaf", "telling", "key"), "key")
    candidates = met.groupBy("id").agg(F.collect_set(F.struct("skill", "leaf", "telling")).alias("found"))
    own = m.join(candidates, "id").withColumn("have", F.array_distinct(words(F.col("low"))))
    phrase = lambda x: F.contains("low", x["leaf"]) & F.regexp_like(F.col("low"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), x["leaf"], F.lit(r"\E(?![a-z0-9])")))
    all_ = lambda x: (F.size(x["telling"]) >= 2) & (F.size(F.array_except(x["telling"], "have")) == 0)
    return own.select("id", F.explode(F.filter("found", lambda x: all_(x) | phrase(x))).alias("x")).select("id", "x.skill").distinct()


def small_domain_targets(points: DataFrame, min_nodes: int = 5, threshold: float = 0.6) -> DataFrame:
    """Per domain (a long) of points (domain, vec) with fewer than min_nodes points: domain, n, target and sim of the large domain
    with the nearest centroid, both null unless its cosine is above the threshold (ties: the least domain)."""
    sizes = points.groupBy("domain").agg(F.count("*").alias("n"))
    centres = sizes.join(vectors.centroid(points, "domain", "vec").select("domain", "centroid"), "domain", "left")
    small, big = centres.where(F.col("n") < min_nodes), centres.where(F.col("n") >= min_nodes)
    has = F.col("centroid").isNotNull()
    near = vectors.nearest(big.where(has).select(F.col("domain").alias("id"), F.col("centroid").alias("vec")), small.where(has).select(F.col("domain").alias("qid"), F.col("centroid").alias("vec")), 1, threshold)
    best = near.where(F.col("sim") > threshold).select(F.col("qid").alias("domain"), F.col("id").alias("target"), "sim")
    return small.select("domain", "n").join(best, "domain", "left")


def numbered(rows: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """rows with their place from 1 in the order of columns, without a window over all rows: sorted in ranges, counted by range."""
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row for each range
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return parts.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + at + 1).drop("__id", "__part", "__before")


def insert_points(nodes: DataFrame, texts: DataFrame, records: DataFrame, parent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, kind, parent) and texts (node_id, text) with records (pos, name, text) added: ids go on from the largest, in order of pos."""
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    new = cut(numbered(records.select("pos", "name", "text"), ["pos"]).withColumn("id", F.col("nth") + top))
    made = new.select("id", "name", F.lit("knowledge_point").alias("kind"), F.lit(parent).cast("long").alias("parent"))
    return nodes.select("id", "name", "kind", "parent").unionByName(made), texts.select("node_id", "text").unionByName(new.select(F.col("id").alias("node_id"), "text"))


def cluster_plan(labelled: DataFrame, most: int = 20, prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What clusters (id, cluster, text) write: entities (entity_id, name, members), bridge rows (unit_id, entity_id) and causal links.

    Noise (a cluster below 0 or null) and clusters of more than `most` members are left out. An entity is named after the first ten
    characters of its first member by id and its own id. Links are those of causal_links within a cluster; of several
    clusters with the same two units and kind the least one's counts.
    """
    sized = labelled.where("cluster >= 0 AND id IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("members"), F.min_by("text", "id").alias("head"))
    kept = cut(sized.where(F.col("members") <= most))
    entity = F.concat(F.lit(f"group_{prefix}_" if prefix else "group_"), F.col("cluster").cast("string"))
    entities = kept.select(entity.alias("entity_id"), F.concat(F.substring(F.coalesce("head", F.lit("")), 1, 10), F.lit("... ["), entity, F.lit("]")).alias("name"), "members")
    units = labelled.where("id IS NOT NULL").join(kept.select("cluster"), "cluster")
    bridge = units.select(F.col("id").alias("unit_id"), entity.alias("entity_id"))
    links = causal_links(units.select(F.col("cluster").alias("grp"), F.col("id").alias("unit_id"), F.coalesce("text", F.lit("")).alias("text")))
    return entities, bridge, links


def info_density(docs: DataFrame) -> DataFrame:
    """(id, density) of docs (id, text): the mean of ln(documents / (1 + occurrences)) over a text's words, brought to 0..1 over all documents.

    A document without words has no row; if all are equal, density is 0. The least and greatest value are one row.
    """
    rows = docs.where("text IS NOT NULL")
    said = rows.select("id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("w"))
    total = rows.count()
    weight = said.groupBy("w").agg(F.log(F.lit(float(total)) / (1 + F.count("*"))).alias("v"))
    own = said.groupBy("id", "w").agg(F.count("*").alias("n")).join(weight, "w").groupBy("id").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("d"))
    ends = own.agg(F.min("d").alias("low"), F.max("d").alias("high"))
    share = F.coalesce((F.col("d") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.0))
    return own.crossJoin(F.broadcast(ends)).select("id", share.alias("density"))
