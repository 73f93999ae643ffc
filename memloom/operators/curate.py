"""Decisions about memories: votes of several rounds, marks by keyword rules, replies of judges and of choice questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules (keyword, mark), words of discussion, words of concepts, keywords they silence, patterns of good news.
RULES = (
    ("失败", "错误"),
    ("报错", "错误"),
    ("崩溃", "错误"),
    ("宕机", "错误"),
    ("OOM", "错误"),
    ("磁盘满", "错误"),
    ("断连", "错误"),
    ("拒绝连接", "错误"),
    ("无法连接", "错误"),
    ("连接失败", "错误"),
    ("超时", "可疑"),
    ("异常", "可疑"),
    ("熔断", "可疑"),
    ("降级", "可疑"),
    ("阻塞", "可疑"),
    ("未找到", "可疑"),
)
DISCUSSION = ("讨论", "研究", "探索")
CONCEPTS = ("方案", "机制", "流程", "策略", "设计", "处理", "规范", "配置", "设置", "情况", "原因", "场景")
BROAD = ("失败", "错误", "异常", "超时", "阻塞", "降级")
GOOD = (
    r"\b无(?:任何)?(?:bug|报错|失败|错误|异常|问题|故障)\b",
    r"\b0\s*[个]*(?:错误|bug|报错|失败|异常)",
    r"没有(?:任何)?(?:错误|bug|报错|失败|异常|问题)",
    r"已(?:修复|解决|更正|纠正)\b",
    r"验证\s*通过",
    r"部署\s*(?:通过|成功|完成)",
    r"运行\s*(?:正常|通过|成功)",
    r"流程\s*通过",
    r"测试\s*通过",
    r"(?:正常运行|稳定)",
    r"(?:无|没有)(?:任何)?异常",
    r"任务\s*正常",
    r"日志\s*无异常",
    r"(?:一切正常|系统正常|配置正常)",
    r"(?:服务正常|连接正常)",
    r"恢复(?:正常|成功)",
    r"启动(?:成功|正常)",
    r"写入(?:成功|完成)",
    r"删除(?:成功|完成)",
    r"更新(?:成功|完成)",
    r"创建(?:成功|完成)",
    r"初始化(?:成功|完成)",
    r"(?:操作成功|处理成功|成功[完成的])",
    r"所有.*(?:通过|成功|正常)",
    r"全部.*(?:通过|成功|正常)",
    r"0\s*个\s*问题",
    r"正确运行",
    r"(?:已[完成实现])",
)


def keyword_mark(text: str) -> Column:
    """struct(mark, keyword) by the first of RULES that holds, null if none does or the text bears a mark already.

    A rule holds where its keyword occurs (a Latin one as a word), unless a word of discussion begins within 5 characters of it, a
    word of a concept stands next to a broad keyword, or the text has a phrase of good news. Places are those of first occurrences.
    """
    low, own = f"lower({text})", F.col(text)
    good = F.lit(False)
    for p in GOOD:
        good = good | F.regexp_like(own, F.lit(f"(?iU){p}"))
    mark = F.expr("CAST(null AS struct<mark: string, keyword: string>)")
    for word, kind in reversed(RULES):
        latin = word.isascii()
        there = F.regexp_like(own, F.lit(rf"(?iU)\b{word}\b")) if latin else F.expr(f"contains({low}, '{word.lower()}')")
        at = f"locate('{word}', {low})"  # 0 where the keyword has upper-case letters
        near = F.expr(" OR ".join(f"(locate('{c}', {low}) > 0 AND {at} > 0 AND abs(locate('{c}', {low}) - {at}) <= 5)" for c in DISCUSSION))
        silent = F.lit(False)
        if word in BROAD:
            parts = []
            for c in CONCEPTS:
                before, after = f"locate('{c}', {low}, greatest(1, {at} - 3))", f"locate('{c}', {low}, {at} + {len(word)})"
                parts.append(f"({before} > 0 AND abs({before} - {at}) <= {max(len(word), len(c))}) OR ({after} > 0 AND {after} - {at} <= {len(word) + 3})")
            silent = F.expr(f"{at} > 0 AND (" + " OR ".join(parts) + ")")
        mark = F.when(there & ~near & ~silent, F.struct(F.lit(kind).alias("mark"), F.lit(word).alias("keyword"))).otherwise(mark)
    return F.when(own.isNotNull() & ~F.contains(own, F.lit("[标记: ")) & ~good, mark)


def merged_votes(votes: DataFrame, rounds: int) -> DataFrame:
    """(kind, key, value) of votes (round from 0, pos, kind, key, value) of so many rounds, by kind.

    remove: any round's, with the value of the last row; flagged: every row; compress, hindsight and merge: what all rounds
    name, with the first round's rows. Rows of no key, or of a key below 0 where keys are numbers, are left out but for flagged.
    """
    sound = F.col("key").isNotNull() & ~F.coalesce(F.col("key").try_cast("long") < 0, F.lit(False))
    removed = votes.where((F.col("kind") == "remove") & sound).groupBy("kind", "key").agg(F.max_by("value", F.struct("round", "pos")).alias("value"))
    flagged = votes.where("kind = 'flagged'").select("kind", "key", "value")
    shared = votes.where(F.col("kind").isin("compress", "hindsight", "merge") & sound)
    everywhere = shared.groupBy("kind", "key").agg(F.countDistinct("round").alias("n")).where(F.col("n") == rounds).select("kind", "key")
    return removed.unionByName(flagged).unionByName(shared.where("round = 0").join(everywhere, ["kind", "key"], "left_semi").select("kind", "key", "value"))


_FENCE = r"^```[a-zA-Z]*\n?"


def judge_reply(text: str) -> Column:
    """struct(overall, hindsight, knowledge_tree, sag) of a judge's reply, each cut to 0..1, null where there is none.

    A JSON object gives its fields (numbers or numeric texts), overall also as score or relevance; anything else the first 0 or 1 with
    its decimals as overall. A fence around the reply is taken off. A reply without either is null.
    """
    bare = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    bare = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, _FENCE, ""), r"\n?```$", ""), r"^\s+|\s+$", "")).otherwise(bare)
    json = F.try_parse_json(bare)
    object_ = F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False))

    def field(name: str) -> Column:
        shown = F.try_variant_get(json, f"$.{name}", "string")
        value = F.coalesce(F.trim(shown).try_cast("double"), F.when(shown == "true", 1.0).when(shown == "false", 0.0))
        return F.when(F.isnan(value) | (value < 0), 0.0).when(value > 1, 1.0).otherwise(value)

    number = F.nullif(F.regexp_extract(bare, r"[01](?:\.\d+)?", 0), F.lit("")).cast("double")
    whole = F.coalesce(field("overall"), field("score"), field("relevance"))
    parts = F.struct(whole.alias("overall"), *[field(c).alias(c) for c in ("hindsight", "knowledge_tree", "sag")])
    none = F.lit(None).cast("double")
    alone = F.struct(F.least(F.lit(1.0), number).alias("overall"), none.alias("hindsight"), none.alias("knowledge_tree"), none.alias("sag"))
    return F.when(object_, parts).when(number.isNotNull(), alone)


def _label(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")), r"[.):]+$", "")


def choice_label(reply: str, choices: str) -> Column:
    """The label a reply chooses among choices array<struct<label, text>>.

    The answer is what the last <answer> element holds, else the last line that is not blank. It is a label, or the text of a choice
    whose label it then is, or begins with a label; else its own label form stands. Labels are upper case without . ) : at the end.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    tagged = F.regexp_extract_all(F.col(reply), F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    lines = F.filter(F.transform(F.split(F.col(reply), r"\r\n|[\n\r]"), strip), lambda x: x != "")
    answer = F.coalesce(F.when(F.size(tagged) > 0, strip(F.get(tagged, F.size(tagged) - 1))), F.get(lines, F.size(lines) - 1), F.lit(""))
    labels = F.transform(F.col(choices), lambda c: _label(F.coalesce(c["label"], F.lit(""))))
    text = lambda c: strip(F.coalesce(c["text"], F.lit("")))
    same = F.filter(F.col(choices), lambda c: (text(c) != "") & (F.lower(text(c)) == F.lower(answer)))
    first = _label(F.get(F.split(answer, r"\s+"), F.lit(0)))
    named = F.when(F.array_contains(labels, _label(answer)), _label(answer)).when(F.size(same) > 0, _label(F.coalesce(F.get(same, F.lit(0))["label"], F.lit(""))))
    return F.coalesce(named, F.when((answer != "") & F.array_contains(labels, first), first), _label(answer))
