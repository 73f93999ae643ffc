"""Columns that judge content: kind and quality of components, equality of typed cells, causal pairs, enrichment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no cause and no effect.
NOISE_WORDS = (
    "系统状态", "系统", "系统日志", "日志", "错误", "报错", "失败", "提取", "提取失败", "提取全部", "测试", "验证", "执行", "运行", "完成",
    "处理", "处理完成", "处理失败", "状态", "记录", "2026", "2025", "2024", "2023", "2022", "2021", "第", "号", "条", "个", "次", "分", "秒", "时",
    "caused_by", "causes", "enables", "prevents", "LLM", "API", "URL", "HTTP", "JSON", "SQL", "数据库", "表", "字段", "索引", "查询", "写入", "读取",
)
# Words that enrich nothing.
CAUSAL_STOP = ("导致", "引发", "造成", "引起", "触发", "使得", "频繁", "大量", "多次", "持续", "反复", "连续", "发生", "出现", "存在", "进入", "开始", "停止")
# Words that negate a statement.
NEGATIONS = ("不", "不是", "不能", "无效", "不再", "相反", "错误", "不要", "而非", "并非", "无需")
# Kinds of a component, first match wins, and the code words that count for quality.
KINDS = (
    ("function", ("def ", "function")),
    ("import", ("import", "from ")),
    ("class", ("class ",)),
    ("control_flow", ("if ", "for ", "while ")),
    ("error_handling", ("try ", "except")),
)
CODE_WORDS = ("if ", "for ", "return", "import", "while", "try", "with ")

_W = r"[一-鿿\w]"
_PAIR = "array<struct<cause:string,effect:string,confidence:double,kind:string>>"
# Pattern, effect where the pattern names none, confidence and kind.
CAUSAL = (
    (rf"(?U)({_W}{{2,20}})(?:导致|引发|造成|引起|触发|带来)({_W}{{2,20}})", None, 0.9, "causes"),
    (rf"(?U)({_W}{{2,15}})(?:失败|报错|崩溃|超时|卡死)", "系统异常", 0.6, "caused_by"),
    (rf"(?U)因为[\s]*({_W}{{2,15}})[，,].*?(?:才|就|所以|因此|从而)[\s]*({_W}{{2,20}})", None, 0.8, "causes"),
    (rf"(?U)(?:根因|根源)(?:是|为)[\s]*({_W}{{2,20}})", "问题根因", 0.85, "causes"),
)


def _either(x: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(x, F.lit(w))
    return found


def component_kind(text: Column) -> Column:
    """What a section of code or prose is, by the first family of words it holds. Null stays null."""
    low, out = F.lower(text), None
    for kind, words in KINDS:
        out = F.when(_either(low, words), kind) if out is None else out.when(_either(low, words), kind)
    return F.when(text.isNotNull(), out.otherwise("general"))


def component_quality(text: Column) -> Column:
    """0.1 for under 10 characters or null, 0.3 for over 10,000, else a base with bonuses for structure, documentation, code words and length."""
    n = F.length(text)
    stripped = F.regexp_replace(text, r"(?U)^\s+", "")
    words = sum((F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0) for w in CODE_WORDS), F.lit(0))
    score = (
        F.lit(0.4)
        + F.when(_either(text, ("def ", "class ")), 0.15).otherwise(0.0)
        + F.when(_either(text, ('"""', "'''")) | stripped.startswith("#"), 0.1).otherwise(0.0)
        + F.least(F.lit(0.15), words * 0.03)
        + F.when(n.between(100, 5000), 0.1).otherwise(0.0)
    )
    return F.when(text.isNull() | (n < 10), 0.1).when(n > 10000, 0.3).otherwise(F.least(F.lit(1.0), score))


def cell(kind: Column, number: Column, text: Column) -> Column:
    """A typed cell: kind is 'number' (booleans too), 'time' (text hh:mm:ss), 'date' (number: days since 1899-12-30), 'text' or null."""
    return F.struct(kind.alias("kind"), number.cast("double").alias("number"), text.alias("text"))


def _normal(c: Column) -> Column:
    """Numbers and numeric texts rounded to cents, dates to days, times without their last three characters."""
    number = c["text"].rlike(r"^\s*[+-]?([0-9][0-9_]*\.?([0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$") & ~c["text"].rlike(r"_(_|[^0-9]|$)")
    parsed = F.when(number, F.replace(F.trim(c["text"]), F.lit("_"), F.lit("")).try_cast("double"))
    value = F.when(c["kind"] == "number", F.bround(c["number"], 2)).when(c["kind"] == "date", F.bround(c["number"], 0)).when(c["kind"] == "text", F.bround(parsed, 2))
    shown = F.when(c["kind"] == "time", F.expr("null").cast("string")).otherwise(c["text"])
    shown = F.when(c["kind"] == "time", F.substring(c["text"], F.lit(1), F.length(c["text"]) - 3)).when((c["kind"] == "text") & parsed.isNull(), shown)
    return F.struct(value.alias("value"), shown.alias("shown"))


def same_cell(a: Column, b: Column) -> Column:
    """Whether two cells are equal after normalisation; an empty text equals an empty cell, a number never equals a text."""
    x, y = _normal(a), _normal(b)
    empty = lambda c, z: c["kind"].isNull() | F.coalesce((c["kind"] == "text") & (z["shown"] == ""), F.lit(False))
    return (empty(a, x) & empty(b, y)) | F.coalesce(x["value"] == y["value"], F.lit(False)) | F.coalesce((x["shown"] == y["shown"]) & x["value"].isNull() & y["value"].isNull(), F.lit(False))


def causal_pairs(text: str) -> Column:
    """Causes and effects that a text states: _PAIR in order of the four pattern families, then of place. Noise words are none."""
    noise = F.array(*[F.lit(w) for w in NOISE_WORDS])
    sound = lambda w: ~F.array_contains(noise, w) & ~F.array_contains(noise, F.lower(w))

    def family(pattern: str, effect: str | None, confidence: float, kind: str) -> Column:
        own = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        other = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if effect is None else F.transform(own, lambda w: F.lit(effect))
        made = F.zip_with(own, other, lambda a, b: F.struct(a.alias("cause"), b.alias("effect"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind")))
        return F.filter(made, lambda p: sound(p["cause"]) & (sound(p["effect"]) if effect is None else F.lit(True)))

    parts = [family(*f) for f in CAUSAL]
    return F.coalesce(F.concat(*parts), F.array().cast(_PAIR))


def enriched(text: Column, words: Column) -> Column:
    """text with the cause and effect (the first two of words that say something), unless it is enriched already, one is missing or too short, or both are the same."""
    stop = F.array(*[F.lit(w) for w in (*NOISE_WORDS, *CAUSAL_STOP)])
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w))
    cause, effect = F.get(kept, F.lit(0)), F.get(kept, F.lit(1))
    usable = ~F.contains(text, F.lit("[因果来源：")) & (cause != effect) & (F.length(cause) >= 2) & (F.length(effect) >= 2)
    return F.when(F.coalesce(usable, F.lit(False)), F.concat(text, F.lit("。[因果来源："), cause, F.lit("] [因果结果："), effect, F.lit("] 与 "), cause, F.lit(" 相关。"))).otherwise(text)


def negated(text: Column) -> Column:
    return _either(text, NEGATIONS)
