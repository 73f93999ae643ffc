"""Gates: which texts, turns and facts pass, and why not. SQL text over a dialect."""

from __future__ import annotations

from memloom.functions.dialect import Spark, any_of, chain

# Fixed values.
SPECIFIC = "算法 模型 架构 框架 系统 原理 机制 流程 协议 策略 范式 工具 技术 理论 公式 定理 定律 标准 规范".split()
ABSTRACT = (r"^[^，。]*是[^，。]*的[^，。]*$", r"^[^，。]*对[^，。]*的[^，。]*$", r"^[^，。]*在[^，。]*方面", r"^[^，。]*具有[^，。]*特点")
KNOWLEDGE_TYPES = ("principle", "formula", "key_point", "conclusion", "method")
EXTRACTION_FAILED = ("无法提取", "已被删除", "无法读取", "请提供")
META_PREFIX = r"^(本文|文章|本研究|本篇|该文章|该研究|综述|文章概述)(介绍了|讨论了|分析了|探讨了|概述了|总结了|描述了|阐述了)"
SUGGESTIONS = (r"^建议[：:]?", r"^改进建议", r"^方案", r"^[Nn]ote[：:]", r"^TODO[：:]", r"^FIXME[：:]", r"^[\\\(（]待定[\\\)）]", r"^注意[：:]", r"^说明[：:]", r"^备注[：:]", r"^示例[：:]")
CONFIG = (r"localhost:[0-9]+|127\.0\.0\.1:[0-9]+", r"^部署命令", r"^健康检查命令", r"curl -s.*localhost")
PREDICATES = "[是有在为将能会可以应该需要必须通过使让把被给从到向往由于因为所以但是而且并且或者如果虽然即使无论不管只要除非以及还是也都又再还就才已经正在将要曾经一直总是经常偶尔突然渐渐终于最终原来其实当然显然自然确实真正最更加比较非常十分特别极其相当]"
VAGUE = ("很重要", "很关键", "很有用", "非常重要", "非常关键", "非常有用", "十分重要", "十分关键")
PRINCIPLE = "因为 通过 使 使得 遵循 基于 依赖于 导致 从而 因此 所以 实现 产生 带来".split()
FORMULA = "= ≈ ≡ ∝ ∑ Σ ∫ softmax cosine log exp sqrt sigmoid dot( norm( sum(".split()
CONCLUSION = "优于 高于 低于 比 更好 更差 更有效 提升 降低 验证 发现 条件 在 下 超过 不及 相比".split()
METHOD = "步骤 首先 其次 最后 分 步 → -> 应该 必须 需要 建议 执行 运行 配置 部署 流程 操作 阶段".split()
CONFIRM = r"(?i)^(都.*吧|好[的吧]?$|行$|可以$|停$|嗯$|没问题|知道了|收到|ok$|okay$|yes$|no$)"
NOTICES = (r"(?i)\[Note:", r"(?i)\[ASYNC DELEGATION", r"(?i)model was just switched")
INTERNAL = ("(?i)review the conversation above", "(?i)update the skill", "(?i)context compaction", "(?i)following is recalled memory context", "(?i)<memory-context>")
STATUS = (r"(?i)(部署完成|测试通过|运行正常|gateway.*active|service.*active)", "(回滚命令|备份目录|文件级备份|防残留扫描)", r"(?i)(Syntax OK|\d+ passed in \d+(\.\d+)?s|DELETE \d+|INSERT 0 \d+)")
LOG_HINTS = ("Traceback", "diff --git", "--- a/", "+++ b/", "psql ", "systemctl ", "./deploy/", "```")
CODE_QUERY = r"(?i)(函数|方法|类|调用|源码|原码|定义|实现|接口|模块|文件|变量|参数|类图|调用链|调用关系|谁调用|引用|导入|\bdef\b|\bclass\b|\bfunc\b|\bimport\b|\bfunction\b)"
CORE_TERMS = (
    "skill kt sag litellm router gateway plugin deploy cron embed rerank min_score token budget recall inject "
    "修复 检查 排他 管道 部署 测试 运行 验证 重启 日志 错误 报警 飞轮 知识树 聚类 记忆 清理 巡检 基线"
).split()
HARD_BLOCK = (
    (r"(?i)rm\s+-rf\s+/", "rm_rf"),
    (r"(?i)curl\s+[^|]*\|\s*bash", "curl_bash"),
    (r"(?i)wget\s+[^|]*\|\s*bash", "wget_bash"),
    (r"AKIA[0-9A-Z]{16}", "access_key"),
    (r"(?i)ignore\s+(all\s+)?(previous|prior)\s+instructions?", "ignore_instructions"),
    (r"(?i)you\s+are\s+now\s+(a|an)\s+", "new_role"),
    (r"(?i)disregard\s+(all\s+)?(safety|security|ethical)", "disregard_safety"),
)
NEGATIVE = (
    "still broken",
    "still not",
    "still wrong",
    "doesn't work",
    "does not work",
    "that's wrong",
    "thats wrong",
    "incorrect",
    "wrong",
    "no,",
    "nope",
    "fix it",
    "didn't",
    "did not",
    "broken",
    "error again",
    "still failing",
    "still fails",
    "not fixed",
)
POSITIVE = ("thanks", "thank you", "perfect", "great", "works now", "fixed", "that works", "lgtm", "looks good", "nice", "correct")
NEGATIVE_CJK = "不对 错了 还不对 还错 还是错 没改好 没修好 改不对 仍然不对 不正确 还是不行 错误 不行 不好 不可以 bug 缺陷 失败".split()
POSITIVE_CJK = "可以 好了 对了 正确 通过 行了 改好了 修好了 搞定 没问题 可用".split()
NEGATABLE = ("错误", "失败", "bug", "缺陷")
NEGATIONS = "不没未别莫无"


def vague(d: Spark, x: str) -> str:
    """Neither digits, technical terms nor quotes, and an abstract sentence pattern."""
    quotes = "['\"「」『』《》【】]"
    return f"(NOT {d.has(x, '[0-9]+')} AND NOT {any_of(d, x, SPECIFIC)} AND NOT {d.has(x, quotes)} AND ({' OR '.join(d.has(x, p) for p in ABSTRACT)}))"


def admissible(d: Spark, x: str, least: int = 10) -> str:
    t = d.strip(x)
    return f"(length({t}) >= {least} AND NOT {d.has(t, '^(本文|文章|本研究|本篇|该文章|该研究)')} AND NOT {d.has(t, '(讨论了|介绍了|分析了|探讨了|概述了|总结了|描述了|阐述了)')} AND NOT {vague(d, t)})"


def guard(d: Spark, x: str, kind: str) -> str:
    """Why a fact is refused, or ''; the first rule that fails counts."""
    rules = [(f"{kind} NOT IN ({', '.join(map(d.lit, KNOWLEDGE_TYPES))})", f"concat('未知类型: ', {kind})"), (f"length({x}) < 10", f"concat('长度不足: ', CAST(length({x}) AS VARCHAR(9)))")]
    rules += [(d.has(x, p), d.lit(f"提取失败信号: {p}")) for p in EXTRACTION_FAILED]
    rules += [(d.has(x, META_PREFIX), f"concat('元信息开头: ', {d.one(x, META_PREFIX)})")]
    rules += [(d.has(d.strip(x), p), d.lit(f"建议/意见类型: {p}")) for p in SUGGESTIONS]
    rules += [(d.has(x, p), d.lit(f"配置/命令类型: {p}")) for p in CONFIG]
    return chain(d, rules, "''")


def top_bigram_count(d: Spark, x: str) -> str:
    """How often the most frequent pair of successive CJK characters occurs."""
    largest = "array_max" if d.name == "spark" else "list_max"
    pairs = d.map(d.steps("1", f"{d.size('cj')} - 1"), "i", d.join(d.part("cj", "i", 2), ""))
    counts = d.let(pairs, "ps", d.map(d.distinct("ps"), "g", d.size(d.keep("ps", "h", "h = g"))))
    return d.let(d.all(x, "[一-鿿]"), "cj", f"coalesce({largest}({counts}), 0)")


def low_quality(d: Spark, x: str) -> str:
    """Kind of low quality (code, title, repeated, abstract), or ''. It marks, it never drops."""
    code, cjk = d.count(x, r"[a-zA-Z0-9{}()\[\];.<>=+\-*/&|!@#$%^_\\]"), d.count(x, "[一-鿿]")
    concrete = d.has(x, "[0-9%％]|[一-鿿]{4,}")
    return chain(
        d,
        [
            (f"{code} > 0.8 * greatest(length({x}), 1) AND {cjk} < 10", "'code'"),
            (f"length({x}) < 20 AND NOT {d.has(x, PREDICATES)} AND NOT {d.has(x, '[，。！？；：、,.!?;:]')}", "'title'"),
            (f"{cjk} >= 4 AND {top_bigram_count(d, x)} > 3", "'repeated'"),
            (f"{any_of(d, x, VAGUE)} AND (NOT {concrete} OR length({x}) < 25)", "'abstract'"),
        ],
        "''",
    )


def whitelisted(d: Spark, x: str, needles: list[str]) -> str:
    return any_of(d, x, [n for n in needles if n]) if any(needles) else "false"


def format_reason(d: Spark, x: str, kind: str) -> str:
    return chain(
        d,
        [
            (f"{kind} = 'principle' AND NOT {any_of(d, x, PRINCIPLE)}", d.lit("原理缺少因果/机制动词")),
            (f"{kind} = 'formula' AND NOT {any_of(d, x, FORMULA)}", d.lit("公式缺少数学符号或函数名")),
            (f"{kind} = 'key_point' AND length({x}) < 10", d.lit("要点长度不足 10 字")),
            (f"{kind} = 'conclusion' AND NOT {any_of(d, x, CONCLUSION)}", d.lit("结论缺少条件/比较词")),
            (f"{kind} = 'method' AND NOT {any_of(d, x, METHOD)}", d.lit("方法/流程缺少步骤标志或规范词")),
        ],
        "''",
    )


def relabelled(d: Spark, x: str, kind: str) -> str:
    """key_point where a claimed type lacks its signals."""
    lacks = " OR ".join(f"({kind} = '{k}' AND NOT {any_of(d, x, s)})" for k, s in (("principle", PRINCIPLE), ("conclusion", CONCLUSION), ("formula", FORMULA)))
    return f"CASE WHEN {lacks} THEN 'key_point' ELSE {kind} END"


def undefined_abbreviation(d: Spark, x: str, known: list[str]) -> str:
    """The first run of capitals that is not known, or null."""
    return d.at(d.keep(d.all(x, r"[\p{L}\p{N}_]+"), "w", f"{d.has('w', '^[A-Z]{2,}$')} AND w NOT IN ({', '.join(map(d.lit, known))})"), "1")


def claims(d: Spark, x: str, claimed: str) -> str:
    """At least how many claims a text makes."""
    parts = d.size(d.keep(f"split({x}, '[，,]')" if d.name == "spark" else f"regexp_split_to_array({x}, '[，,]')", "p", f"length({d.strip('p')}) >= 6"))
    semis = d.count(x, "[;；]")
    return (
        f"CASE WHEN {d.strip(x)} = '' THEN greatest({claimed}, 0) ELSE greatest({claimed}, 0, CASE WHEN {d.has(x, '且|并且|同时|分别|一方面|另一方面|但是|然而|而且')} THEN 2 ELSE 0 END, "
        f"CASE WHEN {semis} > 0 THEN {semis} + 1 ELSE 0 END, CASE WHEN {parts} >= 2 AND {d.has(x, '是|有|能|会|可|使|用')} THEN 2 ELSE 0 END) END"
    )


def mark_action(d: Spark, x: str) -> str:
    """exclude, demote (factor 0.3) or keep, by a mark in the last 100 characters."""
    tail = f"right({x}, 100)"
    return f"CASE WHEN {d.has(tail, r'\[标记: (?:错误|作废|可疑|待验证)\]')} THEN 'exclude' WHEN {d.has(tail, r'\[标记: 已解决\]')} THEN 'demote' ELSE 'keep' END"


def is_system_prompt(d: Spark, x: str, first_turn: str) -> str:
    return f"({first_turn} AND length({x}) >= 200 AND {d.count(x, '[A-Za-z]')} >= 0.5 * greatest({d.count(x, r'[^ \t\n\r]')}, 1))"


def skip_before(d: Spark, x: str) -> str:
    """Why a user turn needs no recall: empty, notice, internal, confirm, foreign; or ''."""
    t = d.strip(x)
    return chain(
        d,
        [
            (f"{t} = ''", "'empty'"),
            ("(" + " OR ".join(d.has(t, p) for p in NOTICES) + ")", "'notice'"),
            ("(" + " OR ".join(d.has(t, p) for p in INTERNAL) + ")", "'internal'"),
            (d.has(t, CONFIRM), "'confirm'"),
            (f"length({t}) > 200 AND {d.count(t, '[一-鿿]')} < 0.05 * length({t})", "'foreign'"),
        ],
        "''",
    )


def skip_after(d: Spark, x: str) -> str:
    """Why an answer is not worth keeping: empty, short, tool, confirm; or ''."""
    t = d.strip(x)
    line = d.strip(d.one(t, r"^[^\n]*"))
    return chain(
        d,
        [(f"{x} = ''", "'empty'"), (f"length({t}) < 80", "'short'"), (f"{d.count(t, '```')} >= 3 AND length({t}) < 300", "'tool'"), (f"length({line}) < 20 AND {d.has(line, CONFIRM)}", "'confirm'")],
        "''",
    )


def skip_extraction(d: Spark, x: str) -> str:
    t = d.strip(f"coalesce({x}, '')")
    hints = " + ".join(f"CASE WHEN contains({t}, {d.lit(h)}) THEN 1 ELSE 0 END" for h in LOG_HINTS)
    return chain(
        d,
        [(f"{t} = ''", "'empty'"), (f"length({t}) < 600 AND ({' OR '.join(d.has(t, p) for p in STATUS)})", "'status'"), (f"({hints}) >= 2", "'log'"), (f"{d.count(t, '```')} >= 4 AND length({t}) < 2000", "'code'")],
        "''",
    )


def code_query(d: Spark, x: str) -> str:
    return d.has(x, CODE_QUERY)


def substantive(d: Spark, x: str, more: list[str] = []) -> str:  # noqa: B006
    return f"(contains({x}, '?') OR contains({x}, '？') OR {any_of(d, f'lower({x})', [*CORE_TERMS, *more])})"


def security(d: Spark, x: str) -> str:
    """The name of the first hard-blocked pattern, 'code_context' for sudo, eval or exec in code, or ''."""
    code = f"(contains({x}, '```') OR contains({x}, '~~~') OR {d.has(x, r'(?m)^[ \t]*[$>][ \t]*[^ \t\n]')} OR {d.has(x, r'(?m)^[ \t]*(sudo|rm\b|curl|wget|bash|sh|python3?|eval|exec)\b')})"
    return chain(d, [*((d.has(x, p), d.lit(v)) for p, v in HARD_BLOCK), (f"{code} AND {d.has(x, r'(?im)^[ \t]*(sudo|eval|exec)\b')}", "'code_context'")], "''")


def feedback(d: Spark, x: str) -> str:
    """Sentiment signals neg:... and pos:..., comma-joined in the order of the lexicons."""
    low = f"lower({x})" if d.name != "spark" else "fl"
    plain = lambda w: contains(w) if any(c in w for c in " ,.'") else held(w, rf"\b{w}\b")

    def contains(w: str) -> str:
        return f"contains({low}, {d.lit(w)})"

    def held(w: str, pattern: str) -> str:
        """In Spark most words are ruled out by a search of bytes before their pattern is tried."""
        return f"({contains(w)} AND {d.has(low, pattern)})" if d.name == "spark" else d.has(low, pattern)

    def unnegated(w: str) -> str:
        return held(w, f"(^|[^{NEGATIONS}]){w}")

    rules = [(plain(w), f"neg:{w}") for w in NEGATIVE] + [(plain(w), f"pos:{w}") for w in POSITIVE]
    rules += [(unnegated(w) if w in NEGATABLE else contains(w), f"neg:{w}") for w in NEGATIVE_CJK]
    rules += [(contains(w) if w == "没问题" else unnegated(w), f"pos:{w}") for w in POSITIVE_CJK]
    items = d.array([f"CASE WHEN {c} THEN {d.lit(v)} ELSE '' END" for c, v in rules])
    signals = d.join(d.keep(items, "s", "s <> ''"), ",")
    return d.let(f"lower({x})", "fl", signals) if d.name == "spark" else signals
