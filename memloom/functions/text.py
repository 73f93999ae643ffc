"""Text functions: keywords, tokens, n-grams, similarity, answer scoring, dates. SQL text over a dialect."""

from __future__ import annotations

from memloom.functions.dialect import Spark, any_of, chain

CJK = "[一-鿿]"

# Characters that start no CJK bigram, and stop words of the keyword picker.
CJK_STOP = "的了在是有和就不人都也到说要去会着这他那她它那些吗吧呢啊哦嗯嘛"
STOP_WORDS = (
    "的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 "
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to "
    "of in for on with at by from as into through during before after above below between out off over under again further then once here there when where "
    "why how all both each few more most other some such no nor not only own same so than too very just because but and or if while although though "
    "that this these those i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom whose"
).split()
# Answers without content.
EMPTY_REPLIES = (r"^(?i)(好的|嗯|哦|啊|是的|不是|可以|不行|好的呢|收到|了解|明白)$", r"^(?i)(测试|test|TODO|TBD|FIXME)$", r"^.{0,5}$")
# Conditions, in order of precedence.
CONDITIONS = (
    r"如果([^，。]{2,40})(则|那么)",
    r"假设([^，。]{2,40})(则|那么)",
    r"假如([^，。]{2,40})(则|那么)",
    r"倘若([^，。]{2,40})(则|那么)",
    r"当([^，。]{2,40})(时|情况下)",
    r"在([^，。]{2,40})(环境|条件|前提|基础)下",
    r"在([^，。]{2,40})(上|下|时|后|中)",
    r"对于([^，。]{2,40})(来说|而言)",
    r"基于([^，。]{2,40})",
    r"鉴于([^，。]{2,40})",
    r"由于([^，。]{2,40})",
    r"因为([^，。]{2,40})",
)
# What a date in a text may be, and the words that make it an end or a start.
UNTIL = ("之前", "以前", "为止", "截至", "到...为止", "旧版", "老版本", "已废弃", "已过时")
DASH = "-"


def grams(d: Spark, x: str, n: int = 2) -> str:
    """Distinct character n-grams of x; a shorter, non-empty x is its own gram."""
    many = d.let(d.chars("gx"), "gc", d.distinct(d.windows("gc", n, "")))
    return d.let(x, "gx", f"CASE WHEN length(gx) = 0 THEN {d.array([])} WHEN length(gx) < {n} THEN {d.array(['gx'])} ELSE {many} END")


def _over(d: Spark, a: str, b: str, body: str) -> str:
    """body over the arrays sa and sb, 0 if either is empty."""
    return d.let(a, "sa", d.let(b, "sb", f"CASE WHEN {d.size('sa')} = 0 OR {d.size('sb')} = 0 THEN CAST(0 AS DOUBLE) ELSE {body} END"))


def jaccard(d: Spark, a: str, b: str) -> str:
    """Jaccard similarity of two arrays without repeats; 0 if either is empty."""
    both = d.size(d.inter("sa", "sb"))
    return _over(d, a, b, f"{both} * CAST(1 AS DOUBLE) / ({d.size('sa')} + {d.size('sb')} - {both})")


def dice(d: Spark, a: str, b: str) -> str:
    return _over(d, a, b, f"2 * {d.size(d.inter('sa', 'sb'))} * CAST(1 AS DOUBLE) / ({d.size('sa')} + {d.size('sb')})")


def char_set(d: Spark, x: str) -> str:
    return d.let(x, "cx", f"CASE WHEN cx = '' THEN {d.array([])} ELSE {d.distinct(d.chars('cx'))} END")


def denoised(d: Spark, x: str) -> str:
    """x without causal tags, time stamps, session ids and a stock opening."""
    for p in (r"\[因果来源：[^\[\]]*\]\s*\[因果结果：[^\[\]]*\]", r"\| When: \d{4}-\d{2}-\d{2}", r"\[[\d]{8}_[\d]{6}_[a-z0-9]+\]", r"^系统存在[^，。]{2,30}[：:]"):
        x = d.strip(d.sub(x, p))
    return x


def word_shingles(d: Spark, x: str, k: int = 2) -> str:
    """Distinct k-word shingles; a shorter text is its own shingle."""
    many = d.distinct(d.windows("ws", k, " "))
    return d.let(d.words(f"lower({x})"), "ws", f"CASE WHEN {d.size('ws')} < {k} THEN {d.array([d.join('ws', ' ')])} ELSE {many} END")


def word_set(d: Spark, x: str) -> str:
    return d.distinct(d.words(f"lower({x})"))


def run_bigrams(d: Spark, x: str) -> str:
    """CJK bigrams that stay inside runs."""
    runs = d.all(x, CJK + "{2,}")
    return d.flat(d.map(runs, "r", d.map(d.steps("1", "length(r) - 1"), "j", "substring(r, j, 2)")))


def keywords(d: Spark, x: str, least: int = 2) -> str:
    """Lower-case ASCII tokens and CJK bigrams that bridge gaps, sorted."""
    ascii_ = d.map(d.keep(d.all(x, r"[a-zA-Z][a-zA-Z0-9_\-\.]*"), "w", f"length(w) >= {least}"), "w", "lower(w)")
    chars = d.join(d.all(x, CJK), "")
    pairs = d.keep(d.map(d.steps("1", f"length({chars}) - 1"), "i", f"substring({chars}, i, 2)"), "g", f"NOT contains({d.lit(CJK_STOP)}, substring(g, 1, 1))")
    return d.sort(d.union(d.distinct(ascii_), d.distinct(pairs)))


def estimate_tokens(d: Spark, x: str) -> str:
    return d.trunc(
        f"{d.count(x, '[一-鿿　-〿＀-￯]')} * 1.5 + {d.count(x, r'''[a-zA-Z][a-zA-Z0-9_\-']{2,}''')} * 1.3 + {d.count(x, '[0-9.,;:!?()（）、。；：！？]')} * 0.25"
    )


def quality(d: Spark, x: str) -> str:
    """Heuristic quality of a text from its length, sentences, digits and terms, 0 to 1, rounded to 6 places."""
    t = d.strip(x)
    n = f"length({t})"
    parts = d.size(d.keep(f"regexp_split_to_array({t}, '[。！？.!?\n]+')" if d.name == "duckdb" else f"split({t}, '[。！？.!?\\n]+')", "s", f"{d.strip('s')} <> ''"))
    length_score = chain(d, [(f"{n} < 20", f"{n} / 20.0 * 0.6"), (f"{n} < 200", f"0.6 + ({n} - 20) / 180.0 * 0.3"), (f"{n} < 1000", "0.9")], f"greatest(0.0, 0.9 - least(0.4, ({n} - 1000) / 2000.0))")
    mean = f"({n} * 1.0 / {parts})"
    sentence = chain(d, [(f"{mean} BETWEEN 15 AND 60", "0.8"), (f"({mean} >= 8 AND {mean} < 15) OR ({mean} > 60 AND {mean} <= 100)", "0.6")], "0.4")
    sentence = f"CASE WHEN {parts} = 0 THEN 0.2 ELSE least(1.0, {sentence} + CASE WHEN {parts} >= 3 THEN 0.1 ELSE 0 END) END"
    density = f"({d.count(t, '[0-9]+')} / greatest(1.0, {n} / 50.0))"
    digits = chain(d, [(f"{density} > 3", "0.9"), (f"{density} > 1", "0.7"), (f"{density} > 0", "0.5")], "0.3")
    terms = d.count(t, "[A-Za-z][A-Za-z0-9_]+")
    term = chain(d, [(f"{terms} >= 5", "0.8"), (f"{terms} >= 2", "0.6"), (f"{terms} >= 1", "0.4")], "0.3")
    low = " OR ".join(d.has(t, p) for p in (r"^(好的|嗯|哦|啊|是的|不是|可以|不行|好的呢|收到|了解|明白)$", "(?i)^(测试|test|todo|tbd|fixme)$"))
    as_double = lambda e: f"CAST({e} AS DOUBLE)"
    total = f"{as_double(length_score)} * CAST(0.3 AS DOUBLE) + {as_double(sentence)} * CAST(0.3 AS DOUBLE) + {as_double(digits)} * CAST(0.2 AS DOUBLE) + {as_double(term)} * CAST(0.2 AS DOUBLE)"
    return f"CASE WHEN {n} = 0 THEN CAST(0 AS DOUBLE) WHEN {n} < 10 OR {low} THEN CAST(0.1 AS DOUBLE) ELSE round({total}, 6) END"


def eval_tokens(d: Spark, x: str) -> str:
    """Lower-case ASCII tokens of three letters or more, CJK characters, and CJK bigrams inside runs."""
    y = f"lower({x})"
    return d.distinct(d.union(d.union(d.distinct(d.all(y, "[a-z][a-z0-9_-]{2,}")), d.distinct(d.all(y, CJK))), d.distinct(run_bigrams(d, y))))


def top_keywords(d: Spark, x: str, n: int) -> str:
    """Longest tokens that are no stop words, ties in lexical order."""
    kept = d.keep(eval_tokens(d, x), "w", f"length(w) >= 2 AND NOT {d.member(d.array([d.lit(s) for s in STOP_WORDS]), 'w')}")
    # sort key: length descending, then the word
    keyed = d.sort(d.map(kept, "w", "concat(lpad(CAST(100000 - length(w) AS VARCHAR(9)), 6, '0'), w)"))
    return d.map(d.first(keyed, n), "k", "substring(k, 7)")


def _ratio(d: Spark, part: str, whole: str) -> str:
    return d.let(whole, "rw", f"CASE WHEN {d.size('rw')} = 0 THEN CAST(0 AS DOUBLE) ELSE {d.size(d.inter('rw', part))} * CAST(1 AS DOUBLE) / {d.size('rw')} END")


def faithfulness(d: Spark, answer: str, context: str) -> str:
    """0.6 of the answer's tokens and 0.4 of its keywords that the context has."""
    score = f"0.6 * ({_ratio(d, eval_tokens(d, context), eval_tokens(d, answer))}) + 0.4 * ({_ratio(d, top_keywords(d, context, 10), top_keywords(d, answer, 5))})"
    return f"CASE WHEN {d.strip(answer)} = '' THEN CAST(0 AS DOUBLE) ELSE round(CAST({score} AS DOUBLE), 3) END"


def relevance(d: Spark, query: str, context: str) -> str:
    score = f"0.5 * ({_ratio(d, eval_tokens(d, context), eval_tokens(d, query))}) + 0.5 * ({_ratio(d, top_keywords(d, context, 10), top_keywords(d, query, 5))})"
    return f"CASE WHEN {d.strip(context)} = '' THEN CAST(0 AS DOUBLE) WHEN {d.size(eval_tokens(d, query))} = 0 THEN CAST(0.5 AS DOUBLE) ELSE round(CAST({score} AS DOUBLE), 3) END"


def coverage(d: Spark, query: str, context: str) -> str:
    return f"CASE WHEN {d.strip(context)} = '' THEN CAST(0 AS DOUBLE) WHEN {d.size(top_keywords(d, query, 8))} = 0 THEN CAST(0.5 AS DOUBLE) ELSE round({_ratio(d, eval_tokens(d, context), top_keywords(d, query, 8))}, 3) END"


def normal_answer(d: Spark, x: str) -> str:
    """Lower case without ASCII punctuation, articles and extra white space."""
    y = d.sub(f"lower({x})", r"""[!-/:-@\[-`{-~]""")
    return d.join(d.keep(d.words(y), "w", "w NOT IN ('a', 'an', 'the')"), " ")


def token_f1(d: Spark, a: str, b: str) -> str:
    """F1 of two texts as bags of normalised words; 1 if both are empty."""
    n = lambda w, ws: d.size(d.keep(ws, "z", f"z = {w}"))
    common = d.map(d.distinct("fx"), "v", f"least({n('v', 'fx')}, {n('v', 'fy')})")
    total = f"aggregate({common}, 0L, (s, c) -> s + c)" if d.name == "spark" else f"coalesce(list_sum({common}), 0)"
    body = f"CASE WHEN {d.size('fx')} = 0 AND {d.size('fy')} = 0 THEN CAST(1 AS DOUBLE) WHEN {d.size('fx')} = 0 OR {d.size('fy')} = 0 THEN CAST(0 AS DOUBLE) ELSE round(2 * CAST({total} AS DOUBLE) / ({d.size('fx')} + {d.size('fy')}), 6) END"
    return d.let(d.words(normal_answer(d, a)), "fx", d.let(d.words(normal_answer(d, b)), "fy", body))


def sub_match(d: Spark, a: str, b: str) -> str:
    x, y = normal_answer(d, a), normal_answer(d, b)
    return f"CASE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 1.0 ELSE 0.0 END".replace("1.0", "CAST(1 AS DOUBLE)").replace("0.0", "CAST(0 AS DOUBLE)")


def exact_match(d: Spark, a: str, b: str) -> str:
    return f"CASE WHEN {normal_answer(d, a)} = {normal_answer(d, b)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def anls(d: Spark, a: str, b: str, limit: float = 0.5) -> str:
    """1 less the edit distance over the longer length, 0 from the limit on; of lower-case, space-normalised texts."""
    x, y = d.join(d.words(f"lower({a})"), " "), d.join(d.words(f"lower({b})"), " ")
    share = f"(CAST(levenshtein({x}, {y}) AS DOUBLE) / greatest(length({x}), length({y})))"
    return f"CASE WHEN {x} = '' AND {y} = '' THEN CAST(1 AS DOUBLE) WHEN {x} = '' OR {y} = '' OR {share} >= {limit} THEN CAST(0 AS DOUBLE) ELSE round(1 - {share}, 6) END"


def contained(d: Spark, reference: str, response: str) -> str:
    """1 if the normalised response contains the normalised, non-empty reference."""
    r, s = d.join(d.words(f"lower({reference})"), " "), d.join(d.words(f"lower({response})"), " ")
    return f"CASE WHEN {r} <> '' AND contains({s}, {r}) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def soft_keywords(d: Spark, reference: str, response: str) -> str:
    """Share of the reference's distinct words of three characters or more that occur in the response."""
    ws = d.distinct(d.keep(d.words(f"lower({reference})"), "w", "length(w) > 2"))
    s = d.join(d.words(f"lower({response})"), " ")
    return f"CASE WHEN {d.size(ws)} = 0 THEN CAST(0 AS DOUBLE) ELSE round({d.size(d.keep(ws, 'w', f'contains({s}, w)'))} * CAST(1 AS DOUBLE) / {d.size(ws)}, 6) END"


def dates(d: Spark, x: str) -> str:
    return d.sort(d.distinct(d.union(d.union(d.all(x, r"\d{4}-\d{1,2}-\d{1,2}"), d.all(x, r"\d{4}/\d{1,2}/\d{1,2}")), d.all(x, r"\d{1,2}月\d{1,2}日"))))


def key_numbers(d: Spark, x: str) -> str:
    return d.sort(d.distinct(d.all(x, r"\d+\.?\d*(?:[a-zA-Z]+|[一-鿿]{1,3}|%)?")))


def proper_nouns(d: Spark, x: str) -> str:
    return d.sort(d.distinct(d.keep(d.all(x, r"[\p{L}\p{N}_]+"), "w", d.has("w", "^[A-Z][a-zA-Z]{3,}$"))))


def cleanup_bigrams(d: Spark, x: str) -> str:
    """CJK bigrams inside runs and English words of four letters or more."""
    return d.sort(d.union(d.distinct(run_bigrams(d, x)), d.distinct(d.all(x, "[a-zA-Z]{4,}"))))


def truncate_at_line(d: Spark, x: str, n: int = 400, suffix: str = "…（截断）") -> str:
    """The first n characters, cut at the last line break beyond their half, with a suffix."""
    head = f"substring({x}, 1, {n})"
    last = f"(length({head}) - instr(reverse({head}), chr(10)) + 1)"
    cut = f"CASE WHEN instr({head}, chr(10)) > 0 AND {last} - 1 > {n // 2} THEN substring({head}, 1, {last} - 1) ELSE {head} END"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat({cut}, {d.lit(suffix)}) END"


def head_tail(d: Spark, x: str, budget: int) -> str:
    if budget <= 0:
        return "''"
    if budget <= 20:
        return f"substring({x}, 1, {budget})"
    return f"CASE WHEN length({x}) <= {budget} THEN {x} ELSE concat(substring({x}, 1, {budget // 2}), chr(10), '...', chr(10), right({x}, {budget - budget // 2 - 6})) END"


def halves(d: Spark, x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(substring({x}, 1, {n // 2}), right({x}, {n // 2})) END"


def condition(d: Spark, x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({d.one(x, p)}, '')" for p in CONDITIONS) + ", '')"


def same_condition(d: Spark, a: str, b: str) -> str:
    """Two conditions share at least 0.3 of their CJK runs; where either has none they count as the same."""
    x, y = d.distinct(d.all(a, CJK + "{2,}")), d.distinct(d.all(b, CJK + "{2,}"))
    return f"({d.size(x)} = 0 OR {d.size(y)} = 0 OR {jaccard(d, x, y)} >= 0.3)"


def iso_date(d: Spark, x: str) -> str:
    """The first date of a text as ISO text: year, month and day as far as given, the rest 01."""
    p = r"((?:19|20)\d{2})[-年/.](?:(0?[1-9]|1[0-2])[-月/.])?(?:(0?[1-9]|[12]\d|3[01])[日号]?)?"
    y, m, day = (d.one(x, p, g) for g in (1, 2, 3))
    two = lambda e: f"lpad({e}, 2, '0')"
    # "2024-05" has its second number where the day stands
    month = f"CASE WHEN {m} <> '' THEN {two(m)} WHEN {day} <> '' THEN {two(day)} ELSE '01' END"
    return f"CASE WHEN {y} = '' THEN NULL ELSE concat({y}, '-', {month}, '-', CASE WHEN {m} <> '' AND {day} <> '' THEN {two(day)} ELSE '01' END) END"


def valid_range(d: Spark, x: str, end: bool) -> str:
    """valid_from or, with end, valid_until: the first full date; it is an end if a word before it says so."""
    p = r"(\d{4})[年\-/.](\d{1,2})[月\-/.](\d{1,2})[日号]?"
    iso = f"concat({d.one(x, p, 1)}, '-', lpad({d.one(x, p, 2)}, 2, '0'), '-', lpad({d.one(x, p, 3)}, 2, '0'))"
    before = d.one(x, r"^((?s:.*?))\d{4}[年\-/.]\d{1,2}[月\-/.]\d{1,2}", 1)
    is_end = any_of(d, before, UNTIL)
    return f"CASE WHEN {d.has(x, p)} AND {'' if end else 'NOT '}{is_end} THEN {iso} END"


def replacement(d: Spark, x: str, head: int = 200, tail: int = 100) -> str:
    """What stands for an over-long text: its length, hash, head and tail."""
    h = "sha2({}, 256)" if d.name == "spark" else "sha256({})"
    return f"concat('[长记忆治理]', chr(10), '原始长度: ', CAST(length({x}) AS VARCHAR(12)), ' 字符', chr(10), '原始SHA256: ', {h.format(x)}, chr(10), '[原文开头摘要]', chr(10), {d.strip(f'substring({x}, 1, {head})')}, chr(10), '[原文结尾摘要]', chr(10), {d.strip(f'right({x}, {tail})')})"


def marked(d: Spark, x: str, mark: str, note: str = "") -> str:
    """x with a mark behind it, unless it has one."""
    return f"CASE WHEN {d.has(x, r'\[标记: [^\]]+\]')} THEN {x} ELSE concat({x}, chr(10), {d.lit(f'[标记: {mark}]' + (' ' + note if note else ''))}) END"


def unmarked(d: Spark, x: str) -> str:
    return d.sub(x, r"\n\[标记: [^\]]+\][^\n]*")


def first_rule(d: Spark, x: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The label of the first pattern found in x, or null."""
    return chain(d, [(d.has(x, p), d.lit(v)) for p, v in rules], "NULL")
