"""Secret scan in native expressions: fixed patterns, and sliding-window Shannon entropy with an allow-list.

Positions come from splitting a text at a pattern: the lengths of pieces and matches, summed up, give
each match's place in code points. The entropy method looks at candidate strings (runs of CLASS
characters), slides a window over each with counts updated by one character in and one out, and reports
the candidate when a window's entropy reaches the limit of its character class. Sums of c*log2(c) come
from a fixed table in thousandths of a bit, so results are the same on any machine. Allow-listed
candidates and those inside a base span are not reported again. No shuffle, no Python.

Defined results: null or empty text has no spans (hash of the empty string); repeated rows are scanned
one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base patterns.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CHUNK = 256
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy of a window, in thousandths of a bit per character: lower-case hexadecimal strings, and all others.
HEX_LIMIT, MIXED_LIMIT = 3000, 4000
#: Candidates that are no secrets: words without a digit or without a letter, paths and dashed words in lower case, UUIDs, placeholders.
#: A rule is a pattern, or patterns that must all match and patterns that must not. No rule repeats a group: Java's matcher
#: goes one call deeper for each repeat, so a long candidate would end the executor.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    ((r"^[a-z]+[-_/]", r"^[-a-z0-9_/]+$"), (r"[-_/]([-_/]|$)",)),
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"([eE][xX][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR])",
)

Rule = str | tuple[tuple[str, ...], tuple[str, ...]]


def _listed(rules: tuple[Rule, ...], matches: Callable[[str], str]) -> str:
    """Whether any rule holds, in either engine's words for a match."""
    parts = [((r,), ()) if isinstance(r, str) else r for r in rules]
    return " OR ".join("(" + " AND ".join([matches(p) for p in yes] + [f"NOT {matches(p)}" for p in no]) + ")" for yes, no in parts) or "false"


_BITS = [round(1000 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]


def _limit(per_char: int) -> int:
    """Entropy >= limit says: the sum of c*log2(c) is at most this."""
    return round(1000 * WINDOW * math.log2(WINDOW)) - per_char * WINDOW


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


_SPAN = "array<struct<s:bigint,e:bigint,w:string>>"


def _found(pattern: str) -> str:
    """array<struct<s, e, w>>: every match's start, end and text.

    Matches are bound once, and so are the pieces between them. Lengths are summed in chunks of CHUNK matches, so that many
    matches copy no long array each.
    """
    q = _quoted(pattern)
    walk = (
        "aggregate({part}, named_struct('at', {at}, 'out', CAST(array() AS " + _SPAN + ")), "
        "(a, x) -> named_struct('at', a.at + x.gap + length(x.w), 'out', array_append(a.out, named_struct('s', a.at + x.gap, 'e', a.at + x.gap + length(x.w), 'w', x.w))))"
    )
    chunks = f"transform(sequence(1, size(z), {CHUNK}), k -> slice(z, k, {CHUNK}))"
    joined = f"aggregate({chunks}, named_struct('at', 0L, 'out', CAST(array() AS array<{_SPAN}>)), (b, c) -> transform(array({walk.format(part='c', at='b.at')}), y -> named_struct('at', y.at, 'out', array_append(b.out, y.out)))[0], b -> flatten(b.out))"
    pairs = f"transform(array(regexp_extract_all(t, {q}, 0)), m -> zip_with(m, slice(split(t, {q}, -1), 1, size(m)), (w, g) -> struct(length(g) AS gap, w AS w)))"
    return f"CASE WHEN t RLIKE {q} THEN transform({pairs}, z -> {joined})[0] ELSE CAST(array() AS {_SPAN}) END"


def _least_sum() -> str:
    """Of candidate x.w: the least sum of c*log2(c) over its windows, by incremental counts.

    The candidate becomes an array of character codes once, so each step looks up one code that enters and one that leaves.
    """
    bits = "array(" + ",".join(map(str, _BITS)) + ")"
    come, go = "v[i]", f"v[i - {WINDOW}]"
    more = f"{bits}[b.n[{come}] + 1] - {bits}[b.n[{come}]]"
    less = f"{bits}[b.n[{go}] - 1] - {bits}[b.n[{go}]]"
    total = f"b.sum + CASE WHEN i < {WINDOW} THEN {more} WHEN {come} = {go} THEN 0 ELSE {more} + {less} END"
    counts = f"CASE WHEN i >= {WINDOW} AND {come} = {go} THEN b.n ELSE transform(b.n, (c, k) -> c + IF(k = {come}, 1, 0) - IF(i >= {WINDOW} AND k = {go}, 1, 0)) END"
    start = f"named_struct('n', array_repeat(0, {len(ALPHABET)}), 'sum', 0, 'best', 1000000)"
    step = f"(b, i) -> named_struct('n', {counts}, 'sum', {total}, 'best', IF(i >= {WINDOW - 1}, least(b.best, {total}), b.best))"
    codes = f"transform(filter(split(x.w, ''), c -> c <> ''), c -> locate(c, '{ALPHABET}') - 1)"
    return f"transform(array({codes}), v -> aggregate(sequence(0, size(v) - 1), {start}, {step}, b -> b.best))[0]"


def scan(docs: DataFrame, allow: tuple[Rule, ...] = ALLOW) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base kinds and all spans as array<struct<s, k, e, kind>> sorted by place."""
    kinds = ("assign", "access", "hex", "entropy")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    as_spans = lambda name, k: f"transform({name}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))"
    df = df.withColumns({"a": F.expr(_found(ASSIGN)), "b": F.expr(_found(ACCESS)), "c": F.expr(_found(HEX)), "d": F.expr(_found(CANDIDATE))})
    df = df.withColumn("a", F.expr(f"filter(a, x -> length(regexp_extract(x.w, {_quoted(ASSIGN)}, 2)) >= 6)"))
    df = df.withColumn("base", F.expr(f"array_sort(concat({as_spans('a', 0)}, {as_spans('b', 1)}, {as_spans('c', 2)}))"))
    listed = _listed(allow, lambda p: f"x.w RLIKE {_quoted(p)}")
    limit = f"IF(x.w RLIKE r'^[0-9a-f]+$', {_limit(HEX_LIMIT)}, {_limit(MIXED_LIMIT)})"
    df = df.withColumn("d", F.expr(f"filter(d, x -> NOT ({listed}) AND NOT exists(base, y -> y.s <= x.s AND x.e <= y.e) AND {_least_sum()} <= {limit})"))
    named = "'" + "','".join(kinds) + "'"
    df = df.withColumn("found", F.expr(f"transform(array_sort(concat(base, {as_spans('d', 3)})), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', element_at(array({named}), x.k + 1)))"))
    return df.select("doc_id", F.size("a").cast("long").alias("n_assign"), F.size("b").cast("long").alias("n_access"), F.size("c").cast("long").alias("n_hex"), "found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.expr(shown.format("filter(found, x -> x.k < 3)")), 256).alias("base_sha256"),
        F.expr(shown.format("found")).alias("spans"),
    )


def _sql() -> str:
    def found(name: str, pattern: str) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return (
            f"{name} AS (SELECT doc_id, list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) AS BIGINT), 'w': m[i]}}) AS {name} "
            f"FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_split_to_array(t, {p}) AS p FROM d))"
        )

    p2 = "'" + ASSIGN.replace("'", "''") + "'"
    bits = "[" + ",".join(map(str, _BITS)) + "]"
    listed = _listed(ALLOW, lambda p: "regexp_matches(x.w, '" + p.replace("'", "''") + "')")
    sums = f"list_min(list_transform(range(1, length(x.w) - {WINDOW} + 2), lambda j: list_sum(list_transform(map_values(list_histogram(string_split(substring(x.w, j, {WINDOW}), ''))), lambda n: {bits}[CAST(n AS BIGINT) + 1]))))"
    span = lambda c, k, kind: f"list_transform({c}, lambda x: {{'s': x.s, 'k': {k}, 'e': x.s + length(x.w), 'kind': '{kind}'}})"
    shown = "array_to_string(list_transform({}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{found('a', ASSIGN)},
{found('b', ACCESS)},
{found('c', HEX)},
{found('e', CANDIDATE)},
j AS (SELECT doc_id, list_filter(a, lambda x: length(regexp_extract(x.w, {p2}, 2)) >= 6) AS a, b, c, e FROM a JOIN b USING (doc_id) JOIN c USING (doc_id) JOIN e USING (doc_id)),
k AS (SELECT *, list_sort(list_concat({span('a', 0, 'assign')}, {span('b', 1, 'access')}, {span('c', 2, 'hex')})) AS base FROM j),
f AS (SELECT *, list_sort(list_concat(base, {span(f"list_filter(e, lambda x: NOT ({listed}) AND len(list_filter(base, lambda y: y.s <= x.s AND x.s + length(x.w) <= y.e)) = 0 AND {sums} <= CASE WHEN regexp_matches(x.w, '^[0-9a-f]+$') THEN {_limit(HEX_LIMIT)} ELSE {_limit(MIXED_LIMIT)} END)", 3, 'entropy')})) AS found FROM k)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(b) AS BIGINT) AS n_access, CAST(len(c) AS BIGINT) AS n_hex, sha256({shown.format('base')}) AS base_sha256, {shown.format('found')} AS spans FROM f
"""


SQL = _sql()
