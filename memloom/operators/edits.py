"""Edit scripts applied to documents in order: replace, delete and add, with anchors that must be unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths above which an added text is remarked on, and refused.
SOFT, HARD = 12000, 30000
_BLANK = r"[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _stripped(x: str, what: str = _BLANK) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '^{what}', ''), '{what}$', '')"


def _reason(soft: int, hard: int) -> str:
    """Why an edit e is refused on the body s.body, or 'ok' and 'ok: long'."""
    times = "(length(s.body) - length(replace(s.body, e.anchor, ''))) div length(e.anchor)"
    size = f"(length({_stripped('s.body', chr(92) * 2 + 'n+')}) + length(e.content))"
    return f"""CASE WHEN e.op IN ('replace', 'delete') THEN
        CASE WHEN e.blank THEN 'no anchor' WHEN {times} = 0 THEN 'anchor not found' WHEN {times} > 1 THEN concat('anchor found ', {times}, ' times') ELSE 'ok' END
    WHEN e.content = '' THEN 'nothing to add' WHEN {size} > {hard} THEN 'too long' WHEN {size} > {soft} THEN 'ok: long' ELSE 'ok' END"""


def apply(docs: DataFrame, edits: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """(id, body, log): documents (id, body) after their edits (id, seq, op, content, anchor) in order of seq, and each edit's outcome.

    replace and delete need an anchor that occurs exactly once in the body as it is then; anything else adds the
    stripped content below the body unless that makes it longer than hard characters. A refused edit changes nothing.
    log: array of struct(seq, op, reason); reason 'ok', 'ok: long' (over soft) or why it was refused. The fold is one
    native expression a document; a document's own script is read in one piece, as its order demands.

    Defined results: null body, op, content and anchor are '', an empty op is add; edits of one seq are ordered by op, content and
    anchor; null seq comes first; edits of unknown documents are left out; a repeated document row takes its script each time.
    """
    own = edits.select(
        "id",
        F.struct(
            F.col("seq").isNotNull().alias("has"),
            F.col("seq").alias("seq"),
            F.expr(f"coalesce(nullif({_stripped('lower(op)')}, ''), 'add')").alias("op"),
            F.expr(_stripped("content")).alias("content"),
            F.coalesce("anchor", F.lit("")).alias("anchor"),
            F.expr(f"{_stripped('anchor')} = ''").alias("blank"),
        ).alias("e"),
    )
    scripts = own.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("script"))
    body = "CASE WHEN s.reason NOT LIKE 'ok%' THEN s.body WHEN e.op = 'delete' THEN replace(s.body, e.anchor, '') WHEN e.op = 'replace' THEN replace(s.body, e.anchor, e.content) ELSE concat('\\n\\n', {0}, '\\n\\n', e.content, '\\n') END"
    body = body.format(_stripped("s.body", "\\\\n+"))
    step = f"""transform(array(named_struct('body', s.body, 'log', s.log, 'reason', {_reason(soft, hard)})), s -> named_struct('body', {body}, 'log', array_append(s.log, named_struct('seq', e.seq, 'op', e.op, 'reason', s.reason))))[0]"""
    seq = edits.schema["seq"].dataType.simpleString()
    start = f"named_struct('body', coalesce(body, ''), 'log', CAST(array() AS array<struct<seq: {seq}, op: string, reason: string>>))"
    folded = docs.select("id", "body").join(scripts, "id", "left").withColumn("s", F.expr(f"aggregate(coalesce(script, array()), {start}, (s, e) -> {step})"))
    return folded.select("id", "s.body", "s.log")
