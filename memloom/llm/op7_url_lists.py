"""URL filter by a temporal list join.

A list is a log of dated changes (key, verdict, changed_at, change 'add' or 'remove'). Each addition
becomes a validity interval that ends at the key's next change. Captures are evaluated as of their fetch
time: every URL has keys for its host's suffixes (h:example.org) and its path prefixes
(p:host/seg/seg); an equality join on the key with fetched_at inside the interval finds the entries that
were active. The longest key decides, block before allow among equals. Only distinct (url, fetched_at)
are joined, so a hot host's repeated captures cost one row.

Defined results: null or hostless URLs have no keys and are not blocked; a null fetch time meets no
entry; changes with null key or date are void; two changes of a key at one time: the removal counts
first; repeated captures are answered one by one; empty tables give no rows or no hits; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"

#: The list that the query applies: key, verdict, date, change.
CHANGES = [
    ("h:spam-farm.example.org", "block", "2024-01-15", "add"),
    ("h:spam-farm.example.org", "block", "2024-06-01", "remove"),
    ("h:spam-farm.example.org", "block", "2024-09-01", "add"),
    ("h:casino-win.example.org", "block", "2024-01-01", "add"),
    ("h:cheap-pills.example.com", "block", "2024-02-01", "add"),
    ("p:www.cheap-pills.example.com/en", "allow", "2024-05-01", "add"),
    ("p:www.cheap-pills.example.com/en", "allow", "2024-07-01", "remove"),
    ("h:adult-x.example.net", "block", "2024-03-10", "add"),
    ("h:adult-x.example.net", "block", "2024-10-10", "remove"),
    ("h:free-bets.example.com", "block", "2024-01-01", "add"),
    ("h:ads-track.example.org", "block", "2024-04-01", "add"),
    ("h:tionsh.example.net", "block", "2024-11-01", "add"),
    ("p:blog.tionsh.example.net/en", "allow", "2024-11-15", "add"),
]


def intervals(changes: DataFrame) -> DataFrame:
    """key, verdict, valid_from, valid_to (null: still active) of every addition in the log."""
    order = Window.partitionBy("key").orderBy("changed_at", F.desc("change"))
    log = changes.where("key IS NOT NULL AND changed_at IS NOT NULL").withColumn("valid_to", F.lead("changed_at").over(order))
    return log.where("change = 'add' AND (valid_to IS NULL OR valid_to > changed_at)").select("key", "verdict", F.col("changed_at").alias("valid_from"), "valid_to")


def keys(url: str) -> F.Column:
    low = F.lower(F.col(url))
    host, path = F.regexp_extract(low, _HOST, 1), F.regexp_extract(low, _PATH, 1)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    none = F.expr("CAST(array() AS array<string>)")
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(suffixes, F.coalesce(prefixes, none))).otherwise(none)


def evaluate(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) with n_entries active at fetch time, the deciding entry and blocked."""
    asked = captures.select("url", "fetched_at").distinct()
    hits = asked.select("url", "fetched_at", F.explode(keys("url")).alias("key")).join(intervals(changes), "key")
    hits = hits.where("valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)")
    best = F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), F.col("verdict"), F.col("key")))
    found = hits.groupBy("url", "fetched_at").agg(F.count("*").alias("n_entries"), best.alias("best"))
    out = captures.alias("c").join(found.alias("f"), (F.col("c.url") == F.col("f.url")) & (F.col("c.fetched_at") == F.col("f.fetched_at")), "left")
    return out.select(
        "c.page_id",
        "c.url",
        "c.fetched_at",
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.col("best.key").alias("entry"),
        F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time: page_id counts days from the start of 2024, modulo the year."""
    pages = table(spark, sf_dir, "pages").selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "date_add(DATE'2024-01-01', CAST(page_id % 366 AS INT)) AS fetched_at")
    changes = spark.createDataFrame(CHANGES, "key string, verdict string, changed_at string, change string").withColumn("changed_at", F.to_date("changed_at"))
    return evaluate(pages, changes).withColumn("fetched_at", F.col("fetched_at").cast("string"))


SQL = f"""
WITH ch AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}', DATE '{d}', '{c}')" for k, v, d, c in CHANGES)}) t(key, verdict, since, change)),
iv AS (SELECT key, verdict, since AS a, nxt AS b FROM (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since, change DESC) AS nxt FROM ch) x WHERE change = 'add' AND (nxt IS NULL OR nxt > since)),
p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day, regexp_extract(lower(url), '{_HOST}', 1) AS host, list_filter(string_split(regexp_extract(lower(url), '{_PATH}', 1), '/'), lambda s: s <> '') AS seg FROM pages),
k AS (SELECT page_id, url, day, unnest(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'h:' || array_to_string(string_split(host, '.')[i:], '.')), list_transform(range(1, len(seg) + 1), lambda i: 'p:' || host || '/' || array_to_string(seg[1:i], '/')))) AS key FROM p WHERE host <> ''),
h AS (SELECT k.page_id, k.url, count(*) AS n, arg_max(k.key, (length(k.key), verdict, k.key)) AS entry, arg_max(verdict, (length(k.key), verdict, k.key)) AS verdict FROM k JOIN iv ON iv.key = k.key AND a <= day AND (b IS NULL OR day < b) GROUP BY 1, 2)
SELECT p.page_id, p.url, CAST(p.day AS VARCHAR) AS fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, entry, coalesce(verdict = 'block', false) AS blocked FROM p LEFT JOIN h ON h.page_id = p.page_id AND h.url = p.url
"""
