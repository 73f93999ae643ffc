"""Scalar functions are written once, as SQL text, over the few functions whose names differ between engines.

`spark(f, *args)` is the library's way to use them: a Column of built-in expressions, no Python per row.
The DuckDB spelling serves the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def has(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.lit(p)})"

    def count(self, x: str, p: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(p)}) AS BIGINT)"

    def all(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def one(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def sub(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def map(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def keep(self, a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def inter(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def member(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})" if items else "CAST(array() AS array<string>)"

    def steps(self, low: str, high: str) -> str:
        """low, low+1, ... high; empty if high < low."""
        return f"IF(({high}) < ({low}), CAST(array() AS array<int>), sequence(CAST({low} AS INT), CAST({high} AS INT)))"

    def words(self, x: str) -> str:
        """The parts of x between runs of white space."""
        return f"filter(split({x}, '\\\\s+'), w -> w <> '')"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def strip(self, x: str) -> str:
        return f"trim(BOTH concat(' ', chr(9), chr(10), chr(13)) FROM {x})"

    def trunc(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def first(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})"

    def at(self, a: str, i: str) -> str:
        return f"get({a}, CAST({i} AS INT) - 1)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, z) -> s + z)"

    def let(self, value: str, name: str, body: str) -> str:
        """body with name bound to value, so that value is computed once."""
        return f"get(transform(array({value}), {name} -> {body}), 0)"

    def chars(self, x: str) -> str:
        """The characters of a text that isn't empty."""
        return f"split({x}, '')"

    def windows(self, a: str, n: int, sep: str) -> str:
        """Each n neighbours of an array that has as many, joined."""
        return self.map(self.steps("1", f"{self.size(a)} - {n - 1}"), "i", self.join(self.part(a, "i", n), sep))

    def pct(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def collect(self, x: str) -> str:
        return f"sort_array(collect_list({x}))"

    def best(self, x: str, *order: str) -> str:
        return f"max_by({x}, struct({', '.join(order)}))"

    def epoch(self, ts: str) -> str:
        return f"(unix_micros(CAST({ts} AS TIMESTAMP)) / CAST(1000000 AS DOUBLE))"

    def hash(self, x: str) -> str:
        return f"md5({x})"

    def varchar(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def bool_or(self, x: str) -> str:
        return f"bool_or({x})"

    def part(self, a: str, i: str, n: int) -> str:
        return f"slice({a}, {i}, {n})"


class Duck(Spark):
    name = "duckdb"

    def dot(self, a: str, b: str) -> str:
        return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def let(self, value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def chars(self, x: str) -> str:
        return f"string_split({x}, '')"

    def windows(self, a: str, n: int, sep: str) -> str:
        rows = ", ".join([a, *[f"{a}[{k}:]" for k in range(2, n + 1)]])
        shown = f" || {self.lit(sep)} || ".join(f"z[{k}]" for k in range(1, n + 1))
        return f"list_transform(list_zip({rows})[1:len({a}) - {n - 1}], lambda z: {shown})"

    def pct(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def explode(self, a: str) -> str:
        return f"unnest({a})"

    def collect(self, x: str) -> str:
        return f"list_sort(list({x}))"

    def best(self, x: str, *order: str) -> str:
        return f"arg_max({x}, ({', '.join(order)}))"

    def epoch(self, ts: str) -> str:
        return f"epoch({ts})"

    def varchar(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def part(self, a: str, i: str, n: int) -> str:
        return f"({a})[{i} : {i} + {n - 1}]"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def has(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def count(self, x: str, p: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(p)}))"

    def sub(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)}, 'g')"

    def map(self, a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})"

    def keep(self, a: str, v: str, body: str) -> str:
        return f"list_filter({a}, lambda {v}: {body})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def inter(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def member(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def array(self, items: list[str]) -> str:
        return f"CAST([{', '.join(items)}] AS VARCHAR[])"

    def steps(self, low: str, high: str) -> str:
        return f"range({low}, ({high}) + 1)"

    def words(self, x: str) -> str:
        return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def strip(self, x: str) -> str:
        return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"

    def trunc(self, x: str) -> str:
        return f"CAST(trunc({x}) AS BIGINT)"

    def flat(self, a: str) -> str:
        return f"flatten({a})"

    def first(self, a: str, n: int) -> str:
        return f"({a})[1:{n}]"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"


SPARK, DUCK = Spark(), Duck()


def spark(f: Callable[..., str], *args: object) -> Column:
    """f as a Column over column names or SQL expressions."""
    return F.expr(f(SPARK, *args))


def any_of(d: Spark, x: str, needles: tuple[str, ...] | list[str]) -> str:
    """x contains one of the needles."""
    return "(" + " OR ".join(f"contains({x}, {d.lit(n)})" for n in needles) + ")"


def chain(d: Spark, rules: list[tuple[str, str]], otherwise: str) -> str:
    """The value of the first rule (condition, value) that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"
