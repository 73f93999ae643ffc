"""Exact p values as native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ln_gamma(x: str) -> str:
    """Logarithm of the gamma function for x > 0: Stirling's series 16 steps up, brought down again."""
    z = f"({x} + 16)"
    series = f"(({z} - 0.5D) * ln({z}) - {z} + 0.918938533204672742D + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7)))"
    return f"({series} - aggregate(sequence(0, 15), 0D, (s, i) -> s + ln({x} + i)))"


def _fraction(x: str, a: str, b: str) -> str:
    """The continued fraction of the incomplete beta function, by Lentz's method; two steps for each i."""
    tiny = "1e-300D"
    safe = lambda v: f"IF(abs({v}) < {tiny}, {tiny}, {v})"
    even = f"(i * ({b} - i) * {x} / (({a} + 2 * i - 1) * ({a} + 2 * i)))"
    odd = f"(-({a} + i) * ({a} + {b} + i) * {x} / (({a} + 2 * i) * ({a} + 2 * i + 1)))"

    def turn(s: str, k: str) -> str:
        c, d = safe(f"(1 + {k} / {s}.c)"), f"(1 / {safe(f'(1 + {k} * {s}.d)')})"
        return f"transform(array(named_struct('c', {c}, 'd', {d}, 'h', {s}.h)), t -> named_struct('c', t.c, 'd', t.d, 'h', t.h * t.c * t.d))[0]"

    first = safe(f"(1 - ({a} + {b}) * {x} / ({a} + 1))")
    start = f"named_struct('c', 1D, 'd', 1 / {first}, 'h', 1 / {first})"
    step = f"transform(array({turn('s', even)}), u -> {turn('u', odd)})[0]"
    return f"aggregate(sequence(1, 100 + CAST(6 * sqrt({a} + {b}) AS INT)), {start}, (s, i) -> {step}, s -> s.h)"


def incomplete_beta(x: str, a: str, b: str) -> str:
    """The regularised incomplete beta function I_x(a, b) of positive a, b and 0 <= x <= 1."""
    front = f"exp({ln_gamma(f'({a} + {b})')} - {ln_gamma(a)} - {ln_gamma(b)} + {a} * ln({x}) + {b} * ln(1 - {x}))"
    low = f"{front} * {_fraction(x, a, b)} / {a}"
    high = f"1 - {front} * {_fraction(f'(1 - {x})', b, a)} / {b}"
    return f"CASE WHEN {x} <= 0 THEN 0D WHEN {x} >= 1 THEN 1D WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {low} ELSE {high} END"


def p_value(t: str, df: str) -> str:
    """Probability that |T| >= |t| for Student's T with df > 0 degrees of freedom, two SQL expressions."""
    return f"transform(array(named_struct('x', {df} / ({df} + {t} * {t}), 'a', {df} / 2, 'b', 0.5D)), z -> {incomplete_beta('z.x', 'z.a', 'z.b')})[0]"


def welch(rows: DataFrame, group: str, value: str, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, mean_a, mean_b, diff, t, df, p, significant of Welch's test of the values of two groups.

    Defined results: null values don't count; a group without values gives t 0 and p 1, as does no variance at all.
    """
    one = lambda f, g: f(F.when(F.col(group) == g, F.col(value).cast("double")))
    both = rows.groupBy(*keys).agg(*[one(f, g).alias(f"{n}{i}") for i, g in (("a", a), ("b", b)) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    part = lambda i: F.when(F.col(f"n{i}") > 1, F.col(f"v{i}")).otherwise(0.0) / F.nullif(F.col(f"n{i}"), F.lit(0))
    out = both.withColumns({"pa": part("a"), "pb": part("b"), "se": F.sqrt(part("a") + part("b"))})
    below = lambda i: F.when(F.col(f"n{i}") > 1, F.pow(f"p{i}", 2) / F.nullif(F.col(f"n{i}") - 1, F.lit(0))).otherwise(0.0)
    sound = (F.col("na") > 0) & (F.col("nb") > 0) & (F.col("se") > 0)
    out = out.withColumns({"t": F.when(sound, (F.col("mb") - F.col("ma")) / F.nullif("se", F.lit(0.0))).otherwise(0.0), "df": F.when(sound, F.pow(F.col("pa") + F.col("pb"), 2) / F.nullif(below("a") + below("b"), F.lit(0.0)))})
    p = F.when(sound, F.expr(p_value("t", "df"))).otherwise(1.0)
    mean = lambda i: F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col(f"m{i}")).otherwise(0.0)
    return out.withColumn("p", p).select(*keys, mean("a").alias("mean_a"), mean("b").alias("mean_b"), (mean("b") - mean("a")).alias("diff"), "t", "df", "p", (F.col("p") < 0.05).alias("significant"))
