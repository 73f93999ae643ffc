"""Registration of queries with their oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from memloom.functions.dialect import DUCK, SPARK
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLE = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\}")


class Registry:
    """Collects queries by name; `sql` is the DuckDB twin, absent where SQL can't say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return register

    def sql(self, name: str, build: Callable[..., str], about: str = "") -> None:
        """One relational query, spelled for either engine; tables are written {name}."""
        text = build(SPARK)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))

        run.__doc__ = about
        self.add(name, _TABLE.sub(r"\1", build(DUCK)))(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str | Column, places: int) -> Column:
    """A finite double rounded as DuckDB does it, in doubles and halves away from 0; Spark's round works on the shortest decimal, where other values are halves."""
    scaled = F.abs(c) * F.lit(10.0**places)
    low = F.floor(scaled)
    return F.signum(c) * (low + F.when(scaled - low >= 0.5, 1).otherwise(0)) / F.lit(10.0**places)
