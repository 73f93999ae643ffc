"""Order-insensitive comparison of a Spark result with DuckDB's."""

import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def canonical(frame):
    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        except (TypeError, ValueError):
            return str(v)

    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(tuple(one(v) for v in row) for row in frame.values.tolist())
