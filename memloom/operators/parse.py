"""Tolerant parsing of model replies: brace scans and masks that no built-in expression reaches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("h", "kt", "s", "sag")


def first_object(text: str | None) -> dict | None:
    """The first JSON object of a reply: the whole text, its fenced part, or the first place where one parses."""
    decoder = json.JSONDecoder()
    for k, c in enumerate(text or ""):
        if c in "{[":
            try:
                value, _ = decoder.raw_decode(text, k)
            except ValueError:
                continue
            if isinstance(value, list):
                value = next((v for v in value if isinstance(v, dict)), None)
            if isinstance(value, dict):
                return value
    return None


def parse_json(text: str) -> Column:
    """The first JSON object as canonical JSON text, or null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (v := first_object(t)) is None else json.dumps(v, sort_keys=True, ensure_ascii=False))

    return run(text)


def parse_mask(text: str, least: float = 0.3) -> Column:
    """struct<h, kt, s, sag boolean, confidence double> of a router's reply; all on without an object or below `least` confidence."""

    @F.pandas_udf("h boolean, kt boolean, s boolean, sag boolean, confidence double")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            v = first_object(t)
            try:
                conf = min(1.0, max(0.0, float((v or {}).get("confidence", 0.5 if v is not None else 0.0))))
            except (TypeError, ValueError):
                conf = 0.0
            on = v is None or conf < least
            out.append((*(True if on else v.get(f) in (True, 1, "1", "true") for f in FIELDS), conf))
        return pd.DataFrame(out, columns=[*FIELDS, "confidence"])

    return run(text)
