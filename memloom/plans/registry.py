"""All queries of the library's own operators, with their DuckDB SQL."""

from __future__ import annotations

from memloom.plans import deep, knowledge, kpi, more, ranking, relational, roundtrip, scalar, similar, streams

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (kpi, scalar, relational, ranking, streams, more, roundtrip, knowledge, similar, deep):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
