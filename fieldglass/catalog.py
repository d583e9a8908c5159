"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from fieldglass.plans import advices, extras, integrity, measures, quality, rules

QUERIES = {**quality.QUERIES, **measures.QUERIES, **rules.QUERIES, **extras.QUERIES, **advices.QUERIES, **integrity.QUERIES}
ORACLES = {**quality.ORACLES, **measures.ORACLES, **rules.ORACLES, **extras.ORACLES, **advices.ORACLES, **integrity.ORACLES}
