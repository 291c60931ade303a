"""All queries of the library proper, by name."""

from __future__ import annotations

from ledgertide.catalog import Query
from ledgertide.plans import analysis, corpus, markets, models, rollups, statements, streams

MODULES = [corpus, markets, analysis, models, streams, rollups, statements]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
