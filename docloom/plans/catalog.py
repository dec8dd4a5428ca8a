"""All queries of the library and their SQL."""

from __future__ import annotations

from docloom.plans import business, detection, extraction, relational, screening, streams, texts
from docloom.plans.registry import Query

GROUPS = (relational.G, business.G, detection.G, extraction.G, screening.G, texts.G, streams.G)


def queries() -> dict[str, Query]:
    return {k: q for g in GROUPS for k, q in g.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for g in GROUPS for k, s in g.oracles.items()}
