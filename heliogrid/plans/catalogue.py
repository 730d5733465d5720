"""The registered queries of the microclimate engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import met_queries, physics_queries, scene_queries

FLAGSHIP = "utci_hourly_stats"
QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (scene_queries, met_queries, physics_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
