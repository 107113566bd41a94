"""All base queries and their SQL, by name."""

from __future__ import annotations

from marlstone.plans import operator_queries, scenarios

QUERIES: dict = scenarios.QUERIES | operator_queries.QUERIES
ORACLES: dict[str, str] = scenarios.ORACLES | operator_queries.ORACLES
