"""Every registered query of the engine with the SQL that checks it."""

from __future__ import annotations

from worktide.plans import days, names, oracles, queries, rollups

QUERIES = queries.QUERIES | days.QUERIES | rollups.QUERIES | names.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | days.ORACLE_SQL | rollups.ORACLE_SQL | names.ORACLE_SQL
FLAGSHIP = "monthly_load"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
