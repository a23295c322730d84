"""The library's named queries over the provided tables, with their SQL counterparts."""

from __future__ import annotations

from . import agents, fleets, history, memory, states

QUERIES = states.QUERIES | history.QUERIES | fleets.QUERIES | agents.QUERIES | memory.QUERIES
ORACLE_SQL = states.ORACLE_SQL | history.ORACLE_SQL | fleets.ORACLE_SQL | agents.ORACLE_SQL | memory.ORACLE_SQL
