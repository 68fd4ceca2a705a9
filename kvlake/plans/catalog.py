"""All registered queries of the key-value engine."""

from __future__ import annotations

from kvlake.plans import formats, queries

QUERIES = queries.QUERIES | formats.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | formats.ORACLE_SQL
