"""Queries by name, and their SQL."""

from dossier.plans import evidence_oracles, evidence_queries, oracles, queries, record_oracles, record_queries

QUERIES = queries.QUERIES | record_queries.QUERIES | evidence_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | record_oracles.ORACLE_SQL | evidence_oracles.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
