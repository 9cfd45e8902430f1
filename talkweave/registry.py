"""Registered queries and their SQL."""

from talkweave.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
