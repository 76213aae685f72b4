"""Named queries and their SQL."""

from . import catalogue, control

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES", "catalogue", "control"]
