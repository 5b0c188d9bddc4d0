"""Query catalogue."""

from corvina.plans import table_queries, text_queries  # noqa: F401  they register themselves
from corvina.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
