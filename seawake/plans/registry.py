"""Named queries over the test tables, and their SQL."""

from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "remove_outliers"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
