"""All registered queries of the reference's operators, and their SQL."""

from . import sql_queries, table_queries  # noqa: F401  register their queries
from .queries import ORACLES, QUERIES, element_counts

__all__ = ["ORACLES", "QUERIES", "element_counts"]
