"""All registered queries of the library."""

from docweave.plans import bundle_queries, relational_queries, structure_queries, text_queries
from docweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "bundle_queries", "relational_queries", "structure_queries", "text_queries"]
