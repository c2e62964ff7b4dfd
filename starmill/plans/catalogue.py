"""The registered queries over the driver's tables, and their SQL."""

from starmill.plans import catalogue_queries, column_queries, fit_queries, grid_queries, sky_queries, summary_queries, table_queries  # noqa: F401
from starmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
