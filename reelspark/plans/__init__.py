"""Named queries over the driver's tables, and the SQL that states them."""

from reelspark.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
