"""All queries of the domain with their SQL."""

from mitoloom.catalog import groups, models, rows  # noqa: F401  they register themselves
from mitoloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
