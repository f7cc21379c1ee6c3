"""The engine's own queries by name, with the SQL that each is compared with."""

from quillon.plans import text_queries, vector_queries  # noqa: F401
from quillon.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
