"""The registered queries and the SQL for the same rows."""

from quarry.plans.queries import ORACLES, QUERIES

FLAGSHIP = "call_edges"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
