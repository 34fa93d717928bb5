"""The registered queries, each with the SQL that must give the same rows."""

from workload import algebra, positional, relational, statistics, userfunc  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
