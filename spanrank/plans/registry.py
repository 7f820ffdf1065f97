"""All queries of the library proper, with their DuckDB twins."""

from spanrank.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
