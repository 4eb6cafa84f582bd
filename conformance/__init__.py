"""Every operator as a query over the given tables, with the SQL that must give the same rows."""

from conformance import (  # noqa: F401
    adaptation, dated_joins, family_queries, filters, health, income_queries, joins, matching_queries, period_queries, person_queries, scans,
)
from conformance.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
