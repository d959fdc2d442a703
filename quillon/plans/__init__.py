"""Named queries and the SQL that an independent engine runs for the same rows."""

from quillon.plans import causal, evaluation, extras, learning, pieces, resampling, retrieval, similarity, studies, tables, timeseries  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
