"""Registered queries and the SQL they are checked against."""

from checks import (  # noqa: F401
    cohort_queries,
    feature_queries,
    metric_queries,
    mlm_queries,
    similarity_queries,
    source_queries,
    text_queries,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
