"""Registered queries: the operators bound to the shared test tables, each with its SQL oracle."""

from vitrina.plans.registry import ORACLES, QUERIES
from vitrina.plans import (  # noqa: E402,F401
    cascade_queries, image_queries, match_queries, provenance_queries, report_queries, run_queries, similarity_queries,
    source_queries, text_queries, unify_queries, url_queries,
)

__all__ = ["ORACLES", "QUERIES"]
