"""Composed jobs: the registered queries, their input views and their check SQL."""

from pictorium.plans import catalog_queries, curation_queries, search_queries
from pictorium.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "catalog_queries", "curation_queries", "search_queries"]
