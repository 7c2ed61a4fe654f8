"""Registered queries, each with the SQL that states its result."""

from docloom.plans import answers, context, dialog, files, gates, graph, ingest, ops, pages, phrases, policy, retrieval, rules  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
