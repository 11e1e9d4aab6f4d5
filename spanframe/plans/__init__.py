"""Registered queries, by the operator that they apply."""

from spanframe.plans import catalog, clock, events, machines, poses, quality_checks, scalars, spans, statistics, stores, streams  # noqa: F401
from spanframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
