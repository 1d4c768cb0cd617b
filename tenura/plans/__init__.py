"""Registered queries over the given tables and their SQL counterparts."""

from tenura.plans import analytics, briefings, customers, forecasts, ingest, modelling
from tenura.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "briefings", "customers", "forecasts", "ingest", "modelling"]
