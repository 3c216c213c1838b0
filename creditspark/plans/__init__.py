"""Registered queries, grouped by area."""

from creditspark.plans.registry import ORACLES, QUERIES
from creditspark.plans import assessment, features, modeling, portfolio, quality, scoring  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
