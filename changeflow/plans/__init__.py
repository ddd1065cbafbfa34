"""Registered queries over the given tables, each next to its check in SQL."""

from changeflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
