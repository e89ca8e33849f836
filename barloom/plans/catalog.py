"""Importing this module registers every query."""

from barloom.plans import chains, choices, features, learning, market, validation  # noqa: F401
from barloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
