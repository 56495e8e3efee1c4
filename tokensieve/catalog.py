"""Queries by name, with the SQL they are checked against."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
