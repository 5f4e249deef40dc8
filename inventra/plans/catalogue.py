"""All registered queries of the inventory operators and their SQL."""

from __future__ import annotations

from . import metrics, rows, services  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
