"""The queries of this library over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from . import extraction, fields, folds, functions, history, items, payloads, planning, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extraction", "fields", "folds", "functions", "history", "items", "payloads", "planning", "tables"]
