"""Registered queries: each reads the given tables, and most have an equal SQL statement."""

from __future__ import annotations

from sparkmeter.plans import (  # noqa: F401
    audits,
    calendars,
    columns,
    jobs,
    parsing,
    pushes,
    saving,
    statistics,
    streams,
    texts,
)
from sparkmeter.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
