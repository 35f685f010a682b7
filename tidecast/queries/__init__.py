"""Registered queries with their reference SQL."""

from __future__ import annotations

from tidecast.queries.registry import ORACLES, QUERIES
from tidecast.queries import (  # noqa: F401  (registration)
    aggregates,
    cleaning,
    closed_forms,
    evaluation,
    expressions,
    forecasting,
    joining,
    projections,
    regression,
    scans,
    splits,
    windowing,
)

__all__ = ["ORACLES", "QUERIES"]
