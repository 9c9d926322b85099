"""All queries of the comparison engine."""

from __future__ import annotations

from . import feeds, layout, reading, verdicts, visual, whole  # noqa: F401
from .registry import REGISTRY


def queries() -> dict:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql() for name, q in REGISTRY.items() if q.oracle}
