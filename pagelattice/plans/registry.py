"""All queries of the library by name."""

from __future__ import annotations

from . import boxes, checks, grids, judging, pages, reporting, sources, stages, text  # noqa: F401  (they register their queries)
from .base import REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
