"""Every registered query of the raster engine with its oracle SQL."""

from __future__ import annotations

from . import ingest_queries, pixel_queries, playback_queries, temporal_queries, wire_queries  # noqa: F401
from .registry import ENTRIES, Run


def queries() -> dict[str, Run]:
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql is not None}
