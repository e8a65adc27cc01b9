"""All queries of the engine, and their SQL: every module that registers some is imported here."""

from __future__ import annotations

from . import building, methods  # noqa: F401  both register their queries
from .registry import oracle_sql, queries  # noqa: F401
