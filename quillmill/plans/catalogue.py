"""Every registered query of the library's core, with its SQL where SQL can express it."""

from __future__ import annotations

from quillmill.plans import integrity, retrieval

MODULES = [integrity, retrieval]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
