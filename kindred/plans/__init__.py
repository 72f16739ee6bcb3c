"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from . import geometry, ordered, queues, sessions, vectors

_PARTS = (sessions, queues, geometry, vectors, ordered)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.P.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.P.sql.items()}
