"""All queries of the engine by name."""

from __future__ import annotations

from cuegrid.plans import models, records, rounds, speech, texts, timeline, voices

_MODULES = (timeline, texts, speech, records, voices, rounds, models)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.register.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.register.sql.items()}
