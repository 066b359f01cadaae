"""All registered queries of the library and their SQL, gathered from the query modules."""

from __future__ import annotations

import importlib

MODULES = ("q_stats", "q_text", "q_model", "q_files", "q_state")


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"{__package__}.{m}").QUERIES
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
