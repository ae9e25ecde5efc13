"""All registered queries: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

from . import checks, evidence, models, ms1, raws, review

MODULES = (evidence, ms1, review, models, raws, checks)


def _all() -> dict:
    merged: dict = {}
    for module in MODULES:
        clash = set(merged) & set(module.QUERIES)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        merged.update(module.QUERIES)
    return merged


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: text for name, (_, text) in _all().items() if text is not None}
