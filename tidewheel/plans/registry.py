"""All registered queries and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ("series_queries", "align_queries", "event_queries", "rule_queries", "note_queries", "live_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"tidewheel.plans.{name}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
