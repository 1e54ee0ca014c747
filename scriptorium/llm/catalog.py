"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("packing", "splitting", "leakage", "language", "similar", "overlap", "sentences", "defects", "scans", "splits")


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"{__package__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{name}":
                raise
            continue
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
