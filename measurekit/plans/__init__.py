"""Every registered query, collected from the modules of this folder."""

from __future__ import annotations

import importlib

from .registry import QUERIES, Query

MODULES = ("q_tables", "q_audit", "q_features", "q_models", "q_stacking")


def load_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES
