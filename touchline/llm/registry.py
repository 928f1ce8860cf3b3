"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import pkgutil

import touchline.llm as home

QUERIES: dict = {}
ORACLES: dict = {}

for _found in sorted(m.name for m in pkgutil.iter_modules(home.__path__)):
    if _found.startswith("op"):
        _module = importlib.import_module(f"touchline.llm.{_found}")
        QUERIES |= _module.QUERIES
        ORACLES |= getattr(_module, "ORACLES", {})
