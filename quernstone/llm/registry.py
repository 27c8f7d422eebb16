"""All queries of this folder and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("katz", "quality", "htmltext", "parityjoin", "warc", "topk", "langid", "rules", "mixing", "packing", "convrepair", "multiindex", "hamerly")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(importlib.import_module(f"{__package__}.{m}"), "ORACLE_SQL", {}).items()}
