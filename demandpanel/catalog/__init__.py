"""Registered queries over the given tables, each beside the SQL it must agree with."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _part in ("panels", "aggregates", "statistics", "models", "domain", "texts", "audits", "files"):
    import_module(f"{__name__}.{_part}")

__all__ = ["ORACLES", "QUERIES"]
