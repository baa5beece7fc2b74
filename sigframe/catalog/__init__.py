"""Registered queries, one module per family of operators."""

from importlib import import_module

from sigframe.catalog.registry import ORACLES, QUERIES, SURVEY_IDS

MODULES = ["signals", "windows", "grids", "catalogue", "scalars", "joins", "filters", "sequences", "streams", "plugins"]


def load() -> None:
    for m in MODULES:
        import_module(f"sigframe.catalog.{m}")


__all__ = ["ORACLES", "QUERIES", "SURVEY_IDS", "load"]
