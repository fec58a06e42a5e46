"""Registered queries with their comparison SQL."""

from importlib import import_module

MODULES = ("ingest", "explore", "statistics", "series", "models", "language", "topics", "patterns", "regression")


def load() -> None:
    """Import every query module once."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
