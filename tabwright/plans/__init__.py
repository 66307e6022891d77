"""Registered queries, by theme."""

from importlib import import_module

THEMES = ["relational", "values", "cleaning", "analysis", "documents"]


def load() -> None:
    """Import every theme, which registers its queries."""
    for theme in THEMES:
        import_module(f"{__name__}.{theme}")
