"""Registered queries, feature registry and composed plans."""

import importlib
import os


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    here = os.path.dirname(os.path.abspath(__file__))
    for f in sorted(os.listdir(here)):
        if f.startswith("queries_") and f.endswith(".py"):
            importlib.import_module(f"{__name__}.{f[:-3]}")
