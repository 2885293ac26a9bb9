"""Registered queries over the given tables, each beside its SQL statement."""

from importlib import import_module

_MODULES = ("scoring", "splitting", "runs", "inference", "geometry", "learning", "corpora", "storage")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
