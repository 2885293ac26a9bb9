"""Column names for joins with tables of any columns."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted column name, lengthened until no name in ``taken`` equals it, whatever its case."""
    known = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out
