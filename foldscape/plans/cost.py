"""Which physical strategy a sweep takes."""

from __future__ import annotations


def rows_in(spans) -> int:
    return sum(b - a + 1 for a, b in spans)


def strategy(n_variables: int, lib, pred, limit: int) -> str:
    """relational while candidates times pairs stay below the limit, else vectorised."""
    return "relational" if n_variables * rows_in(lib) * rows_in(pred) <= limit else "vectorised"
