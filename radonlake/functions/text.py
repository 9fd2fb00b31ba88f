"""SQL text for numbers and rows, such that Spark and DuckDB read the same values."""

from __future__ import annotations

from collections.abc import Iterable


def num(x: float) -> str:
    """A double literal."""
    s = repr(float(x))
    s = s if "e" in s else s + "e0"
    return f"({s})" if s.startswith("-") else s


def values(rows: Iterable[Iterable[float | int]]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else num(x) for x in row) + ")" for row in rows)
