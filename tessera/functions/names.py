"""Names of columns that an operator adds for itself."""

from __future__ import annotations

from collections.abc import Iterable


def private(columns: Iterable[str], *names: str) -> list[str]:
    """Names like those given that no column has (case does not count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
