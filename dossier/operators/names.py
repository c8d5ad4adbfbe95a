"""Column names that don't clash."""

from __future__ import annotations


def apart(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it where ``columns`` have it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
