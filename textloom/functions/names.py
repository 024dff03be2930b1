"""Names for columns that an operator needs inside and that its input may have already."""

from __future__ import annotations


def free_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, or with as many underscores as it takes to be no column's name (names differ by more than case)."""
    low = {n.lower() for n in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted
