"""Validation targets never become features."""

from __future__ import annotations

from collections.abc import Iterable

#: Parts of names of crime and demographic columns (fixed values).
FORBIDDEN = ("crime", "incident", "income", "pov", "nonwhite", "race", "demog", "tract")


def check(columns: Iterable[str]) -> list[str]:
    """The columns, or ValueError if one is a crime or demographic target."""
    cols = list(columns)
    if bad := [c for c in cols if any(f in c.lower() for f in FORBIDDEN)]:
        raise ValueError(f"validation targets can't be features: {bad}")
    return cols
