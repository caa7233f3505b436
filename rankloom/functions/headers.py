"""Fuzzy resolution of column names, on metadata only."""

from __future__ import annotations

import re
from collections.abc import Sequence


def normal_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def find_column(columns: Sequence[str], keywords: Sequence[str], required: bool = True) -> str | None:
    """The first column that a keyword names: exactly, else as its prefix, else inside it; by normalised names."""
    tests = (lambda c, k: c == k, lambda c, k: c.startswith(k), lambda c, k: k in c)
    for test in tests:
        for k in map(normal_name, keywords):
            for c in columns:
                if test(normal_name(c), k):
                    return c
    if required:
        raise KeyError(f"none of {list(keywords)} among {list(columns)}")
    return None


def exact_column(columns: Sequence[str], names: Sequence[str]) -> str:
    """The column that the first of some names is, by normalised names; nothing less than the whole name counts, and two such columns are refused."""
    for name in names:
        found = [c for c in columns if normal_name(c) == normal_name(name)]
        if len(found) > 1:
            raise ValueError(f"{found} are all called {name}")
        if found:
            return found[0]
    raise KeyError(f"none of {list(names)} among {list(columns)}")


def match_feature(columns: Sequence[str], symbol: str) -> str | None:
    """The column of a feature in a wide matrix: its symbol or a token in parentheses, else a whole word; the first wins."""
    want = symbol.strip().upper()
    for c in columns:
        tokens = [c.split("(")[0].strip().upper(), *(t.strip().upper() for t in re.findall(r"\(([^)]*)\)", c))]
        if want in tokens:
            return c
    word = re.compile(rf"(?<![A-Z0-9]){re.escape(want)}(?![A-Z0-9])")
    return next((c for c in columns if word.search(c.upper())), None)


def require_columns(columns: Sequence[str], needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
