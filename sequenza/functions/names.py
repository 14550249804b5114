"""Column names that can't clash with those of a user's table."""

from __future__ import annotations

import itertools


def salted(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as keep it apart from the taken ones, upper and lower case being the same."""
    lower, out = {x.lower() for x in taken}, []
    for name in wanted:
        out.append(next(x for n in itertools.count(1) if (x := "_" * n + name).lower() not in lower))
    return out
