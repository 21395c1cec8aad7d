"""What the operators share: intermediate tables, checked broadcasts, and names that no input column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewalk.plans.tables import clean, cut, discard, release, shared_folder

__all__ = ["checked", "clean", "cut", "discard", "fresh", "release", "shared_folder", "without"]

#: Ids that are broadcast at most (16 MB as numbers); more are joined by shuffling.
MOST_IDS = 2_000_000


def checked(ids: DataFrame) -> DataFrame:
    """A table of one column of ids, marked for broadcast if it has MOST_IDS rows at most; it is counted, so it should be cheap to read."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def without(columns: Iterable[str], names: Iterable[str | None]) -> list[str]:
    """The columns that are none of the names, whatever the case."""
    low = {n.lower() for n in names if n}
    return [c for c in columns if c.lower() not in low]


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores at its end until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
