"""Orders of events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filter import DATA

ASC, DESC = "asc", "desc"
NATURAL = "natural"
SORTABLE = ("id", "source", "specversion", "type", "subject", "time", "dataschema", "datacontenttype", "streamid", "streamversion")


@dataclass(frozen=True)
class SortBy:
    """Keys in order of precedence: (field or NATURAL, direction). No keys: natural order."""

    keys: tuple[tuple[str, str], ...] = ()

    def then(self, other: SortBy | str, direction: str = ASC) -> SortBy:
        return SortBy(self.keys + (other.keys if isinstance(other, SortBy) else by(other, direction).keys))

    def then_time(self, direction: str = ASC) -> SortBy:
        return self.then("time", direction)

    def then_stream_version(self, direction: str = ASC) -> SortBy:
        return self.then("streamversion", direction)

    def then_natural(self, direction: str = ASC) -> SortBy:
        return SortBy(self.keys + ((NATURAL, direction),))

    def columns(self, insertion: str = "position") -> list[Column]:
        """Spark's null order is the one asked for: nulls first ascending, last descending."""
        out = []
        for name, direction in self.keys or ((NATURAL, ASC),):
            if name == NATURAL:
                c = F.col(insertion)
            elif name.startswith(DATA):
                from .functions.payload import scalar_text

                c = scalar_text(F.col("data"), name.removeprefix(DATA))
            elif name in SORTABLE:
                c = F.col(name)
            else:
                raise ValueError(f"events can't be sorted by {name}")
            out.append(c.asc() if direction == ASC else c.desc())
        return out


def _checked(direction: str) -> str:
    if direction not in (ASC, DESC):
        raise ValueError(f"no direction: {direction}")
    return direction


def unsorted() -> SortBy:
    return SortBy()


def natural(direction: str = ASC) -> SortBy:
    return SortBy(((NATURAL, _checked(direction)),))


def by(name: str, direction: str = ASC) -> SortBy:
    return SortBy(((name, _checked(direction)),))


def time(direction: str = ASC) -> SortBy:
    return by("time", direction)


def stream_version(direction: str = ASC) -> SortBy:
    return by("streamversion", direction)


def ascending(*names: str) -> SortBy:
    return SortBy(tuple((n, ASC) for n in names))


def descending(*names: str) -> SortBy:
    return SortBy(tuple((n, DESC) for n in names))
