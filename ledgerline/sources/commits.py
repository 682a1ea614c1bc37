"""What a store's commits say: the live parts, each with the range of its positions, and the head.

A commit names the parts that it adds and removes; every CHECKPOINT-th names all live ones, so that a state is read from few files and
a commit's size doesn't grow with the store.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

CHECKPOINT = 64


class Part(NamedTuple):
    """A folder of events with positions from lo to hi, both among them or beyond."""

    name: str
    lo: int
    hi: int


def commit_of(number: int, before: tuple[Part, ...], after: tuple[Part, ...], head: int) -> dict:
    if number % CHECKPOINT == 1:
        return {"parts": [list(p) for p in after], "head": head}
    return {"added": [list(p) for p in after if p not in before], "removed": [p.name for p in before if p not in after], "head": head}


def state_at(number: int, read: Callable[[int], dict]) -> tuple[tuple[Part, ...], int]:
    """Parts and head after a commit; read gives a commit by its number."""
    found = [read(number)]
    while "parts" not in found[-1]:
        found.append(read(number - len(found)))
    parts = {p[0]: Part(*p) for p in found[-1]["parts"]}
    for c in reversed(found[:-1]):
        for name in c["removed"]:
            parts.pop(name, None)
        parts |= {p[0]: Part(*p) for p in c["added"]}
    return tuple(parts.values()), found[0]["head"]


def overlapping(parts: tuple[Part, ...], after: int, up_to: int) -> list[Part]:
    """Parts that may have positions in (after, up_to]."""
    return [p for p in parts if p.hi > after and p.lo <= up_to]
