"""Texts cut at single spaces into units whose tokens don't depend on what stands around them, and a bounded memory of those tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

#: Units remembered by one Python worker, about 200 bytes each; when there are more, all are forgotten.
REMEMBERED = 400_000
#: Characters of a unit that is remembered; longer ones are forgotten with their texts.
LONGEST = 200


class Remembered:
    """Values of units, made in batches for those that are new."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], limit: int = REMEMBERED):
        self.make, self.limit, self.values, self.long = make, limit, {}, []

    def learn(self, texts: list[list[str]]) -> None:
        """From here to the next call, values holds every unit of texts."""
        for u in self.long:
            del self.values[u]
        if len(self.values) > self.limit:
            self.values.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.values))
        for i in range(0, len(new), 1 << 16):
            some = new[i : i + (1 << 16)]
            self.values.update(zip(some, self.make(some), strict=True))
        self.long = [u for u in new if len(u) > LONGEST]
