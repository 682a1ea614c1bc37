"""Retries with backoff."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Retry:
    """attempts: in all, None for no end; backoff: initial seconds, factor and most seconds (factor 1: fixed; initial 0: none)."""

    attempts: int | None = 5
    initial: float = 0.1
    factor: float = 2.0
    most: float = 2.0
    retry_if: Callable[[Exception], bool] = lambda e: True
    map_error: Callable[[Exception], Exception] = lambda e: e
    listeners: tuple[Callable[[int, Exception], None], ...] = ()
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    @staticmethod
    def none() -> Retry:
        return Retry(attempts=1)

    @staticmethod
    def fixed(seconds: float, attempts: int | None = None) -> Retry:
        return Retry(attempts, seconds, 1.0, seconds)

    @staticmethod
    def exponential(initial: float, most: float, factor: float = 2.0, attempts: int | None = None) -> Retry:
        return Retry(attempts, initial, factor, most)

    def with_(self, **kwargs) -> Retry:
        return replace(self, **kwargs)

    def waits(self) -> Iterator[float]:
        wait = self.initial
        while True:
            yield min(wait, self.most)
            wait = min(wait * self.factor, self.most)

    def run(self, f: Callable[[], object]) -> object:
        waits, n = self.waits(), 0
        while True:
            n += 1
            try:
                return f()
            except Exception as e:
                if (self.attempts is not None and n >= self.attempts) or not self.retry_if(e):
                    raise self.map_error(e) from e
                for listener in self.listeners:
                    listener(n, e)
                self.sleep(next(waits))
