"""What a Python worker keeps between tasks: it outlives them, and idles with its memory beside the workers of other stages and the JVM."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Memory that is free in this process goes back to the system, as far as the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def giving_back(run: Callable[[Iterator], Iterator], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """run, over a task's batches; at the task's end, forget is called and memory given back."""

    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return held
