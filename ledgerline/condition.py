"""Conditions on one value: comparisons, membership, and their combinations."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

COMPARISONS = ("eq", "ne", "lt", "gt", "lte", "gte")


class Condition:
    """Base of all conditions; combine with and_, or_, not_, or the methods here."""

    def and_(self, *others: Condition) -> Condition:
        return and_(self, *others)

    def or_(self, *others: Condition) -> Condition:
        return or_(self, *others)

    def map(self, f: Callable[[object], object]) -> Condition:
        """The same condition on rewritten operands."""
        raise NotImplementedError


@dataclass(frozen=True)
class Compare(Condition):
    op: str
    value: object

    def map(self, f):
        return Compare(self.op, f(self.value))


@dataclass(frozen=True)
class Within(Condition):
    values: tuple

    def map(self, f):
        return Within(tuple(f(v) for v in self.values))


@dataclass(frozen=True)
class Every(Condition):
    parts: tuple[Condition, ...]

    def map(self, f):
        return Every(tuple(p.map(f) for p in self.parts))


@dataclass(frozen=True)
class Some(Condition):
    parts: tuple[Condition, ...]

    def map(self, f):
        return Some(tuple(p.map(f) for p in self.parts))


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    def map(self, f):
        return Not(self.part.map(f))


def eq(value) -> Condition:
    return Compare("eq", value)


def ne(value) -> Condition:
    return Compare("ne", value)


def lt(value) -> Condition:
    return Compare("lt", value)


def gt(value) -> Condition:
    return Compare("gt", value)


def lte(value) -> Condition:
    return Compare("lte", value)


def gte(value) -> Condition:
    return Compare("gte", value)


def in_(first, *more) -> Condition:
    """Any of the values equals: one collection, or the values themselves. An empty collection matches nothing."""
    values = first if not more and isinstance(first, Iterable) and not isinstance(first, (str, bytes)) else (first, *more)
    return Within(tuple(values))


def _lifted(parts: tuple) -> tuple[Condition, ...]:
    if not parts:
        raise ValueError("a combination needs conditions")
    return tuple(p if isinstance(p, Condition) else eq(p) for p in parts)


def and_(*parts) -> Condition:
    """All hold; a plain value stands for its eq()."""
    return Every(_lifted(parts))


def or_(*parts) -> Condition:
    """One holds; a plain value stands for its eq()."""
    return Some(_lifted(parts))


def not_(part) -> Condition:
    return Not(_lifted((part,))[0])


def holds(condition: Condition, actual: int) -> bool:
    """Evaluates a condition on a number, as write conditions need on the driver."""
    match condition:
        case Compare(op, v):
            return {"eq": actual == v, "ne": actual != v, "lt": actual < v, "gt": actual > v, "lte": actual <= v, "gte": actual >= v}[op]
        case Within(values):
            return actual in values
        case Every(parts):
            return all(holds(p, actual) for p in parts)
        case Some(parts):
            return any(holds(p, actual) for p in parts)
        case Not(part):
            return not holds(part, actual)
    raise TypeError(f"no condition: {condition!r}")


def operands(condition: Condition) -> list:
    match condition:
        case Compare(_, v):
            return [v]
        case Within(values):
            return list(values)
        case Every(parts) | Some(parts):
            return reduce(list.__add__, map(operands, parts), [])
        case Not(part):
            return operands(part)
    raise TypeError(f"no condition: {condition!r}")
