"""Filters on events: conditions on attributes, extensions and payload paths, and their combinations.

There is no negation of filters; negate the condition.
"""

from __future__ import annotations

from dataclasses import dataclass

from .condition import Compare, Condition, Every, Some, Within, eq, in_, not_
from .model import DCB, STREAM

DATA = "data."


class Filter:
    """Base of all filters; combine with & and |, or and_ and or_."""

    def and_(self, *others: Filter) -> Filter:
        return Both((self, *others))

    def or_(self, *others: Filter) -> Filter:
        return Either((self, *others))

    def __and__(self, other: Filter) -> Filter:
        return self.and_(other)

    def __or__(self, other: Filter) -> Filter:
        return self.or_(other)


@dataclass(frozen=True)
class Everything(Filter):
    pass


@dataclass(frozen=True)
class Field(Filter):
    """A condition on an attribute, on an extension by its name, or on a payload path after "data."."""

    name: str
    condition: Condition


@dataclass(frozen=True)
class Capability(Filter):
    kind: str

    def __post_init__(self):
        if self.kind not in (STREAM, DCB):
            raise ValueError(f"no capability: {self.kind}")


@dataclass(frozen=True)
class Both(Filter):
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Either(Filter):
    parts: tuple[Filter, ...]


def _condition(x) -> Condition:
    return x if isinstance(x, Condition) else eq(x)


def all_events() -> Filter:
    return Everything()


def field(name: str, condition) -> Filter:
    if not name or not name.strip():
        raise ValueError("a field has a name")
    return Field(name, _condition(condition))


def id_(x) -> Filter:
    return field("id", x)


def type_(x) -> Filter:
    return field("type", x)


def source(x) -> Filter:
    return field("source", x)


def subject(x) -> Filter:
    return field("subject", x)


def data_schema(x) -> Filter:
    return field("dataschema", x)


def data_content_type(x) -> Filter:
    return field("datacontenttype", x)


def time(x) -> Filter:
    return field("time", x)


def spec_version(x) -> Filter:
    return field("specversion", x)


def stream_id(x) -> Filter:
    return field("streamid", x)


def stream_version(x) -> Filter:
    return field("streamversion", x)


def data(path: str, x) -> Filter:
    """A condition on what a dotted path reaches in the JSON payload."""
    if not path or any(not p for p in path.split(".")):
        raise ValueError(f"no path: {path!r}")
    return field(DATA + path, x)


def cloud_event(id: str, source_: str) -> Filter:
    """The one event of an id and source."""
    return id_(id) & source(source_)


def capability(kind: str) -> Filter:
    return Capability(kind)


def references_payload(f: Filter) -> bool:
    match f:
        case Field(name, _):
            return name.startswith(DATA)
        case Both(parts) | Either(parts):
            return any(map(references_payload, parts))
    return False


def without_payload(f: Filter) -> Filter:
    """The filter with payload conditions taken as met, to check again what a store has filtered by them."""
    match f:
        case Field(name, _) if name.startswith(DATA):
            return Everything()
        case Both(parts):
            return Both(tuple(map(without_payload, parts)))
        case Either(parts):
            return Either(tuple(map(without_payload, parts)))
    return f


def stream_read_filter(f: Filter) -> Filter:
    """f, if it may narrow the read of one stream: it names neither the stream nor its versions."""
    match f:
        case Field(name, _) if name.strip().lower() in ("streamid", "streamversion"):
            raise ValueError(f"a stream read's filter can't be on {name.strip()}")
        case Capability(_):
            raise ValueError("a stream read's filter can't be on a capability")
        case Both(parts) | Either(parts):
            for p in parts:
                stream_read_filter(p)
    return f


def only_types(*types: str) -> Filter:
    """The types an application service reads."""
    return type_(in_(types))


def excluding_types(*types: str) -> Filter:
    return type_(not_(in_(types)))


def narrowed_types(f: Filter) -> frozenset[str] | None:
    """The finite set of types that f's events can have, or None if f doesn't narrow them (a partition pruning analysis)."""
    match f:
        case Field("type", c):
            return _types(c)
        case Both(parts):
            known = [t for t in map(narrowed_types, parts) if t is not None]
            return frozenset.intersection(*known) or None if known else None
        case Either(parts):
            known = [narrowed_types(p) for p in parts]
            return None if any(t is None for t in known) else frozenset.union(*known) or None
    return None


def _types(c: Condition) -> frozenset[str] | None:
    match c:
        case Compare("eq", v) if isinstance(v, str):
            return frozenset((v,))
        case Within(values) if values and all(isinstance(v, str) for v in values):
            return frozenset(values)
        case Every(parts):
            known = [t for t in map(_types, parts) if t is not None]
            return frozenset.intersection(*known) or None if known else None
        case Some(parts):
            known = [_types(p) for p in parts]
            return None if any(t is None for t in known) else frozenset.union(*known)
    return None


class TypeRegistry:
    """Event types by name of their parents: a query for a parent is one for all its concrete types. Open parents are refused."""

    def __init__(self, children: dict[str, list[str]] | None = None, open_types: set[str] | frozenset[str] = frozenset()):
        self.children, self.open = dict(children or {}), set(open_types)

    def expand(self, *types: str) -> list[str]:
        out: dict[str, None] = {}
        for t in types:
            if t in self.open:
                raise ValueError(f"{t} can have types that aren't known here")
            for x in self.expand(*self.children[t]) if t in self.children else [t]:
                out[x] = None
        return list(out)


