"""Filters to Spark columns.

Filters have two values: a comparison with null is false, ne with null true, and negation is that of two values. So every leaf
under a negation is made true or false before it is negated. Elsewhere a leaf may stay null for false: AND and OR of such leaves
select the same rows, and plain comparisons on the envelope reach the Parquet scan, as predicate() has them. where() gives a column that
is never null. Conjuncts on the envelope come before those on payloads.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..condition import Compare, Condition, Every, Not, Some, Within, operands
from ..filter import DATA, Both, Capability, Either, Everything, Field, Filter, references_payload
from ..functions.payload import false, matches, once, parsed, readings, true, values_in
from ..model import ATTRIBUTES, DCB, time_parts

LONGS = ("streamversion", "position")
COMPARE = {"eq": Column.__eq__, "lt": Column.__lt__, "gt": Column.__gt__, "lte": Column.__le__, "gte": Column.__ge__}


class StrictError(ValueError):
    """A range asked of a value that may be missing, in strict mode."""


def _leaf(name: str, c: Column, op: str, value, offset: Column | None, exact: bool) -> Column:
    """exact: never null."""
    if op == "ne":
        return ~_leaf(name, c, "eq", value, offset, True)
    if value is None:
        return c.isNull() if op == "eq" else false()
    if name == "time":
        if isinstance(value, str):
            from ..model import parse_time

            value = parse_time(value)
        if not isinstance(value, datetime):
            return false()
        instant, seconds = time_parts(value)
        own = COMPARE[op](c, F.lit(instant))
        if op == "eq" and offset is not None:
            own = own & (F.coalesce(offset, F.lit(0)) == seconds)
        elif op in ("lt", "gt", "lte", "gte") and offset is not None:
            # equal instants order by local time, which is by offset
            tie = (c == F.lit(instant)) & COMPARE[op](F.coalesce(offset, F.lit(0)), F.lit(seconds))
            strict = COMPARE[op[:2]](c, F.lit(instant))
            own = COMPARE[op[:2] + "e"](c, F.lit(instant)) & (strict | tie)
        return F.coalesce(own, false()) if exact else own
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if (name in LONGS) != number or not isinstance(value, (str, int, float, Decimal)) or isinstance(value, bool):
        return false()  # other types never match
    own = COMPARE[op](c, F.lit(value))
    return F.coalesce(own, false()) if exact else own


def _attribute(name: str, c: Column, condition: Condition, offset: Column | None, exact: bool) -> Column:
    match condition:
        case Compare(op, v):
            return _leaf(name, c, op, v, offset, exact)
        case Within(values):
            if values and name != "time" and all(isinstance(v, str) for v in values) and name not in LONGS:
                own = c.isin(list(values))
                return F.coalesce(own, false()) if exact else own
            return reduce(Column.__or__, (_leaf(name, c, "eq", v, offset, exact) for v in values), false())
        case Every(parts):
            return reduce(Column.__and__, (_attribute(name, c, p, offset, exact) for p in parts))
        case Some(parts):
            return reduce(Column.__or__, (_attribute(name, c, p, offset, exact) for p in parts))
        case Not(part):
            return ~_attribute(name, c, part, offset, True)
    raise TypeError(f"no condition: {condition!r}")


class Compiler:
    """For logs with these columns. missing_ne: whether ne holds on a missing payload path. strict: refuse ranges on subject, time and other nullable attributes. exact: columns are never null."""

    def __init__(self, columns: list[str], missing_ne: bool = False, strict: bool = False, exact: bool = True):
        self.columns, self.missing_ne, self.strict, self.exact = set(columns), missing_ne, strict, exact

    def column(self, f: Filter) -> Column:
        match f:
            case Everything():
                return true()
            case Field(name, condition) if not name.startswith(DATA):
                return self.attribute(name, condition)
            case Capability(kind):
                return F.col("dcbtags").isNotNull() if kind == DCB else F.col("dcbtags").isNull()
            case Both(parts):
                inner = [p for p in parts if references_payload(p)]
                outer = [self.column(p) for p in parts if not references_payload(p)]
                return reduce(Column.__and__, outer + ([self.payload(inner)] if inner else []))
            case Either(parts) if not references_payload(f):
                return reduce(Column.__or__, map(self.column, parts))
            case Field() | Either():
                return self.payload([f])
        raise TypeError(f"no filter: {f!r}")

    def attribute(self, name: str, condition: Condition) -> Column:
        known = name.lower() if name.lower() in ATTRIBUTES else name
        if known not in ATTRIBUTES:  # an extension
            return _attribute(known, F.col("ext")[known], condition, None, self.exact)
        if self.strict and known in ("subject", "time", "dataschema", "datacontenttype") and _has_range(condition):
            raise StrictError(f"{known} may be missing")
        if known not in self.columns:
            return _attribute(known, F.lit(None).cast("string"), condition, None, self.exact)
        offset = F.col("time_offset_s") if known == "time" and "time_offset_s" in self.columns else None
        return _attribute(known, F.col(known), condition, offset, self.exact)

    def payload(self, parts: list[Filter]) -> Column:
        """All of the filters, on one parse of the payload, or on a variant column data_v if the log has it. What a path reaches is read once for all conditions on it."""
        root = F.col("data_v") if "data_v" in self.columns else parsed(F.col("data"))
        if "datacontenttype" in self.columns:
            json = F.lower(F.col("datacontenttype")).rlike(r"^\s*(application|text)/([^;]*\+)?json\s*(;|$)")
            root = F.when(F.coalesce(json, true()), root)
        wanted: dict[str, list] = {}
        for p in parts:
            _paths(p, wanted)

        def bound(left: list[str], root: Column, found: dict[str, Column]) -> Column:
            if not left:
                return reduce(Column.__and__, (self._inner(p, found) for p in parts))
            path = left[0]
            return once(readings(values_in(root, path), wanted[path]), lambda values: bound(left[1:], root, {**found, path: values}))

        return once(root, lambda root: bound(list(wanted), root, {}))

    def _inner(self, f: Filter, found: dict[str, Column]) -> Column:
        match f:
            case Field(name, condition) if name.startswith(DATA):
                return matches(found[name.removeprefix(DATA)], condition, self.missing_ne)
            case Both(parts):
                return reduce(Column.__and__, (self._inner(p, found) for p in parts))
            case Either(parts):
                return reduce(Column.__or__, (self._inner(p, found) for p in parts))
        return self.column(f)


def _paths(f: Filter, wanted: dict[str, list]) -> None:
    """The payload paths of a filter, each with the operands it is compared with."""
    match f:
        case Field(name, condition) if name.startswith(DATA):
            wanted.setdefault(name.removeprefix(DATA), []).extend(operands(condition))
        case Both(parts) | Either(parts):
            for p in parts:
                _paths(p, wanted)


def _has_range(c: Condition) -> bool:
    match c:
        case Compare(op, _):
            return op in ("lt", "gt", "lte", "gte")
        case Every(parts) | Some(parts):
            return any(map(_has_range, parts))
        case Not(part):
            return _has_range(part)
    return False


def where(f: Filter, columns: list[str], missing_ne: bool = False, strict: bool = False) -> Column:
    """True or false for each event."""
    return Compiler(columns, missing_ne, strict).column(f)


def predicate(f: Filter, columns: list[str], missing_ne: bool = False, strict: bool = False) -> Column:
    """For DataFrame.where: null stands for false."""
    return Compiler(columns, missing_ne, strict, exact=False).column(f)
