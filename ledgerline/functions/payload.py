"""JSON payloads as Spark expressions: dotted paths that run through arrays, and comparisons that mind types.

All is built-in functions over VARIANT. A path gives the array of all values it reaches: a segment on an array applies to each of
its objects, a last value that is an array counts by its elements. Absent paths, paths past a scalar, payloads that are no
JSON or no object, and a root array give an empty array.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..condition import Compare, Condition, Every, Not, Some, Within

def false() -> Column:
    return F.lit(False)


def true() -> Column:
    return F.lit(True)


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _key(segment: str) -> str:
    if "'" in segment or '"' in segment or "\\" in segment:
        raise ValueError(f"quotes can't be in a path: {segment!r}")
    return f"$['{segment}']"


def parsed(data: Column) -> Column:
    """JSON text as a variant, null if it is none. A variant has no repeated keys: of such an object, the first of each is kept."""
    found = F.from_json(data, "map<string,variant>")
    keys = F.map_keys(found)
    first = F.filter(F.map_entries(found), lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.coalesce(F.try_parse_json(data), F.to_variant_object(F.map_from_entries(first)))


def _get(v: Column, segment: str) -> Column:
    return F.try_variant_get(v, _key(segment), "variant")


def _step(values: Column, segment: str) -> Column:
    found = F.flatten(F.transform(values, lambda v: F.coalesce(F.transform(_elements(v), lambda x: _get(x, segment)), F.array(_get(v, segment)))))
    return F.filter(found, lambda v: v.isNotNull())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often it stands there: a lambda's variable is bound to it."""
    return F.exists(F.array(value), use)


def values_at(data: Column, path: str) -> Column:
    """array<variant>: what the path reaches in JSON text, elements of a last array each."""
    return values_in(parsed(data), path)


def values_in(root: Column, path: str) -> Column:
    """The same in a variant."""
    first, *rest = path.split(".")
    out = F.array_compact(F.array(_get(root, first)))  # of no object, there is none
    for segment in rest:
        out = _step(out, segment)
    out = F.flatten(F.transform(out, lambda v: F.coalesce(_elements(v), F.array(v))))
    return F.coalesce(out, F.array().cast("array<variant>"))


def readings(values: Column, operands: list) -> Column:
    """Of each value its kind, and itself as what the operands are, so that several conditions read it once."""
    kinds = {"flag" if isinstance(v, bool) else "number" if isinstance(v, (int, float, Decimal)) else "text" if isinstance(v, str) else "other" for v in operands}

    def read(v: Column) -> Column:
        as_ = lambda t, kind: F.try_variant_get(v, "$", t) if kind in kinds else F.lit(None).cast(t)
        return F.struct(_kind(v).alias("k"), as_("double", "number").alias("d"), as_("decimal(38,9)", "number").alias("n"), as_("string", "text").alias("s"), as_("boolean", "flag").alias("b"))

    return F.transform(values, read)


def scalar_text(data: Column, path: str) -> Column:
    """The first value a path reaches, as text."""
    return F.try_variant_get(F.get(values_at(data, path), F.lit(0)), "$", "string")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(x: Column) -> Column:
    k = x["k"]
    return k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")


def _number(x: Column, op: str, value) -> Column:
    """Numbers compare by value: exactly up to nine decimals, by double beyond."""
    a, y = x["d"], F.lit(float(value))
    if isinstance(value, float) and not math.isfinite(value):
        return _is_number(x) & _compare(a, op, y)
    exact = Decimal(str(value))
    if abs(exact) >= Decimal(10) ** 28 or exact.normalize().as_tuple().exponent < -9:
        return _is_number(x) & F.coalesce(_compare(a, op, y), false())
    n, b = x["n"], F.lit(exact).cast("decimal(38,9)")
    same = F.when(n.isNull(), a == y).otherwise((n == b) & (a == y))
    if op == "eq":
        out = same
    elif op == "ne":
        out = ~same
    else:
        out = F.when(n.isNull() | (n == b), _compare(a, op, y)).otherwise(_compare(n, op, b))
    return _is_number(x) & F.coalesce(out, false())


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "lt": a < b, "gt": a > b, "lte": a <= b, "gte": a >= b}[op]


def _one(x: Column, op: str, value) -> Column:
    """A comparison of one reading with an operand of its own type; other types never match, without an error."""
    if isinstance(value, bool):
        out = (x["k"] == "BOOLEAN") & _compare(x["b"], op, F.lit(value))
    elif isinstance(value, (int, float, Decimal)):
        out = _number(x, op, value)
    elif isinstance(value, str):
        out = (x["k"] == "STRING") & _compare(x["s"], op, F.lit(value))
    elif value is None:
        out = (x["k"] == "VOID") if op == "eq" else false()
    else:
        out = false()
    return F.coalesce(out, false())


def matches(found: Column, condition: Condition, missing_ne: bool = False) -> Column:
    """A condition on the readings of a path, true or false. eq, in and ranges hold if one value's does; ne if none is equal, and the path is there (or missing_ne)."""
    match condition:
        case Compare("ne", v):
            some = F.exists(found, lambda x: _one(x, "eq", v))
            return ~some if missing_ne else (F.size(found) > 0) & ~some
        case Compare(op, v):
            return F.exists(found, lambda x: _one(x, op, v))
        case Within(operands):
            out = false()
            for v in operands:
                out = out | matches(found, Compare("eq", v))
            return out
        case Every(parts):
            out = true()
            for p in parts:
                out = out & matches(found, p, missing_ne)
            return out
        case Some(parts):
            out = false()
            for p in parts:
                out = out | matches(found, p, missing_ne)
            return out
        case Not(part):
            return ~matches(found, part, missing_ne)
    raise TypeError(f"no condition: {condition!r}")
