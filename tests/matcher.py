"""A plain two-valued matcher of filters on event dicts, to hold the compiler against."""

import json
from datetime import datetime
from decimal import Decimal

from ledgerline.condition import Compare, Every, Not, Some, Within
from ledgerline.filter import DATA, Both, Capability, Either, Everything, Field

OPS = {"lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "gte": lambda a, b: a >= b}


def number(x):
    return isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)


def same(a, b):
    if number(a) and number(b):
        return Decimal(str(a)) == Decimal(str(b))
    return type(a) is type(b) and a == b


def comparable(a, b):
    return (number(a) and number(b)) or (isinstance(a, str) and isinstance(b, str)) or (isinstance(a, datetime) and isinstance(b, datetime)) or (isinstance(a, bool) and isinstance(b, bool))


def reach(value, path):
    """All values of a path; arrays on the way and at its end are run through."""
    values = [value]
    for p in path.split("."):
        found = []
        for v in values:
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict) and p in x:
                    found.append(x[p])
        values = found
    return [x for v in values for x in (v if isinstance(v, list) else [v])]


def holds(c, values, payload):
    match c:
        case Compare("eq", v):
            return any(same(x, v) or (x is None and v is None) for x in values)
        case Compare("ne", v):
            return (bool(values) or not payload) and not any(same(x, v) for x in values)
        case Compare(op, v):
            return any(comparable(x, v) and OPS[op](x, v) for x in values)
        case Within(vs):
            return any(same(x, v) for x in values for v in vs)
        case Every(parts):
            return all(holds(p, values, payload) for p in parts)
        case Some(parts):
            return any(holds(p, values, payload) for p in parts)
        case Not(p):
            return not holds(p, values, payload)


def matches(f, event):
    match f:
        case Everything():
            return True
        case Field(name, c) if name.startswith(DATA):
            try:
                data = json.loads(event["data"]) if event["data"] else None
            except ValueError:
                data = None
            return holds(c, reach(data, name.removeprefix(DATA)) if isinstance(data, dict) else [], True)
        case Field(name, c):
            return holds(c, [event.get(name)], False)
        case Capability(kind):
            return (event["dcbtags"] is not None) == (kind == "DCB")
        case Both(parts):
            return all(matches(p, event) for p in parts)
        case Either(parts):
            return any(matches(p, event) for p in parts)
