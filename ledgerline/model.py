"""The event envelope, position ranges, tags, metadata and times."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

#: One row per event. data is JSON text (or null); dcbtags is null for events of streams only, empty for DCB events without tags.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("specversion", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("subject", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("time_offset_s", T.IntegerType()),
        T.StructField("dataschema", T.StringType()),
        T.StructField("datacontenttype", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("streamid", T.StringType()),
        T.StructField("streamversion", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("appendid", T.StringType()),
        T.StructField("dcbtags", T.ArrayType(T.StringType())),
        T.StructField("ext", T.MapType(T.StringType(), T.StringType())),
    ]
)
ATTRIBUTES = ("id", "source", "specversion", "type", "subject", "time", "dataschema", "datacontenttype", "streamid", "streamversion", "position", "appendid")
STAMPS = ("streamid", "streamversion", "position", "appendid", "dcbtags")
STREAM, DCB = "STREAM", "DCB"


@dataclass(frozen=True)
class PositionRange:
    """Positions after the first bound, up to and with the second; None is open."""

    after: int = 0
    up_to: int | None = None

    def __post_init__(self):
        if self.after < 0 or (self.up_to is not None and self.up_to < 0):
            raise ValueError("positions aren't negative")
        if self.up_to is not None and self.up_to < self.after:
            raise ValueError("a range ends at or after its beginning")


@dataclass(frozen=True)
class Event:
    """An event to write. time: aware datetime; data: JSON-able value or JSON text; tags: only for DCB appends."""

    id: str
    type: str
    source: str = "urn:ledgerline"
    subject: str | None = None
    time: datetime | None = None
    data: object = None
    dataschema: str | None = None
    datacontenttype: str | None = None
    tags: tuple[str, ...] | None = None
    ext: dict[str, str] = field(default_factory=dict)


def tag(value: str, of: str | None = None) -> str:
    """A checked tag, value or of:value: stripped, not blank, one line; a key has no colon."""
    parts = [value] if of is None else [of, value]
    for p in parts:
        if not p.strip() or "\n" in p or "\r" in p:
            raise ValueError(f"no tag: {p!r}")
    if of is not None and ":" in of:
        raise ValueError("a tag's key has no colon")
    return ":".join(p.strip() for p in parts)


def encode_tags(tags: list[str] | tuple[str, ...]) -> str:
    """Sorted distinct tags, one per line."""
    return "\n".join(sorted({tag(t) for t in tags}))


def decode_tags(text: str | None) -> list[str]:
    return [t for t in (text or "").split("\n") if t]


_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d)(:\d\d)?(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)")


def parse_time(text: str) -> datetime:
    """An RFC 3339 time. Finer parts than microseconds are refused, not rounded."""
    m = _RFC3339.fullmatch(text)
    if not m:
        raise ValueError(f"no RFC 3339 time: {text!r}")
    day, minute, second, fraction, zone = m.groups()
    fraction = (fraction or "").ljust(9, "0")
    if fraction[6:] != "000":
        raise ValueError(f"finer than microseconds: {text!r}")
    return datetime.fromisoformat(f"{day}T{minute}{second or ':00'}.{fraction[:6]}{'+00:00' if zone in 'Zz' else zone}")


def format_time(t: datetime) -> str:
    """The fixed-width RFC 3339 form, so that strings of one offset order as times do."""
    out = t.strftime("%Y-%m-%dT%H:%M:%S.%f") + "000"
    offset = t.utcoffset() or timedelta(0)
    if not offset:
        return out + "Z"
    minutes = int(offset.total_seconds() // 60)
    return f"{out}{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def time_parts(t: datetime | None) -> tuple[datetime | None, int | None]:
    """The instant as a UTC datetime, and the offset in seconds; a naive time is UTC."""
    if t is None:
        return None, None
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return t.astimezone(timezone.utc), int(t.utcoffset().total_seconds())
