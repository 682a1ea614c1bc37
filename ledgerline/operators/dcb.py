"""Reads by type and tag criteria across streams, with a consistency token."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PositionRange, encode_tags, tag

FORWARD, BACKWARD = "forward", "backward"


@dataclass(frozen=True)
class Criterion:
    """Events of one of the types (any, if none), with all the tags, and not of the excluded types."""

    types: frozenset[str] = frozenset()
    tags: frozenset[str] = frozenset()
    excluding: frozenset[str] = frozenset()

    def __post_init__(self):
        if not self.types and not self.tags:
            raise ValueError("a criterion has a type or a tag")
        if any(not t.strip() for t in self.types | self.excluding):
            raise ValueError("types aren't blank")
        if self.types & self.excluding:
            raise ValueError(f"both asked for and excluded: {sorted(self.types & self.excluding)}")
        for t in self.tags:
            tag(t)

    def column(self) -> Column:
        """For DataFrame.where: null stands for false."""
        own = [F.col("dcbtags").isNotNull()]
        if self.types:
            own.append(F.col("type").isin(sorted(self.types)))
        if self.excluding:
            own.append(~F.col("type").isin(sorted(self.excluding)))
        own += [F.array_contains("dcbtags", t) for t in sorted(self.tags)]
        return reduce(Column.__and__, own)


@dataclass(frozen=True)
class Criteria:
    """Alternatives; none at all: every event with tags, though it be with none."""

    alternatives: tuple[Criterion, ...] = ()

    def column(self) -> Column:
        if not self.alternatives:
            return F.col("dcbtags").isNotNull()
        return reduce(Column.__or__, (c.column() for c in self.alternatives))

    def excluding_types(self, *types: str) -> Criteria:
        """The same, each alternative without these types."""
        if not self.alternatives:
            raise ValueError("everything can't exclude types")
        return Criteria(tuple(Criterion(c.types, c.tags, c.excluding | set(types)) for c in self.alternatives))

    def key(self) -> str:
        """A canonical string: lengths before names, in order, so that no two criteria share one."""
        part = lambda xs: "".join(f"{len(x)}:{x}" for x in sorted(xs))
        return "|".join(sorted(f"t{part(c.types)};g{part(c.tags)};x{part(c.excluding)}" for c in set(self.alternatives))) or "*"


def everything() -> Criteria:
    return Criteria()


def types(*names: str) -> Criteria:
    return Criteria((Criterion(types=frozenset(names)),))


def tags(*names: str) -> Criteria:
    """Events that carry all of the tags."""
    return Criteria((Criterion(tags=frozenset(tag(n) for n in names)),))


def criterion(types: tuple[str, ...] = (), tags: tuple[str, ...] = (), excluding: tuple[str, ...] = ()) -> Criteria:
    return Criteria((Criterion(frozenset(types), frozenset(tag(t) for t in tags), frozenset(excluding)),))


def tags_any_of(*names: str) -> Criteria:
    return any_of(*(tags(n) for n in names))


def any_of(*criteria: Criteria) -> Criteria:
    """One of the criteria; everything swallows the others."""
    if not criteria:
        raise ValueError("no criteria")
    if any(not c.alternatives for c in criteria):
        return Criteria()
    return Criteria(tuple(dict.fromkeys(a for c in criteria for a in c.alternatives)))


@dataclass(frozen=True)
class ReadOptions:
    positions: PositionRange = field(default_factory=PositionRange)
    direction: str = FORWARD
    skip: int = 0
    limit: int | None = None

    def __post_init__(self):
        if self.skip < 0 or (self.limit is not None and self.limit <= 0):
            raise ValueError("skip isn't negative, limit is positive")
        if self.direction not in (FORWARD, BACKWARD):
            raise ValueError(f"no direction: {self.direction}")


@dataclass(frozen=True)
class DcbStream:
    """Selected events, ascending; head: the log's last position, whatever matched; token: what an append condition checks from."""

    events: DataFrame
    head: int

    @property
    def token(self) -> int:
        return self.head


def _within(log: DataFrame, criteria: Criteria, positions: PositionRange) -> DataFrame:
    own = log.where(criteria.column())
    if positions.after:
        own = own.where(F.col("position") > positions.after)
    return own if positions.up_to is None else own.where(F.col("position") <= positions.up_to)


def select(log: DataFrame, criteria: Criteria, options: ReadOptions | None = None) -> DataFrame:
    """skip and limit count from the end that the direction begins at; the result ascends in either case."""
    options = options or ReadOptions()
    own = _within(log, criteria, options.positions)
    if options.skip or options.limit is not None:
        own = own.orderBy(F.col("position").desc() if options.direction == BACKWARD else F.col("position").asc())
        own = own.offset(options.skip) if options.skip else own
        own = own if options.limit is None else own.limit(options.limit)
    return own.orderBy("position")


def read(log: DataFrame, criteria: Criteria, options: ReadOptions | None = None) -> DcbStream:
    head = log.agg(F.max("position")).first()[0] or 0
    return DcbStream(select(log, criteria, options), head)


def count(log: DataFrame, criteria: Criteria, options: ReadOptions | None = None) -> int:
    """In the options' positions; direction, skip and limit don't count."""
    return _within(log, criteria, (options or ReadOptions()).positions).count()


def exists(log: DataFrame, criteria: Criteria, options: ReadOptions | None = None) -> bool:
    return bool(_within(log, criteria, (options or ReadOptions()).positions).limit(1).count())


def blocked(log: DataFrame, conditions: DataFrame) -> DataFrame:
    """Of append conditions, a row each (key, types and tags arrays, token): how many events fail it, those after the token of one of the types (any, if none) with all the tags. Conditions without a tag are refused.

    The join is on one tag of each condition, the one that the fewest events have; its other tags and the types are tested on what that leaves, and
    counts combine before the shuffle.
    """
    tags_ = F.array_sort("tags")
    tags_ = F.when(F.size("tags") > 0, tags_).otherwise(F.raise_error(F.lit("a condition has a tag")))
    asked = conditions.select("key", "token", F.coalesce("types", F.array().cast("array<string>")).alias("__types"), tags_.alias("__tags"))
    tagged = log.where("dcbtags is not null")
    seen = tagged.select(F.explode(F.array_distinct("dcbtags")).alias("__tag")).groupBy("__tag").agg(F.count("*").alias("__seen"))
    each = asked.select("*", F.posexplode("__tags").alias("__at", "__tag")).join(seen, "__tag", "left")
    rarest = F.min_by("__tag", F.struct(F.coalesce("__seen", F.lit(0)), F.col("__tag")))
    own = each.groupBy("key", "token", "__types", "__tags").agg(rarest.alias("__tag"), F.count_if(F.col("__at") == 0).alias("__rows"))
    events = tagged.select("position", "type", "dcbtags", F.explode(F.array_distinct("dcbtags")).alias("__tag"))
    fits = (F.col("position") > F.col("token")) & ((F.size("__types") == 0) | F.array_contains("__types", F.col("type"))) & (F.size(F.array_except("__tags", "dcbtags")) == 0)
    found = own.join(events, "__tag").where(fits).groupBy("key").agg(F.sum("__rows").alias("events"))
    return conditions.select("key").join(found, "key", "left").select("key", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def encoded_tags(c: Column) -> Column:
    """A tags array as sorted distinct lines."""
    return F.array_join(F.array_sort(F.array_distinct(c)), "\n")


def decoded_tags(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda t: t != "")


def tags_of(columns: dict[str, str]) -> Column:
    """A declared tag generator: {column: key} gives the tags key:value of the columns that aren't null, sorted."""
    found = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{tag(k)}:"), F.col(c).cast("string"))) for c, k in columns.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


PARTITIONS = 64


def stream_of(event_tags: list[str] | tuple[str, ...], prefix: str = "dcb-", partitions: int = PARTITIONS) -> str:
    """The stream that events of these tags are placed in: a jump hash of their checksum, so that more partitions move few events."""
    key = zlib.crc32(encode_tags(event_tags).encode())
    key |= (key * 0x9E3779B1 & 0xFFFFFFFF) << 32  # spreads 32 bits over 64
    bucket, nxt = -1, 0
    while nxt < partitions:
        bucket = nxt
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        nxt = int((bucket + 1) * (1 << 31) / ((key >> 33) + 1))
    return f"{prefix}{bucket}"
