"""Reads of an event log: filtered scans, ordering and paging, counts, streams, positions, typed queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..condition import in_
from ..filter import Everything, Filter, TypeRegistry, references_payload, stream_read_filter, type_
from ..model import PositionRange
from ..plans.compile import predicate
from ..sort import SortBy, unsorted


@dataclass(frozen=True)
class EventStream:
    """A stream's events, ascending by version, and the version of the whole stream, 0 if it isn't there."""

    stream_id: str
    version: int
    events: DataFrame

    def is_empty(self) -> bool:
        return self.version == 0


def _not_negative(**kwargs: int | None) -> None:
    for name, v in kwargs.items():
        if v is not None and v < 0:
            raise ValueError(f"{name} is negative")


class EventQueries:
    """Queries over one log, a DataFrame of the envelope's columns."""

    def __init__(self, log: DataFrame, types: TypeRegistry | None = None, missing_ne: bool = False, strict: bool = False, payloads: bool = True):
        """payloads: whether payload conditions are supported; without, a filter that has one is refused."""
        self.log, self.types, self.payloads = log, types or TypeRegistry(), payloads
        self.options = {"missing_ne": missing_ne, "strict": strict}

    def _where(self, f: Filter | None) -> DataFrame:
        if f is None or isinstance(f, Everything):
            return self.log
        if not self.payloads and references_payload(f):
            raise ValueError("payload conditions aren't supported here")
        return self.log.where(predicate(f, self.log.columns, **self.options))

    def query(self, f: Filter | None = None, skip: int = 0, limit: int | None = None, sort: SortBy | None = None) -> DataFrame:
        """Events of a filter. Without a sort and paging, in no order at all: a sort of everything costs a shuffle that a caller may not need."""
        _not_negative(skip=skip, limit=limit)
        out = self._where(f)
        if sort is not None or skip or limit is not None:
            out = out.orderBy(*(sort or unsorted()).columns())
        if skip:
            out = out.offset(skip)
        return out if limit is None else out.limit(limit)

    def all(self, skip: int = 0, limit: int | None = None, sort: SortBy | None = None) -> DataFrame:
        return self.query(None, skip, limit, sort)

    def query_one(self, f: Filter | None = None, sort: SortBy | None = None) -> DataFrame:
        """The first event, as a DataFrame of one row or none."""
        return self.query(f, 0, 1, sort)

    def count(self, f: Filter | None = None) -> int:
        return self._where(f).count()

    def exists(self, f: Filter | None = None) -> bool:
        return bool(self._where(f).limit(1).count())

    # typed queries
    def of_types(self, *types: str, f: Filter | None = None, skip: int = 0, limit: int | None = None, sort: SortBy | None = None) -> DataFrame:
        """Events of the types and of all that stand under them. No types: no events."""
        if not types:
            return self.log.limit(0)
        own = type_(in_(self.types.expand(*types)))
        return self.query(own if f is None else own & f, skip, limit, sort)

    def decoded(self, schema: str, *types: str, f: Filter | None = None) -> DataFrame:
        """Events of the types with their payload read by a schema, as column payload."""
        return self.of_types(*types, f=f).withColumn("payload", F.from_json("data", schema))

    # streams
    def exists_stream(self, stream_id: str) -> bool:
        return bool(self.log.where(F.col("streamid") == stream_id).limit(1).count())

    def read_events(self, stream_id: str, f: Filter | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        """Events of a stream after version skip; limit counts what the filter leaves."""
        _not_negative(skip=skip, limit=limit)
        out = self.log.where((F.col("streamid") == stream_id) & (F.col("streamversion") > skip))
        if f is not None:
            out = out.where(predicate(stream_read_filter(f), self.log.columns, **self.options))
        out = out.orderBy("streamversion")
        return out if limit is None else out.limit(limit)

    def read(self, stream_id: str, f: Filter | None = None, skip: int = 0, limit: int | None = None) -> EventStream:
        events = self.read_events(stream_id, f, skip, limit)
        version = self.log.where(F.col("streamid") == stream_id).agg(F.max("streamversion")).first()[0]
        return EventStream(stream_id, version or 0, events)

    def stream_versions(self) -> DataFrame:
        """streamid, version and n of every stream, combined before the shuffle: no stream is read whole by one task."""
        return self.log.where(F.col("streamid").isNotNull()).groupBy("streamid").agg(F.max("streamversion").alias("version"), F.count("*").alias("n"))

    # positions
    def current_position(self) -> int:
        return self.log.agg(F.max("position")).first()[0] or 0

    def read_in_position_order(self, f: Filter | None = None, positions: PositionRange | None = None) -> DataFrame:
        """Events in a range of positions, ascending. The log is as of when it was read, so an open end needs no look at its head."""
        positions = positions or PositionRange()
        out = self._where(f).where(F.col("position") > positions.after)
        if positions.up_to is not None:
            out = out.where(F.col("position") <= positions.up_to)
        return out.orderBy("position")

    def after_position(self, position: int, f: Filter | None = None) -> DataFrame:
        return self.read_in_position_order(f, PositionRange(position))

    # ad-hoc aggregation
    def top_by_count(self, c, n: int = 1, f: Filter | None = None) -> DataFrame:
        """The n most frequent values of a column or expression (ties by value), with their count."""
        return self._where(f).groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)
