"""A writable event log: Parquet parts and a list of commits.

A commit is a file commits/c-<n> that is created exclusively: of two writers of the same n, one succeeds, and the other reads the
new state, checks its condition again and retries. Commits add and remove parts, each with the range of its positions, and name the log's
head (see commits). A write adds one part; deletes and updates write the parts that hold the events anew, and leave the
others. Parts are sorted by position; reads of position ranges leave out parts beyond them, and read few row groups of the others.

Versions of a stream go on from its last remaining event, and start at 1 again once it is empty; positions are never used twice.
An event's (id, source) is unique in the whole store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..condition import Condition, eq, holds
from ..filter import Filter, cloud_event, stream_id as stream_filter
from ..model import EVENT_SCHEMA, STAMPS, Event, encode_tags, time_parts
from ..operators import dcb
from ..operators.queries import EventQueries
from ..plans.compile import where
from .commits import Part, commit_of, overlapping, state_at
from .files import Folder

ATTEMPTS = 50
#: Of a part's files, so that a read of few positions reads few rows.
ROW_GROUP_ROWS = 10_000
SPEC = "1.0"


class WriteConditionNotFulfilled(Exception):
    def __init__(self, stream_id: str, version: int, condition: Condition):
        super().__init__(f"{stream_id} is at version {version}, which doesn't meet {condition}")
        self.stream_id, self.version, self.condition = stream_id, version, condition


class AppendConditionNotFulfilled(Exception):
    pass


class DuplicateEvent(Exception):
    pass


class Contended(Exception):
    """Other writers were first, too many times."""


class StoreChanged(AppendConditionNotFulfilled):
    """Anything at all was appended after the token of a whole-store condition."""


@dataclass(frozen=True)
class WriteResult:
    stream_id: str
    old_version: int
    new_version: int
    append_id: str | None


@dataclass(frozen=True)
class AppendResult:
    first_position: int
    last_position: int
    count: int
    append_id: str


@dataclass(frozen=True)
class AppendCondition:
    """Fails if events match the criteria after the token's position; without a token, at any position. whole_store: fails if any event of the store, with tags or none, came after the token."""

    criteria: dcb.Criteria
    token: int = 0
    whole_store: bool = False


@dataclass(frozen=True)
class _State:
    number: int
    parts: tuple[Part, ...]
    head: int


def version_is(version: int) -> Condition:
    return eq(version)


class EventStore:
    def __init__(self, spark: SparkSession, path: str, listeners: tuple[Callable[[DataFrame], None], ...] = ()):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits, self.data = Folder(spark, f"{self.path}/commits"), Folder(spark, f"{self.path}/data")
        self.listeners = list(listeners)

    # state
    def _state(self) -> _State:
        n = self.commits.last("c")
        if n is None:
            return _State(0, (), 0)
        return _State(n, *state_at(n, lambda k: json.loads(self.commits.read_text(f"c-{k:012d}"))))

    def _read(self, parts: tuple[Part, ...] | list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(*[f"{self.path}/data/{p.name}" for p in parts])

    def log(self) -> DataFrame:
        """All events as of now."""
        return self._read(self._state().parts)

    def positions(self, after: int = 0, up_to: int | None = None) -> DataFrame:
        """Events of a range of positions, from the parts that may have some."""
        state = self._state()
        up_to = state.head if up_to is None else up_to
        return self._read(overlapping(state.parts, after, up_to)).where((F.col("position") > after) & (F.col("position") <= up_to))

    def queries(self, **kwargs) -> EventQueries:
        return EventQueries(self.log(), **kwargs)

    def current_position(self) -> int:
        """The head, without a scan; 0 before the first event."""
        return self._state().head

    def _commit(self, state: _State, parts: tuple[Part, ...], head: int) -> bool:
        n = state.number + 1
        return self.commits.create(f"c-{n:012d}", json.dumps(commit_of(n, state.parts, parts, head)))

    def _put(self, rows: DataFrame, lo: int, hi: int) -> Part:
        part = Part(f"p-{uuid.uuid4().hex}", lo, hi)
        rows.select(EVENT_SCHEMA.names).sortWithinPartitions("position").write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(f"{self.path}/data/{part.name}")
        return part

    # writes
    def _rows(self, events: list[Event], stream_of: Callable[[Event], tuple[str, int | None]], first_position: int, append_id: str) -> DataFrame:
        rows = []
        for i, e in enumerate(events):
            instant, offset = time_parts(e.time)
            data = e.data if e.data is None or isinstance(e.data, str) else json.dumps(e.data, ensure_ascii=False)
            stream, version = stream_of(e)
            tags = None if e.tags is None else sorted(set(e.tags))
            rows.append((e.id, e.source, SPEC, e.type, e.subject, instant, offset, e.dataschema, e.datacontenttype, data, stream, version, first_position + i, append_id, tags, e.ext or None))
        return self.spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1)

    def _refuse_duplicates(self, log: DataFrame, events: list[Event]) -> None:
        keys = [(e.id, e.source) for e in events]
        if len(set(keys)) < len(keys):
            raise DuplicateEvent("an event is in the batch twice")
        own = self.spark.createDataFrame(keys, "id string, source string")
        found = log.where(F.col("id").isin([k[0] for k in keys])).join(F.broadcast(own), ["id", "source"], "left_semi").select("id", "source").first()
        if found:
            raise DuplicateEvent(f"{found.id} of {found.source} is in the log")

    def write(self, stream_id: str, events: list[Event], condition: Condition | int | None = None) -> WriteResult:
        """Appends to a stream. condition is on its version before: an exact one, or any condition; None: whatever it is."""
        if any(e.tags is not None for e in events):
            raise ValueError("events with tags go through append()")
        condition = eq(condition) if isinstance(condition, int) else condition
        for _ in range(ATTEMPTS):
            state = self._state()
            log = self._read(state.parts)
            version = log.where(F.col("streamid") == stream_id).agg(F.max("streamversion")).first()[0] or 0
            if condition is not None and not holds(condition, version):
                raise WriteConditionNotFulfilled(stream_id, version, condition)
            if not events:
                return WriteResult(stream_id, version, version, None)
            self._refuse_duplicates(log, events)
            append_id, versions = str(uuid.uuid4()), iter(range(version + 1, version + 1 + len(events)))
            if self._add(state, self._rows(events, lambda e: (stream_id, next(versions)), state.head + 1, append_id), len(events)):  # noqa: B023
                return WriteResult(stream_id, version, version + len(events), append_id)
        raise Contended(stream_id)

    def append(self, events: list[Event], condition: AppendCondition | None = None, stream_of: Callable[[list[str]], str] = dcb.stream_of) -> AppendResult:
        """Appends events by their tags, if no event that the condition names has come since its token."""
        if not events:
            raise ValueError("an append has events")
        events = [e if e.tags is None else Event(**{**e.__dict__, "tags": tuple(encode_tags(e.tags).split("\n")) if e.tags else ()}) for e in events]
        for _ in range(ATTEMPTS):
            state = self._state()
            log = self._read(state.parts)
            if condition is not None and condition.whole_store and state.head > condition.token:
                raise StoreChanged(f"the store is at {state.head}, not at {condition.token}")
            if condition is not None and not self._read(overlapping(state.parts, condition.token, state.head)).where((F.col("position") > condition.token) & condition.criteria.column()).isEmpty():
                raise AppendConditionNotFulfilled(condition.criteria.key())
            self._refuse_duplicates(log, events)
            streams = {stream_of(list(e.tags or ())) for e in events}
            last = dict(log.where(F.col("streamid").isin(sorted(streams))).groupBy("streamid").agg(F.max("streamversion")).collect())  # a row per stream of this append

            def placed(e: Event) -> tuple[str, int]:
                stream = stream_of(list(e.tags or ()))
                last[stream] = (last.get(stream) or 0) + 1  # noqa: B023
                return stream, last[stream]  # noqa: B023

            append_id = str(uuid.uuid4())
            tagged = [e if e.tags is not None else Event(**{**e.__dict__, "tags": ()}) for e in events]
            if self._add(state, self._rows(tagged, placed, state.head + 1, append_id), len(events)):
                return AppendResult(state.head + 1, state.head + len(events), len(events), append_id)
        raise Contended("append")

    def append_frame(self, events: DataFrame, stream: str, order: list[str]) -> AppendResult | None:
        """Bulk append of a DataFrame of events (envelope columns without stamps) to the streams in a column, versions and positions given in order. Refuses events that are in the log or twice in the frame."""
        from pyspark.sql import Window

        from .event_log import numbered
        from .shared import discard, written

        events = written(events, "bulk")  # one and the same in all steps
        n = events.count()
        if not n:
            return None
        if not events.groupBy("id", "source").agg(F.count("*").alias("__many")).where("__many > 1").isEmpty():
            raise DuplicateEvent("an event is in the frame twice")
        for _ in range(ATTEMPTS):
            state = self._state()
            log = self._read(state.parts)
            if not events.join(log.select("id", "source"), ["id", "source"], "left_semi").isEmpty():
                raise DuplicateEvent("events of the frame are in the log")
            append_id = str(uuid.uuid4())
            streams = events.select(F.col(stream).alias("streamid")).distinct()
            last = log.join(streams, "streamid", "left_semi").groupBy("streamid").agg(F.max("streamversion").alias("__last"))
            rows = numbered(events, order, "position", state.head).withColumnRenamed(stream, "streamid").join(last, "streamid", "left")
            rows = rows.withColumn("streamversion", F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy("streamid").orderBy("position"))).withColumn("appendid", F.lit(append_id))
            have = set(rows.columns)
            rows = rows.select(*[(F.col(f.name) if f.name in have else F.lit(SPEC if f.name == "specversion" else None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])
            if self._add(state, rows, n):
                discard(events)
                return AppendResult(state.head + 1, state.head + n, n, append_id)
        raise Contended("bulk append")

    def _add(self, state: _State, rows: DataFrame, n: int) -> bool:
        part = self._put(rows, state.head + 1, state.head + n)
        if not self._commit(state, (*state.parts, part), state.head + n):
            self.data.delete(part.name)
            return False
        for listener in self.listeners:
            listener(self._read([part]))
        return True

    # deletes and updates
    def _holding(self, state: _State, f: Filter) -> dict[str, int]:
        """The parts that hold events of f, and how many: one job over all parts."""
        if not state.parts:
            return {}
        part = F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/", 1).alias("part")
        return {r["part"]: r["count"] for r in self._read(state.parts).where(where(f, EVENT_SCHEMA.names)).groupBy(part).count().collect()}

    def _rewrite(self, state: _State, hit: dict[str, int], change: Callable[[DataFrame], DataFrame]) -> bool:
        """Replaces parts by what change makes of their rows; False if another writer was first."""
        old = [p for p in state.parts if p.name in hit]
        part = self._put(change(self._read(old)), min(p.lo for p in old), max(p.hi for p in old))
        if self._commit(state, (*(p for p in state.parts if p not in old), part), state.head):
            return True
        self.data.delete(part.name)
        return False

    def delete(self, f: Filter) -> int:
        """How many events went."""
        for _ in range(ATTEMPTS):
            state = self._state()
            found = self._holding(state, f)
            if not found or self._rewrite(state, found, lambda rows: rows.where(~where(f, EVENT_SCHEMA.names))):
                return sum(found.values())
        raise Contended("delete")

    def delete_stream(self, stream_id: str) -> int:
        """A stream that isn't there is no error."""
        return self.delete(stream_filter(stream_id))

    def delete_event(self, id: str, source: str) -> int:
        return self.delete(cloud_event(id, source))

    def update_event(self, id: str, source: str, change: Callable[[dict], dict]) -> dict | None:
        """Replaces an event by what change makes of it; its stream, version, position, append id and tags stay. None if there is none. After a lost commit, change gets the event as it is then."""
        f = cloud_event(id, source)
        for _ in range(ATTEMPTS):
            state = self._state()
            log = self._read(state.parts)
            row = log.where(where(f, EVENT_SCHEMA.names)).first()
            if row is None:
                return None
            old = row.asDict(recursive=True)
            new = change(dict(old))
            if new is None:
                raise ValueError("an update gives an event")
            new = {**old, **new, **{k: old[k] for k in STAMPS}}
            if not isinstance(new["data"], (str, type(None))):
                new["data"] = json.dumps(new["data"], ensure_ascii=False)
            if new == old:
                return old
            if (new["id"], new["source"]) != (id, source) and not log.where(where(cloud_event(new["id"], new["source"]), EVENT_SCHEMA.names)).isEmpty():
                raise DuplicateEvent(f"{new['id']} of {new['source']} is in the log")
            changed = self.spark.createDataFrame([tuple(new[n] for n in EVENT_SCHEMA.names)], EVENT_SCHEMA)
            if self._rewrite(state, self._holding(state, f), lambda rows: rows.where(~where(f, EVENT_SCHEMA.names)).union(changed)):  # noqa: B023
                return new
        raise Contended("update")

    def copied(self, path: str) -> EventStore:
        """A store of the same events with the same stamps elsewhere, to be changed apart."""
        state, out = self._state(), EventStore(self.spark, path)
        part = out._put(self._read(state.parts), 1, state.head)
        if not out._commit(_State(0, (), 0), (part,), state.head):
            raise Contended("the copy's store isn't new")
        return out

    def compact(self) -> None:
        """All parts as one table, sorted by position in ranges."""
        state = self._state()
        if len(state.parts) > 1:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            part = self._put(self._read(state.parts).repartitionByRange(n, "position"), 1, state.head)
            if not self._commit(state, (part,), state.head):
                self.data.delete(part.name)
