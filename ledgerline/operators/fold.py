"""Folds of events to states: views, projections, and where their states are kept.

Three ways, from the cheapest: algebraic() for states that are aggregates (combined before the shuffle, so hot keys don't hurt),
expression_fold() for any step that is a Spark expression, and python_fold() for steps in Python, which a key's events are streamed through in one task.
All fold in order of position.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..condition import in_
from ..filter import Filter, type_
from ..plans.compile import predicate


@dataclass(frozen=True)
class View:
    """A state and the step that takes it over an event (a dict of the envelope; the payload under "payload" if decoded)."""

    initial: Callable[[], object]
    evolve: Callable[[object, dict], object]

    def fold(self, events: Iterable[dict], state: object | None = None) -> object:
        state = self.initial() if state is None else state
        for e in events:
            state = self.evolve(state, e)
        return state


@dataclass(frozen=True)
class Projection:
    """A view by event type, and the key of its states: a column expression, or None for a single state."""

    name: str
    initial: Callable[[], object]
    key: Column | None = None
    handlers: dict[str, Callable[[object, dict], object]] = field(default_factory=dict)
    filter: Filter | None = None
    parents: dict[str, str] = field(default_factory=dict)

    def on(self, event_type: str, handler: Callable[[object, dict], object]) -> Projection:
        return replace(self, handlers={**self.handlers, event_type: handler})

    def adapted(self, to: Callable[[object], object], back: Callable[[object], object]) -> Projection:
        """The same over another kind of state."""
        initial = self.initial
        return replace(self, initial=lambda: to(initial()), handlers={t: (lambda s, e, h=h: to(h(back(s), e))) for t, h in self.handlers.items()})

    @property
    def view(self) -> View:
        """Takes the handler of an event's type or of its nearest parent; events without one change nothing."""
        handlers, parents = self.handlers, self.parents

        def evolve(state: object, event: dict) -> object:
            t = event["type"]
            while t is not None and t not in handlers:
                t = parents.get(t)
            return state if t is None else handlers[t](state, event)

        return View(self.initial, evolve)

    def source(self, log: DataFrame) -> DataFrame:
        """The events to fold: those of the filter, else those of the handlers' types, else all. Events without a key are left out."""
        if self.filter is not None:
            log = log.where(predicate(self.filter, log.columns))
        elif self.handlers:
            below = {c for c, p in self.parents.items() if p in self.handlers}
            log = log.where(predicate(type_(in_(sorted({*self.handlers, *below}))), log.columns))
        return log if self.key is None else log.where(self.key.isNotNull())


def algebraic(log: DataFrame, key: Column | list[Column] | None, **states: Column) -> DataFrame:
    """States that are aggregates of the events: sums, counts, extremes, last_by() and first_by()."""
    own = [c.alias(n) for n, c in states.items()]
    if key is None:
        return log.agg(*own)
    return log.groupBy(*(key if isinstance(key, list) else [key])).agg(*own)


def last_by(value: Column, order: str = "position", when: Column | None = None) -> Column:
    """The value of the last event (that meets when); combines map-side, unlike a window."""
    order_ = F.col(order) if when is None else F.when(when, F.col(order))
    return F.max_by(value, order_)


def first_by(value: Column, order: str = "position", when: Column | None = None) -> Column:
    order_ = F.col(order) if when is None else F.when(when, F.col(order))
    return F.min_by(value, order_)


def expression_fold(log: DataFrame, key: Column, columns: list[str], initial: Column, step: Callable[[Column, Column], Column], name: str = "state", order: str = "position") -> DataFrame:
    """A step as an expression over (state, event struct of columns); a key's events are gathered in one array, in order."""
    events = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return log.groupBy(key.alias("key")).agg(F.aggregate(events, initial, step).alias(name))


def keyed_runs(rows: DataFrame, order: list[str], start: Callable[[], object], step: Callable[[object, dict], object], finish: Callable[[str, object], list[dict]], schema: str) -> DataFrame:
    """Runs over the rows of each key (a string column) in order: step takes what start gives over each row, finish turns it to rows of schema.

    Rows are dealt by key, sorted in their partitions and streamed through Python, so a key's rows are never held together. They are dealt by
    a hash of the key: Spark leaves out a repartition by the key itself above a union of tables that are partitioned by it, and then
    coalesces the partitions of each apart, so that a key's rows don't meet.
    """
    fields = T.StructType.fromDDL(schema).fieldNames()
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, began = None, None, [], False
        for batch in batches:
            for row in batch.to_pylist():
                own = row.pop("key")
                if not began or own != key:
                    if began:
                        out += finish(key, state)
                    key, state, began = own, start(), True
                state = step(state, row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in fields} for r in out], schema=types)
                    out = []
        if began:
            out += finish(key, state)
        yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in fields} for r in out], schema=types)

    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key", *order).mapInArrow(run, schema)


def python_fold(log: DataFrame, key: Column, view: View, schema: str, read: Callable[[object], dict], columns: list[str] | None = None, order: str = "position", state: DataFrame | None = None) -> DataFrame:
    """A row per key of read(state), in the columns of schema (key string is added). Only columns go to Python. state (key and its columns): states to go on from, given to the view as dicts."""
    own = log.select(key.cast("string").alias("key"), *[c for c in dict.fromkeys([order, *(columns or log.columns)])])
    initial, evolve = view.initial, view.evolve
    if state is not None:
        kept = F.to_json(F.struct(*[c for c in state.columns if c != "key"]))
        own = own.withColumn("__before", F.lit(None).cast("string")).unionByName(state.select("key", kept.alias("__before")), allowMissingColumns=True)

    def step(s: object, e: dict) -> object:
        before = e.pop("__before", None)
        return evolve(s, e) if before is None else json.loads(before)

    return keyed_runs(own, [order], initial, step, lambda k, s: [{"key": k, **read(s)}], f"key string, {schema}")


def project(log: DataFrame, p: Projection, schema: str, read: Callable[[object], dict], instance: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A projection on demand: all of a single one's events, or those of one instance of a keyed one. Metadata are the envelope's columns."""
    if p.key is None and instance is not None:
        raise ValueError("a single projection has no instances")
    source = p.source(log)
    key = F.lit("") if p.key is None else p.key
    if instance is not None:
        source = source.where(key.cast("string") == instance)
    return python_fold(source, key, p.view, schema, read, columns)


class Conflict(RuntimeError):
    """Another writer has saved states meanwhile."""


class StateTable:
    """States by key: a version lists Parquet parts, each with the states of one batch, and the newest state of a key counts. A version is one file, created exclusively; after PARTS parts, one part is made of all."""

    PARTS = 16

    def __init__(self, spark, path: str, schema: str):
        from ..sources.files import Folder

        self.spark, self.folder, self.schema = spark, Folder(spark, path), schema

    def _version(self) -> tuple[int, dict]:
        n = self.folder.last("v")
        return (0, {"parts": [], "positions": {}}) if n is None else (n, json.loads(self.folder.read_text(f"v-{n:012d}")))

    def _states(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{parts[0]}")
        rows = self.spark.read.schema(f"{self.schema}, __n long").parquet(*[f"{self.folder.path}/{p}" for p in parts])
        columns = [c for c in rows.columns if c not in ("key", "__n")]
        newest = rows.groupBy("key").agg(F.max_by(F.struct(*columns), F.coalesce("__n", F.lit(0))).alias("s"))
        return newest.select("key", *[F.col(f"s.`{c}`").alias(c) for c in columns])

    def current(self) -> DataFrame:
        return self._states(self._version()[1]["parts"])

    def position(self, name: str) -> int:
        """The last position that a projection has saved with its states."""
        return self._version()[1]["positions"].get(name, 0)

    def find(self, *keys: str) -> DataFrame:
        return self.current().where(F.col("key").isin(list(keys)))

    def save(self, states: DataFrame | Callable[[DataFrame], DataFrame], positions: dict[str, int] | None = None, conflict: str = "raise") -> bool:
        """Replaces the states of these keys, in one write for the whole batch, and notes positions with them. states may be a function of the current states. conflict: of another writer meanwhile, "raise", "ignore" (nothing is saved, False is returned) or "retry"."""
        import uuid

        if conflict not in ("raise", "ignore", "retry"):
            raise ValueError(f"no conflict policy: {conflict}")
        while True:
            n, kept = self._version()
            new = states(self._states(kept["parts"])) if callable(states) else states
            columns = self._states([]).columns
            name, parts = f"data-{uuid.uuid4().hex}", kept["parts"]
            if len(parts) >= self.PARTS:
                new = self._states(parts).join(new.select("key"), "key", "left_anti").unionByName(new.select(columns))
                parts = []
            new.select(*columns, F.lit(n + 1).cast("long").alias("__n")).write.parquet(f"{self.folder.path}/{name}")
            if self.folder.create(f"v-{n + 1:012d}", json.dumps({"parts": [*parts, name], "positions": {**kept["positions"], **(positions or {})}})):
                return True
            self.folder.delete(name)
            if conflict == "raise":
                raise Conflict("another writer has saved meanwhile")
            if conflict == "ignore":
                return False


def coalesced(log: DataFrame, key: Column, batch: int, states: dict[str, tuple[Column, Callable[[Column], Column]]], after: int = 0) -> DataFrame:
    """A replay that buffers events and flushes them by the batch: a row for each flush and key that it writes, with the key's states after it.

    A flush takes batch positions, the last one what is left; each key in it is read and written once, however many events it has. states: of each
    state, its aggregate over a flush's events and how those combine (F.count("*") with F.sum, say). One job, whatever the number of flushes.
    """
    if batch < 1:
        raise ValueError("a batch has an event")
    from pyspark.sql import Window

    flush = F.floor((F.col("position") - after - 1) / batch).cast("long")
    own = log.where(F.col("position") > after).groupBy(flush.alias("flush"), key.cast("string").alias("key")).agg(F.count("*").alias("events"), *[c.alias(n) for n, (c, _) in states.items()]).where(F.col("key").isNotNull())
    so_far = Window.partitionBy("key").orderBy("flush").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.select("flush", "key", "events", *[combine(F.col(n)).over(so_far).alias(n) for n, (_, combine) in states.items()])


def dcb_projection(log: DataFrame, p: Projection, criteria, schema: str, read: Callable[[object], dict], columns: list[str] | None = None) -> DataFrame:
    """A projection over the events of criteria, across streams: its key and handlers as elsewhere, its own filter with the criteria's."""
    return project(log.where(criteria.column()), p, schema, read, None, columns)
