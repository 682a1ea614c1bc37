"""Sagas: processes over events and timers, as one pure step that batches and streams share.

An instance is a SagaState; step() takes it over one input. A batch replays each instance's events in order of position, firing
the timers that are due between them and up to a given time; a stream keeps the state and gets its timers from Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import keyed_runs

ACTIVE, COMPLETED = "active", "completed"


@dataclass(frozen=True)
class Command:
    """An effect: a command to give, any JSON-able value."""

    body: object


@dataclass(frozen=True)
class StartTimer:
    """An effect: fire after seconds from the input's time, or at a time (seconds since the epoch)."""

    name: str
    seconds: float | None = None
    at: float | None = None


@dataclass(frozen=True)
class CancelTimer:
    name: str


@dataclass(frozen=True)
class Timeout:
    """An input: a timer has fired."""

    name: str
    at: float


@dataclass(frozen=True)
class Saga:
    """evolve(state, input) gives a state, react(state, input) and on_start(state, event) effects; inputs are event dicts or Timeouts."""

    name: str
    initial: Callable[[], object]
    starts_on: frozenset[str]
    evolve: Callable[[object, object], object] = lambda s, i: s
    react: Callable[[object, object], list] = lambda s, i: []
    on_start: Callable[[object, dict], list] = lambda s, e: []
    is_terminal: Callable[[object], bool] = lambda s: False
    events: frozenset[str] = frozenset()

    def types(self) -> list[str]:
        return sorted(self.starts_on | self.events)


@dataclass(frozen=True)
class SagaState:
    state: object
    status: str = ACTIVE
    version: int = 0
    timers: dict[str, float] = field(default_factory=dict)
    position: int = 0
    streams: dict[str, int] = field(default_factory=dict)
    created: float = 0.0
    updated: float = 0.0

    def due(self, now: float) -> list[tuple[float, str]]:
        return sorted((at, n) for n, at in self.timers.items() if at <= now) if self.status == ACTIVE else []


def redelivered(kept: SagaState, event: dict) -> bool:
    """By the version in its stream if that is known, else by position."""
    stream, version, position = (event.get(k) for k in ("streamid", "streamversion", "position"))
    if stream is not None and version is not None:
        return version <= kept.streams.get(stream, 0)
    return position is not None and position <= kept.position


def step(saga: Saga, kept: SagaState | None, given, now: float) -> tuple[SagaState | None, list[dict]]:
    """The instance after an input at a time, and the commands, numbered by (version, ordinal) so that a sink can drop repeats."""
    event = given if isinstance(given, dict) else None
    started = kept is None
    if started:
        if event is None or event["type"] not in saga.starts_on:
            return None, []
        kept = SagaState(saga.initial(), created=now)
    elif kept.status == COMPLETED:
        return kept, []
    elif event is not None and redelivered(kept, event):
        return kept, []
    timers = dict(kept.timers)
    if event is None:
        if given.name not in timers or timers[given.name] > now:
            return kept, []  # cancelled, or moved, meanwhile
        del timers[given.name]
    state = saga.evolve(kept.state, given)
    effects = (list(saga.on_start(state, event)) if started else []) + list(saga.react(state, given))
    commands = []
    for e in effects:
        match e:
            case Command(body):
                commands.append(body)
            case StartTimer(name, seconds, at):
                timers[name] = at if at is not None else now + seconds
            case CancelTimer(name):
                timers.pop(name, None)
    status = COMPLETED if saga.is_terminal(state) else ACTIVE
    streams, position = dict(kept.streams), kept.position
    if event is not None:
        if event.get("streamid") is not None and event.get("streamversion") is not None:
            streams[event["streamid"]] = max(event["streamversion"], streams.get(event["streamid"], 0))
        position = max(position, event.get("position") or 0)
    after = replace(kept, state=state, status=status, version=kept.version + 1, timers={} if status == COMPLETED else timers, position=position, streams=streams, updated=now)
    return after, [{"version": after.version, "ordinal": i, "command": json.dumps(c, sort_keys=True)} for i, c in enumerate(commands)]


def fire_due(saga: Saga, kept: SagaState | None, now: float) -> tuple[SagaState | None, list[dict]]:
    """All timers due by now, in order, each at its own time; timers that they start and that are due too."""
    out: list[dict] = []
    while kept is not None and (due := kept.due(now)):
        at, name = due[0]
        kept, made = step(saga, kept, Timeout(name, at), max(at, kept.updated))
        out += made
    return kept, out


def advance(saga: Saga, kept: SagaState | None, event: dict, now: float) -> tuple[SagaState | None, list[dict]]:
    """Fires the timers that are due by an event's time, then takes the event."""
    kept, fired = fire_due(saga, kept, now)
    kept, made = step(saga, kept, event, now)
    return kept, fired + made


def replay(saga: Saga, events: list[dict], until: float, time: Callable[[dict], float]) -> tuple[SagaState | None, list[dict]]:
    """One instance over its events in order of position, with timers firing between them, and up to until."""
    kept, out = None, []
    for e in events:
        kept, made = advance(saga, kept, e, time(e))
        out += made
    kept, made = fire_due(saga, kept, until)
    return kept, out + made


_STATE = "status string, version long, state string, timers map<string,double>, position long"
_COMMANDS = "commands array<struct<version:long,ordinal:int,command:string>>"


def run_batch(log: DataFrame, saga: Saga, key: Column, until: float, columns: list[str]) -> DataFrame:
    """A row per instance: saga_id, status, version, state (JSON), timers, position, commands. Only the saga's event types and the columns go to Python."""
    needed = list(dict.fromkeys(["type", "position", "time", *columns]))
    own = log.where(F.col("type").isin(saga.types()))
    own = own.select(key.cast("string").alias("saga_id"), *[F.unix_micros(F.col("time").cast("timestamp")).alias("__us") if c == "time" else F.col(c) for c in needed]).where(F.col("saga_id").isNotNull())

    def taken(s: tuple, e: dict) -> tuple:
        kept, made = advance(saga, s[0], e, e["__us"] / 1e6)
        return kept, s[1] + made

    def ended(k: str, s: tuple) -> list[dict]:
        kept, made = fire_due(saga, s[0], until)
        if kept is None:
            return []
        return [{"saga_id": k, "status": kept.status, "version": kept.version, "state": json.dumps(kept.state, sort_keys=True), "timers": list(kept.timers.items()), "position": kept.position, "commands": s[1] + made}]

    return keyed_runs(own.withColumnRenamed("saga_id", "key"), ["position"], lambda: (None, []), taken, ended, f"saga_id string, {_STATE}, {_COMMANDS}")


def commands(instances: DataFrame) -> DataFrame:
    return instances.select("saga_id", F.explode("commands").alias("c")).select("saga_id", "c.version", "c.ordinal", "c.command")


def due_timers(instances: DataFrame, now: float, limit: int | None = None) -> DataFrame:
    """Timers of active instances that are due, the earliest first."""
    own = instances.where(F.col("status") == ACTIVE).select("saga_id", F.explode("timers").alias("timer", "at")).where(F.col("at") <= now).orderBy("at", "saga_id", "timer")
    return own if limit is None else own.limit(limit)


class SagaStore:
    """Instances on the driver, saved only over the version they were read at."""

    def __init__(self):
        self.kept: dict[str, SagaState] = {}

    def find(self, saga_id: str) -> SagaState | None:
        return self.kept.get(saga_id)

    def compare_and_save(self, saga_id: str, expected: int, new: SagaState) -> bool:
        now = self.kept.get(saga_id)
        if (now.version if now else 0) != expected:
            return False
        self.kept[saga_id] = new
        return True

    def delete(self, saga_id: str) -> None:
        self.kept.pop(saga_id, None)

    def with_due_timers(self, now: float, limit: int = 100) -> list[str]:
        return [k for _, k in sorted((s.due(now)[0][0], k) for k, s in self.kept.items() if s.due(now))][:limit]

    def by_status(self, status: str, updated_before: float, limit: int = 100) -> list[str]:
        return [k for _, k in sorted((s.updated, k) for k, s in self.kept.items() if s.status == status and s.updated < updated_before)][:limit]


class FileSagaStore:
    """Instances in a folder that processes share: a version of an instance is a file, created exclusively, so saves compare by themselves. Polls read the last version of each active instance."""

    def __init__(self, spark, path: str, keep: int = 3):
        from ..sources.files import Folder

        self.folder, self.keep = Folder(spark, path), keep

    @staticmethod
    def _name(saga_id: str) -> str:
        return "s" + saga_id.encode().hex()

    def find(self, saga_id: str) -> SagaState | None:
        n = self.folder.last(self._name(saga_id))
        return None if n is None else self._read(f"{self._name(saga_id)}-{n}")

    def _read(self, name: str) -> SagaState | None:
        found = json.loads(self.folder.read_text(name))
        return None if found is None else SagaState(**found)

    def _number(self, saga_id: str) -> int:
        return self.folder.last(self._name(saga_id)) or 0

    def compare_and_save(self, saga_id: str, expected: int, new: SagaState) -> bool:
        n, now = self._number(saga_id), self.find(saga_id)
        if (now.version if now else 0) != expected or not self.folder.create(f"{self._name(saga_id)}-{n + 1}", json.dumps(asdict(new))):
            return False
        if n + 1 > self.keep:
            self.folder.delete(f"{self._name(saga_id)}-{n + 1 - self.keep}")
        return True

    def delete(self, saga_id: str) -> None:
        if self.find(saga_id) is not None:
            self.folder.create(f"{self._name(saga_id)}-{self._number(saga_id) + 1}", "null")

    def _all(self) -> dict[str, SagaState]:
        last: dict[str, int] = {}
        for name in self.folder.names("s"):
            key, _, n = name.partition("-")
            if n.isdigit():
                last[key] = max(last.get(key, 0), int(n))
        found = {bytes.fromhex(k[1:]).decode(): self._read(f"{k}-{n}") for k, n in last.items()}
        return {k: s for k, s in found.items() if s is not None}

    def with_due_timers(self, now: float, limit: int = 100) -> list[str]:
        return [k for _, k in sorted((s.due(now)[0][0], k) for k, s in self._all().items() if s.due(now))][:limit]

    def by_status(self, status: str, updated_before: float, limit: int = 100) -> list[str]:
        return [k for _, k in sorted((s.updated, k) for k, s in self._all().items() if s.status == status and s.updated < updated_before)][:limit]


class SagaRunner:
    """Runs a saga over single inputs: commands are given before the state is saved, so they may come again after a failure."""

    def __init__(self, saga: Saga, store: SagaStore | FileSagaStore, dispatch: Callable[[object], object], attempts: int = 50, lease=None, require_key: bool = False):
        """lease: polls fire timers only while this process holds it. require_key: refuse events whose redelivery can't be told, as they have neither a version in their stream nor a position."""
        self.saga, self.store, self.dispatch, self.attempts, self.lease, self.require_key = saga, store, dispatch, attempts, lease, require_key

    def _apply(self, saga_id: str, given, now: float) -> SagaState | None:
        for _ in range(self.attempts):
            kept = self.store.find(saga_id)
            after, made = step(self.saga, kept, given, now)
            if after is None or after is kept:
                return after
            for c in made:
                self.dispatch(json.loads(c["command"]))
            if self.store.compare_and_save(saga_id, kept.version if kept else 0, after):
                return after
        raise RuntimeError(f"{saga_id} is contended")

    def on_event(self, saga_id: str, event: dict, now: float) -> SagaState | None:
        if self.require_key and event.get("position") is None and (event.get("streamid") is None or event.get("streamversion") is None):
            raise ValueError("an event without a stream's version and a position")
        return self._apply(saga_id, event, now)

    def poll(self, now: float, limit: int = 100) -> int:
        """Fires due timers; returns how many."""
        n = 0
        if self.lease is not None and self.lease.acquire(f"timers-{self.saga.name}") is None:
            return n
        for saga_id in self.store.with_due_timers(now, limit):
            for at, name in self.store.find(saga_id).due(now):
                self._apply(saga_id, Timeout(name, at), now)
                n += 1
        return n
