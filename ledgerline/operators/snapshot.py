"""Snapshots of folds: when to take one, and how to go on from one."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dcb import Criteria
from .fold import View, keyed_runs, python_fold


@dataclass(frozen=True)
class Snapshot:
    state: object
    version: int
    schema_version: int = 1


@dataclass(frozen=True)
class Policy:
    """When to take a snapshot: test(events since the last, their types, state), and the same as a column over columns since, types and state."""

    test: Callable[[int, list[str], object], bool]
    column: Callable[[], Column] | None = None

    def or_(self, other: Policy) -> Policy:
        column = (lambda: self.column() | other.column()) if self.column and other.column else None
        return Policy(lambda n, t, s: self.test(n, t, s) or other.test(n, t, s), column)


def every(n: int) -> Policy:
    if n < 1:
        raise ValueError("every first event at least")
    return Policy(lambda since, types, state: since >= n, lambda: F.col("since") >= n)


def never() -> Policy:
    return Policy(lambda since, types, state: False, lambda: F.lit(False))


def always() -> Policy:
    """Whenever there is a new event."""
    return Policy(lambda since, types, state: since > 0, lambda: F.col("since") > 0)


def on_event(*names: str) -> Policy:
    return Policy(lambda since, types, state: any(t in names for t in types), lambda: F.arrays_overlap("types", F.array(*map(F.lit, names))))


def when_state(test: Callable[[object], bool]) -> Policy:
    return Policy(lambda since, types, state: test(state))


def usable(snapshot: Snapshot | None, head: int, schema_version: int) -> bool:
    """Of the schema asked for, and not ahead of its stream (which was reset, if it is)."""
    return snapshot is not None and snapshot.schema_version == schema_version and snapshot.version <= head


def redelivered(delivered: int, snapshot: Snapshot | None, head: int) -> bool:
    """Whether an event's version is in the snapshot already."""
    return snapshot is not None and delivered <= snapshot.version <= head


def bases(heads: DataFrame, snapshots: DataFrame, schema_version: int, initial: Column) -> DataFrame:
    """key, head, base_version and base state of each key of heads (key, head): its usable snapshot (key, version, schema_version, state), else the initial state at 0."""
    both = heads.join(snapshots.where(F.col("schema_version") == schema_version), "key", "left")
    ok = F.col("version").isNotNull() & (F.col("version") <= F.col("head"))
    return both.select("key", "head", F.when(ok, F.col("version")).otherwise(0).cast("long").alias("base_version"), F.when(ok, F.col("state")).otherwise(initial).alias("base"))


def tails(log: DataFrame, base: DataFrame, key: str = "streamid") -> DataFrame:
    """Events after their key's base, with it: what is left to fold."""
    return log.join(base.withColumnRenamed("key", key), key).where(F.col("streamversion") > F.col("base_version"))


def refreshed(log: DataFrame, snapshots: DataFrame, view: View, schema: str, read: Callable[[object], dict], columns: list[str], schema_version: int = 1) -> DataFrame:
    """key and state's columns after each stream's whole history, folded from the snapshots (key, version, schema_version and the state's columns)."""
    heads = log.groupBy("streamid").agg(F.max("streamversion").alias("head"))
    ok = snapshots.where(F.col("schema_version") == schema_version).join(heads.withColumnRenamed("streamid", "key"), "key").where(F.col("version") <= F.col("head"))
    base = ok.select("key", F.col("version").alias("base_version"))
    rest = log.join(base.withColumnRenamed("key", "streamid"), "streamid", "left").where(F.col("streamversion") > F.coalesce("base_version", F.lit(0)))
    return python_fold(rest, F.col("streamid"), view, schema, read, columns, "streamversion", ok.drop("version", "schema_version", "head"))


class SnapshotStore:
    """Snapshots by key on the driver, for single streams; StateTable keeps those of many."""

    def __init__(self):
        self.kept: dict[str, Snapshot] = {}

    def find(self, key: str) -> Snapshot | None:
        return self.kept.get(key)

    def save(self, key: str, snapshot: Snapshot) -> None:
        self.kept[key] = snapshot

    def delete(self, key: str) -> None:
        self.kept.pop(key, None)


class FileSnapshotStore:
    """Snapshots in a folder that processes share; states are JSON. The newest of a key counts."""

    def __init__(self, spark, path: str):
        from ..sources.files import Folder

        self.folder = Folder(spark, path)

    def find(self, key: str) -> Snapshot | None:
        name = key.encode().hex()
        return Snapshot(**json.loads(self.folder.read_text(name))) if self.folder.exists(name) else None

    def save(self, key: str, snapshot: Snapshot) -> None:
        self.folder.replace(key.encode().hex(), json.dumps(asdict(snapshot)))

    def delete(self, key: str) -> None:
        self.folder.delete(key.encode().hex())


def taken(log: DataFrame, policy: Policy, view: View | None = None, columns: list[str] | None = None) -> DataFrame:
    """key and version of each snapshot that a policy takes if it is asked after every event of a stream; state goes to the policy if there is a view."""

    def step(s: dict, e: dict) -> dict:
        s["state"] = view.evolve(s["state"], e) if view else None
        s["types"].append(e["type"])
        if policy.test(len(s["types"]), s["types"], s["state"]):
            s["out"].append(e["streamversion"])
            s["types"] = []
        return s

    start = lambda: {"state": view.initial() if view else None, "types": [], "out": []}
    own = log.select(F.col("streamid").alias("key"), *dict.fromkeys(["streamversion", "type", *(columns or [])]))
    return keyed_runs(own, ["streamversion"], start, step, lambda k, s: [{"key": k, "version": v} for v in s["out"]], "key string, version long")


class SnapshotService:
    """A decider's application service that reads only what came after the last snapshot. A snapshot that can't be saved is no failure of the command."""

    def __init__(self, store, snapshots: SnapshotStore, policy: Policy, schema_version: int = 1):
        self.store, self.snapshots, self.policy, self.schema_version = store, snapshots, policy, schema_version

    def execute(self, stream_id: str, decider, *commands):
        found = self.snapshots.find(stream_id)
        queries = self.store.queries()
        stream = queries.read(stream_id, skip=found.version if found else 0)
        if not usable(found, stream.version, self.schema_version):
            if found is not None and found.version > stream.version:
                self.snapshots.delete(stream_id)
            found, stream = None, queries.read(stream_id)
        tail = [r.asDict(recursive=True) for r in stream.events.collect()]  # one stream's tail
        before = decider.fold(tail, found.state if found else None)
        state, new = decider.decide_on_state(before, *commands)
        result = self.store.write(stream_id, new, stream.version)
        types = [e["type"] for e in tail] + [e.type for e in new]
        if self.policy.test(len(types), types, state):
            try:
                self.snapshots.save(stream_id, Snapshot(state, result.new_version, self.schema_version))
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"no snapshot of {stream_id}: {e}", stacklevel=2)
        return result


def criteria_key(name: str, criteria: Criteria) -> str:
    """The key of a snapshot of a fold over criteria."""
    return f"{len(name)}:{name}:{criteria.key()}"
