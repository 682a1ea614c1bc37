"""Sagas on a stream: transformWithState over the step that batches use, with processing-time timers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.saga import Saga, SagaState, Timeout, step

OUTPUT = "saga_id string, status string, saga_version long, state string, ordinal int, command string"


class SagaProcessor(StatefulProcessor):
    """State is the instance as JSON; output, a row per command, or one without for a change that gives none."""

    def __init__(self, saga: Saga):
        self.saga = saga

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("instance", "json string")

    def _load(self) -> SagaState | None:
        return SagaState(**json.loads(self.kept.get()[0])) if self.kept.exists() else None

    def _apply(self, key, given, now_ms: float) -> list[tuple]:
        before = self._load()
        after, made = step(self.saga, before, given, now_ms / 1000)
        if after is None or after is before:
            return []
        self.kept.update((json.dumps(asdict(after)),))
        for t in {int(x * 1000) for x in (before.timers if before else {}).values()} - {int(x * 1000) for x in after.timers.values()}:
            self.handle.deleteTimer(t)
        for t in {int(x * 1000) for x in after.timers.values()} - {int(x * 1000) for x in (before.timers if before else {}).values()}:
            self.handle.registerTimer(t)
        base = (key[0], after.status, after.version, json.dumps(after.state, sort_keys=True))
        return [(*base, c["ordinal"], c["command"]) for c in made] or [(*base, None, None)]

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        frames = list(rows)  # one key's events of one micro-batch
        out: list[tuple] = []
        if frames:
            for e in pd.concat(frames).sort_values("position").to_dict("records"):
                out += self._apply(key, e, now)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = max(at, timerValues.getCurrentProcessingTimeInMs())
        kept = self._load()
        out: list[tuple] = []
        for due, name in kept.due((at + 1) / 1000) if kept else []:
            out += self._apply(key, Timeout(name, due), now)
        yield self._frame(out)

    def close(self) -> None:
        pass


def run_stream(stream: DataFrame, saga: Saga, key: Column, columns: list[str]) -> DataFrame:
    """The saga's output stream. Needs the RocksDB state store provider."""
    needed = list(dict.fromkeys(["type", "position", *columns]))
    own = stream.where(F.col("type").isin(saga.types())).select(key.cast("string").alias("saga_id"), *needed).where(F.col("saga_id").isNotNull())
    return own.groupBy("saga_id").transformWithStateInPandas(SagaProcessor(saga), outputStructType=OUTPUT, outputMode="append", timeMode="processingTime")
