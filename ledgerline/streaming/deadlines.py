"""Deadlines: things to do at a time, by category; kept in files, due ones polled."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..functions.retry import Retry
from ..sources.files import Folder


class Deadlines:
    def __init__(self, spark: SparkSession, path: str, retry: Retry | None = None):
        self.folder, self.retry, self.consumers = Folder(spark, path), retry or Retry(), {}

    def schedule(self, id: str, category: str, at: datetime, data: object = None) -> None:
        """An id scheduled again moves."""
        due = at.astimezone(timezone.utc).isoformat()
        self.folder.replace(id, json.dumps({"category": category, "at": due, "data": data}))

    def cancel(self, id: str) -> None:
        self.folder.delete(id)

    def register(self, category: str, consumer: Callable[[str, str, datetime, object], None]) -> None:
        self.consumers[category] = consumer

    def unregister(self, category: str) -> None:
        self.consumers.pop(category, None)

    def poll(self, now: datetime) -> int:
        """Gives due deadlines to their categories' consumers, the earliest first; those without a consumer wait."""
        found = []
        for id in self.folder.names():
            if not id.startswith(".") and not id.endswith(".crc"):
                d = json.loads(self.folder.read_text(id))
                at = datetime.fromisoformat(d["at"])
                if at <= now and d["category"] in self.consumers:
                    found.append((at, id, d))
        for at, id, d in sorted(found, key=lambda x: x[:2]):
            self.retry.run(lambda id=id, at=at, d=d: self.consumers[d["category"]](id, d["category"], at, d["data"]))
            self.folder.delete(id)
        return len(found)
