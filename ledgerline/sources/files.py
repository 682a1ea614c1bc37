"""Small files of a folder on any of Hadoop's file systems, with exclusive creation."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: A writer creates a file within this time after its claim.
CLAIM_SECONDS = 60


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, jvm = spark, path.rstrip("/"), spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def names(self, prefix: str = "") -> list[str]:
        return sorted(n for s in self.fs.listStatus(self._path("")) if (n := s.getPath().getName()).startswith(prefix))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def last(self, prefix: str) -> int | None:
        """The highest number among files called prefix-<number>."""
        found = [int(n.removeprefix(f"{prefix}-")) for n in self.names(f"{prefix}-") if n.removeprefix(f"{prefix}-").isdigit()]
        return max(found, default=None)

    def create(self, name: str, text: str) -> bool:
        """Creates the file with its whole content, or returns False if it is there.

        The name is claimed first, by a file with a token of its writer that is created exclusively; then the content, written
        under another name, is renamed to it, so that no reader sees half a file. A claim that is older than CLAIM_SECONDS is taken to be
        a dead writer's: of those that see it, the one that creates the claim named by its token goes on, and the slow writer, if it isn't
        dead, sees that claim before it renames. Object stores need a client with conditional creation for this.
        """
        if self.exists(name):
            return False
        token, claim = uuid.uuid4().hex, f"{name}.claim"
        while not self._claimed(claim, token):
            held = self._token(claim)
            if self.exists(name) or held is None or time.time() - self.fs.getFileStatus(self._path(claim)).getModificationTime() / 1000 < CLAIM_SECONDS:
                return False
            claim = f"{name}.claim-{held}"
        draft = self._path(f".{name}.{token}")
        self._write(draft, text)
        if self.exists(name) or self.exists(f"{name}.claim-{token}"):
            self.fs.delete(draft, False)
            return False
        return bool(self.fs.rename(draft, self._path(name)))

    def _write(self, path, text: str) -> None:
        out = self.fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _claimed(self, claim: str, token: str) -> bool:
        try:
            self._write(self._path(claim), token)
        except Py4JJavaError:
            return False
        return self._token(claim) == token

    def _token(self, claim: str) -> str | None:
        """Of the writer that holds a claim; None while it isn't written, or if it is gone."""
        try:
            return self.read_text(claim) or None
        except Py4JJavaError:
            return None

    def replace(self, name: str, text: str) -> None:
        out = self.fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, name: str) -> str:
        src = self.fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
        finally:
            src.close()

    def delete(self, name: str) -> bool:
        for claim in self.names(f"{name}.claim"):
            self.fs.delete(self._path(claim), False)
        return self.fs.delete(self._path(name), True)
