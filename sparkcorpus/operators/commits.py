"""Publishing versions of a folder: a reader sees a whole version, and of two writers one wins.

A version is a small JSON file ``commits/<n>``. Its writer first takes ``commits/<n>.lock`` (created exclusively), writes
the file aside and renames it into place. A writer that dies in between leaves a lock, which is taken over when it is old.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Seconds after which the lock of a writer that never published is taken over; a writer holds it for one rename.
STALE = 600


class CommitLog:
    """The versions published below ``root``; each has a payload (a dict) that says where its data lie."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _time(self) -> int:
        return self._jvm.java.lang.System.currentTimeMillis()

    def version(self) -> int:
        """The last published version, 0 before any."""
        if not self.fs.exists(self.path("commits")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path("commits"))]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def payload(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"commits/{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict | None]:
        """The last version and its payload."""
        at = self.version()
        return at, self.payload(at) if at else None

    def publish(self, base: int, payload: dict) -> int | None:
        """Version ``base + 1``, or None where another writer has published it."""
        self.fs.mkdirs(self.path("commits"))
        target, lock = self.path(f"commits/{base + 1}"), self.path(f"commits/{base + 1}.lock")
        if not self.fs.createNewFile(lock):
            if self.fs.exists(target) or self._time() - self.fs.getFileStatus(lock).getModificationTime() < STALE * 1000:
                return None
            self.fs.delete(lock, False)
            if not self.fs.createNewFile(lock):
                return None
        if self.version() != base:
            return None
        aside = self.path(f"commits/.{base + 1}-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(payload).encode()))
        stream.close()
        return base + 1 if self.fs.rename(aside, target) else None
