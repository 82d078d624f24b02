"""A small JSON state in a folder of any Hadoop file system, replaced as a whole by one writer at a time.

States are numbered files; a new one is written aside and renamed to the next number, which fails if it is taken, so of
two writers that read the same state one gets an error and has to read again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was faster."""


class Pointer:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def read(self) -> tuple[int, dict]:
        """The number of the last state, 0 for none, and the state."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        numbers = [int(n[6:-5]) for n in names if n.startswith("state-")]
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"state-{max(numbers)}.json"))
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, read: int, state: dict) -> int:
        """Puts a state in the place of that numbered `read`; Conflict if it is not the last any more. The new number."""
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"state-{read + 1}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.read()[0] != read or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.folder} has changed since state {read}")
        self._fs.delete(self._path(f"state-{read - 1}.json"), False)  # the one before stays for those who read it just now
        return read + 1
