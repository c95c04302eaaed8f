"""Marks: small JSON files in a folder, each put in place once. What a job wrote counts when its mark is there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Marks:
    """A mark is written aside and renamed; the rename fails if the mark is there (on file systems with atomic renames)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def names(self, prefix: str = "") -> list[str]:
        """The marks' names in order."""
        at = self._path(self.path)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(n for n in names if n.startswith(prefix) and not n.startswith((".", "_")))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def get(self, name: str) -> dict:
        found = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(found)).decode())
        finally:
            found.close()

    def put(self, name: str, content: dict) -> bool:
        """Whether this call has put the mark in place; False if it was there."""
        self._fs.mkdirs(self._path(self.path))
        draft, final = self._path(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        never_over = self._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, never_over)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def age(self, name: str, now: float) -> float:
        """Seconds since the mark was put in place."""
        return now - self._fs.getFileStatus(self._path(f"{self.path}/{name}")).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def clear(self) -> None:
        """Remove the folder with all that is in it."""
        self._fs.delete(self._path(self.path), True)

    def remove_folder(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
