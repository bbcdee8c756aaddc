"""Tables kept as versions: a write is seen whole or not at all, and what was there before it stays readable.

Below a table's path, `data/<name>` holds the files of one version and `versions/<number>` names them. A version is
committed by renaming a pointer that was written aside to the next number. A rename never replaces what is there, so of
two writers that started from one version only one commits; the other's files are never named. Readers take the highest
number. All goes through the file system of the path, so it serves any store that renames atomically and never onto what
is there; on a local disk, where a rename replaces, a look before it stands in for that.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has committed since the version that this write is built on."""


@dataclass(frozen=True)
class Version:
    """One version of a table: its number (0: there is none yet), the folder of its rows, and what was said with it."""

    number: int
    folder: str | None = None
    schema: str | None = None
    note: str | None = None


class VersionedTable:
    """A table below a path in the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n) for n in names if re.fullmatch(r"\d+", n))

    def version(self, number: int | None = None) -> Version:
        """The version of that number, or the last; one without rows if there is none."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return Version(0)
        told = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{number:012d}").collect()))  # one line
        return Version(number, f"{self.path}/data/{told['data']}", told["schema"], told.get("note"))

    def read(self, number: int | None = None, schema: str | None = None) -> DataFrame:
        """Rows of a version (the last, if none is given). schema: of a table that has no version yet."""
        found = self.version(number)
        if not found.number:
            if schema is None:
                raise FileNotFoundError(f"{self.path} has no version yet")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(found.schema))).parquet(found.folder)

    def replace(self, rows: DataFrame, base: Version | None = None, note: str | None = None) -> Version:
        """Commit rows as the version after base (the last one, if none is given); Conflict if there is one already.

        rows may have been read from the table: nothing of it is touched. note is kept with the pointer, and so is
        committed with the rows, or not at all.
        """
        base = base or self.version()
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return self._commit(base, {"data": name, "schema": rows.schema.json(), "note": note})

    def _commit(self, base: Version, told: dict) -> Version:
        number = base.number + 1
        aside, there = self._path(f"{self.path}/aside-{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/{number:012d}")
        self._files.mkdirs(there.getParent())
        out = self._files.create(aside, False)
        out.write(json.dumps(told).encode())
        out.close()
        # a rename onto a file fails; a store that would replace it is caught by the look before
        if self._files.exists(there) or not self._renamed(aside, there):
            self._files.delete(aside, False)
            raise Conflict(f"{self.path} has a version {number} by another writer")
        return Version(number, f"{self.path}/data/{told['data']}", told["schema"], told["note"])

    def _renamed(self, source, target) -> bool:
        try:
            return self._files.rename(source, target)
        except Exception as e:  # some file systems say it by an exception
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def clean(self, keep: int = 2) -> None:
        """Delete the rows of all but the last versions, and those of writes that never committed. Only while no write
        is under way."""
        numbers = self._numbers()
        named = {self.version(n).folder.rpartition("/")[2] for n in numbers[-keep:]}
        folder = self._path(f"{self.path}/data")
        for status in self._files.listStatus(folder) if self._files.exists(folder) else ():
            if status.getPath().getName() not in named:
                self._files.delete(status.getPath(), True)
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.path}/versions/{n:012d}"), False)
