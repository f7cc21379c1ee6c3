"""Small files beside tables, through the Hadoop file system of the session, so that paths may be on any store."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from quillon.errors import ConcurrentChange


class Storage:
    def __init__(self, spark: SparkSession):
        self._spark, self._jvm = spark, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _written(self, path: str, text: str):
        """text as a new file beside path."""
        other, fs = self._at(f"{path}.{uuid.uuid4().hex}.new")
        stream = fs.create(other, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return other

    def _context(self, path: str):
        return self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(path)[0].toUri(), self._conf)

    def _rename(self, other, path: str, overwrite: bool) -> None:
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if overwrite else kind.NONE
        self._context(path).rename(other, self._at(path)[0], options)

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: to another name first, which is then renamed over the old file in one step."""
        self._rename(self._written(path, text), path, True)

    def create(self, path: str, text: str) -> bool:
        """write(), unless there is such a file already; whether it was made."""
        if self.exists(path):
            return False
        other = self._written(path, text)
        try:
            self._rename(other, path, False)
        except Py4JJavaError:
            self._at(path)[1].delete(other, False)
            if self.exists(path):
                return False
            raise
        return True

    def folders(self, path: str) -> list[str]:
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())

    def files(self, path: str) -> list[str]:
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.delete(p, True)


class Versions:
    """A text that is replaced as a whole: every version is a file of its own that only one writer can make.

    The last one counts. A writer names the version that it has read; if another writer came first, the new file is there
    already. Nothing is locked, so a writer that dies leaves nothing to clear away.
    """

    KEPT = 20

    def __init__(self, storage: Storage, path: str):
        self.storage, self.path = storage, path

    def _all(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.storage.files(self.path) if re.fullmatch(r"\d+\.json", n))

    def read(self) -> tuple[int, str] | None:
        """(number, text) of the last version; None if there is none."""
        found = self._all()
        return (found[-1], self.storage.read(f"{self.path}/{found[-1]:012d}.json")) if found else None

    def commit(self, after: int, text: str) -> int:
        """Makes text the version after that number; ConcurrentChange if there is one."""
        if not self.storage.create(f"{self.path}/{after + 1:012d}.json", text):
            raise ConcurrentChange(self.path)
        for old in self._all():
            if old <= after + 1 - self.KEPT:
                self.storage.delete(f"{self.path}/{old:012d}.json")
        return after + 1
