"""Small files and folders through Spark's own file systems."""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import SparkSession


class Files:
    """What a path names, whichever store it is in."""

    def __init__(self, spark: SparkSession):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def matches(self, pattern: str) -> bool:
        fs, p = self._at(pattern)
        return bool(fs.globStatus(p))

    def names(self, path: str) -> list[str]:
        """The names in a folder; none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def holds(self, path: str, ending: str) -> bool:
        """Whether a folder, or one below it, has a file of that ending."""
        fs, p = self._at(path)
        found = fs.listFiles(p, True)
        while found.hasNext():
            if found.next().getPath().getName().endswith(ending):
                return True
        return False

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file, which others see as a whole or not at all."""
        fs, p = self._at(path)
        draft = self._path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex[:8]}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise FileExistsError(f"another writer has written {path}")


def folder_name(name: str) -> str:
    """A name for a folder; names that differ give folders that differ."""
    plain = re.sub(r"[^A-Za-z0-9.-]", "_", name)
    return plain if plain == name else f"{plain}-{zlib.crc32(name.encode()):08x}"
