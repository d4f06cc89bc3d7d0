"""What the operators share: work folders, lineage cuts, checked broadcasts, Python path."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest size, in bytes, of a side that is broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 16 << 20

#: Bytes of a batch of rows that goes to a Python worker, where the session has Spark's default.
BATCH_BYTES, DEFAULT_BATCH, BATCH_KEY = 2 << 20, 64 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Ships this package to the Python workers, once for each context; operators call it themselves.

    Batches of rows between the JVM and the workers are made smaller than by default, unless
    the session asks for a size: texts lie in both, so an executor's memory holds several.
    """
    sc = spark.sparkContext
    if int(spark.conf.get(BATCH_KEY).rstrip("b")) == DEFAULT_BATCH:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    env = sc.environment
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    # Buffers of freed batches go back to the system, not to a pool that a worker keeps while it idles.
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    if getattr(sc, "_rollstore_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # Spark's own file server gives the archive to the workers, from the driver and as long as it lives.
    folder = os.path.realpath(tempfile.mkdtemp(prefix="rollstore-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{os.path.basename(package)}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._rollstore_shipped = True


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="rollstore-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: The scratch folders made inside ``removed_after``.
_made: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def removed_after() -> Iterator[None]:
    """Removes the work tables of operators that were called inside: their results must be written by then."""
    made: list[Scratch] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for scratch in made:
            scratch.drop("")


class Scratch:
    """Parquet tables of one operator run below the shared folder.

    A written table is the only lineage cut: a lost executor loses none of it.
    ``drop`` removes one that is no longer needed, ``finish`` all but the result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        prepare(spark)
        self.base = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: dict[str, StructType] = {}
        if (made := _made.get()) is not None:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._write(df, name, "overwrite")
        return self.read(name)

    def append(self, df: DataFrame, name: str) -> None:
        self._write(df, name, "append")

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        self.names[name] = df.schema
        df.write.mode(mode).option("compression", "zstd").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.names[name]).parquet(self.path(name))

    def finish(self, df: DataFrame, *more: str) -> DataFrame:
        """``df``, a narrow result, written; all other tables of this run, and ``more``, are removed."""
        out = self.save(df, "result")
        self.drop(*(n for n in list(self.names) if n != "result"), *more)
        return out

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(conf).delete(path, True)
            self.names.pop(name, None)


def small_side(df: DataFrame, rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` prove it small, else unchanged (then a shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds at most ``most`` bytes of ``column`` (or a single row)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + int(n) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def utf8(column) -> tuple:
    """A string column as (bytes as a uint8 array, offsets as int64) with nulls as empty."""
    import numpy as np
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    return raw, offsets - (offsets[0] if len(offsets) else 0)
