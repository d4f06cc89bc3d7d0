"""Loads from streams: files that appear in a folder, and messages that announce files.

Both use Structured Streaming's foreachBatch.  A batch is one load, so it is visible as a
whole or not at all.  Its number is written in the manifest that makes it visible, so a
batch that is run again, also by an engine that opened the table anew, is not loaded
twice.  Late records land in the row that their rolled-up time belongs to, so there is no
watermark and nothing is dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..engine import Engine
from ..sources import ingest


def watch(engine: Engine, table: str, folder: str, checkpoint: str, *, extensions: tuple[str, ...] = (".tsv",), columns: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Loads the files that are moved into ``folder``; within a batch they count in order of name.

    A file that can't be parsed fails its batch, as a load of it would fail.
    """
    target = engine.table(table)
    fields = ingest.input_fields(target.spec, columns)
    width = len(columns) if columns else len(fields)
    mark = f"stream:{checkpoint}"
    stream = engine.spark.readStream.option("lineSep", "\n").option("pathGlobFilter", "*{" + ",".join(extensions) + "}").format("text").load(folder)
    stream = stream.select("value", "_metadata.file_path", "_metadata.file_block_start")

    def load(batch: DataFrame, number: int) -> None:
        if number <= target.applied.get(mark, -1) or batch.isEmpty():
            return
        engine.load_records(target, ingest.fields_of(batch, width, target.batch + 1), fields, marks={mark: number})

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def _load(engine: Engine, message: dict, marks: dict[str, int], folders: list[str]) -> None:
    """Loads of each table what a message names, one load a table, unless that table has it already."""
    for name, t in message["tables"].items():
        table = engine.table(name)
        if any(table.applied.get(k, 0) >= v for k, v in marks.items()):
            continue
        paths = [p.rstrip("/") + f for p in t["paths"] for f in folders]
        engine.load({"table": name, "file": paths, "recursive": True, "marks": marks} | ({"columns": t["columns"]} if t.get("columns") else {}))


def apply_message(engine: Engine, message: dict) -> bool:
    """Loads what a message announces: {"id", "tables": {name: {"paths", "columns"?}}}; False if its id is not new."""
    new = int(message["id"]) > engine.last_batch_id or any(engine.table(n).applied.get("micro", 0) < int(message["id"]) for n in message["tables"])
    if new:
        _load(engine, message, {"micro": int(message["id"])}, [""])
    return new


def announcements(engine: Engine, stream: DataFrame, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Applies the messages of a stream with a ``value`` column (of Kafka, or of a folder of texts), in order of id."""

    def load(batch: DataFrame, number: int) -> None:
        # A message names files; there are few of them, whatever the files hold.
        messages = [json.loads(r[0]) for r in batch.select(F.col("value").cast("string")).toLocalIterator()]
        for m in sorted(messages, key=lambda m: int(m["id"])):
            apply_message(engine, m)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def bootstrap(engine: Engine, message: dict, partitions: list[int] | None = None) -> None:
    """Loads a historic batch: all of its paths, or only their ``part=N`` folders.

    Micro-batches up to the one that it says it covers (``microbatch``, else its own id) are
    not new any more.
    """
    covered = int(message.get("microbatch", message["id"]))
    _load(engine, message, {"historic": int(message["id"])}, [""] if partitions is None else [f"/part={n}" for n in partitions])
    engine.mark(list(message["tables"]), {"micro": covered})
