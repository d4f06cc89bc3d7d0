"""The engine: tables, loads, queries and metadata behind one object.

A table is a folder: deltas (one for each load), values admitted under limits, and
numbered manifests that name what of these counts.  A load writes its delta first and
then one manifest, which is the step that makes it visible, together with the numbers of
the batches and stream positions that it covers.  An engine that opens the folder again
finds the table as the last manifest has it.
"""

from __future__ import annotations

import json
import socket
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import render
from .operators import limits, merge
from .operators.states import row_states
from .plans import filters, partitions, planner, sql
from .schema import SEQ, UNLIMITED, TableSpec
from .sources import ingest, pushdown
from .sources.files import Files, folder_name
from .types import col


#: Deltas of a table beyond which a load merges them into one.
COMPACT_AT = 64


@dataclass
class Table:
    spec: TableSpec
    path: str
    config: dict = field(default_factory=dict)
    #: Written deltas, folders of Parquet files, and the rows of each.
    deltas: dict[str, int] = field(default_factory=dict)
    #: Deltas that a compaction has replaced; queries that began before may still read them.
    retired: list[str] = field(default_factory=list)
    #: Admitted values by limit: folders, one for each load that added some.
    admitted: dict[str, list[str]] = field(default_factory=dict)
    #: The last number applied of each numbered source: streams, historic batches, micro-batches.
    applied: dict[str, int] = field(default_factory=dict)
    source: DataFrame | None = None
    schema: str = ""
    version: int = 0
    batch: int = 0
    stream: object = None
    #: The version that the files were last listed for, and their scan.
    scan: tuple[int, DataFrame] | None = None

    def manifest(self) -> str:
        kept = ("config", "deltas", "retired", "admitted", "applied", "schema", "batch")
        return json.dumps({k: getattr(self, k) for k in kept}, indent=1)

    @property
    def is_merged(self) -> bool:
        """Whether every key has a single row already."""
        return self.source is None and len(self.deltas) == 1

    @property
    def records(self) -> int:
        return sum(self.deltas.values())


@dataclass
class LoadStats:
    """What a load did: milliseconds, and the rows that it stored."""

    table: str
    ms: float
    stored_recs: int

    def lines(self, prefix: str = "") -> list[str]:
        name = f"{prefix}load.{self.table}"
        return [f"{name}.time:{self.ms:.0f}|ms", f"{name}.rows:{self.stored_recs}|c"]


@dataclass
class QueryStats:
    """What a query did: milliseconds, deltas and stored rows under it, rows out, and the plan."""

    type: str
    table: str
    ms: float
    scanned_segments: int
    scanned_recs: int
    output_recs: int
    plan: str

    def lines(self, prefix: str = "") -> list[str]:
        """As statsd lines."""
        name = f"{prefix}query.{self.type}.{self.table}"
        return [f"{name}.time:{self.ms:.0f}|ms", f"{name}.rows:{self.output_recs}|c", f"{name}.scanned:{self.scanned_recs}|c", f"{name}.segments:{self.scanned_segments}|c"]


class Engine:
    """Tables of pre-aggregated rows on one Spark session.

    ``path`` is a folder that driver and executors share (default: a new one below the
    warehouse).  Tables that an earlier engine left there are opened as they were; one engine
    at a time may load into them.
    ``clock`` gives the present in epoch seconds, from which time rollup counts back.
    ``statsd`` ({host, port, prefix}) is where the statistics of loads and of profiled
    queries go, as UDP packets; nobody waits for them.
    """

    def __init__(self, spark: SparkSession, config: dict | None = None, *, path: str | None = None, clock: Callable[[], float] = time.time, statsd: dict | None = None):
        self.statsd = statsd or {}
        self.spark = spark
        self.clock = clock
        self.path = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/rollstore-{uuid.uuid4().hex}"
        self.tables: dict[str, Table] = {}
        self.files = Files(spark)
        self.loads: list[LoadStats] = []
        self._writer = threading.RLock()
        for name in self.files.names(self.path) if path else []:
            self._open(f"{self.path}/{name}")
        for cfg in (config or {}).get("tables", []):
            if cfg["name"] not in self.tables:
                self.create_table(cfg)
            elif TableSpec.from_config(cfg) != self.tables[cfg["name"]].spec:
                raise ValueError(f"Table {cfg['name']} is stored with another definition")
        for table in self.tables.values():
            self._start_watching(table)

    # Catalog

    def create_table(self, cfg: dict, source: DataFrame | None = None) -> Table:
        """A new table; with ``source`` it lies over that DataFrame and takes no loads."""
        spec = TableSpec.from_config(cfg)
        if spec.name in self.tables:
            raise ValueError(f"Table already exists: {spec.name}")
        table = Table(spec, f"{self.path}/{folder_name(spec.name)}", cfg, source=source)
        if source is None:
            self._publish(table)
        self.tables[spec.name] = table
        self._start_watching(table)
        return table

    def _open(self, path: str) -> None:
        """The table of a folder, if its last manifest says that there is one."""
        versions = [n for n in self.files.names(f"{path}/_manifest") if n.endswith(".json") and n[0] != "."]
        if versions:
            cfg = json.loads(self.files.read(f"{path}/_manifest/{versions[-1]}"))
            spec = TableSpec.from_config(cfg["config"])
            self.tables[spec.name] = Table(spec, path, version=int(versions[-1][:-5]), **cfg)

    def _publish(self, table: Table) -> None:
        """Writes the table's state as its next manifest; the one before stays for readers of that moment."""
        table.version += 1
        self.files.write(f"{table.path}/_manifest/{table.version:010d}.json", table.manifest())
        if table.version > 2:
            self.files.delete(f"{table.path}/_manifest/{table.version - 2:010d}.json")

    def _start_watching(self, table: Table) -> None:
        """Loads what is moved into the folder that the definition names, from the table's creation on."""
        if table.spec.watch and table.stream is None:
            from .streaming import watch

            folder = table.spec.watch["directory"]
            self.files.make(folder)
            table.stream = watch.watch(self, table.spec.name, folder, f"{table.path}/_watch", extensions=tuple(table.spec.watch.get("extensions", (".tsv",))), columns=table.spec.watch.get("columns"))

    def stop(self) -> None:
        """Ends the streams of watched folders; what they have loaded stays."""
        for table in self.tables.values():
            if table.stream is not None:
                table.stream.stop()
                table.stream = None

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ValueError(f"No such table: {name}")
        return self.tables[name]

    def drop_table(self, name: str) -> None:
        table = self.table(name)
        if table.stream is not None:
            table.stream.stop()
        if table.source is None:
            self.files.delete(table.path)
        del self.tables[name]

    def applied(self, kind: str) -> int:
        """The last number of a kind that any table has applied."""
        return max((t.applied.get(kind, 0) for t in self.tables.values()), default=0)

    def mark(self, names: list[str], marks: dict[str, int]) -> None:
        """Remembers numbers as applied to tables, without a load."""
        with self._writer:
            for name in names:
                table = self.table(name)
                table.applied |= {k: max(v, table.applied.get(k, v)) for k, v in marks.items()}
                self._publish(table)

    @property
    def last_batch_id(self) -> int:
        """The last micro-batch applied."""
        return self.applied("micro")

    @property
    def last_historic_id(self) -> int:
        return self.applied("historic")

    # Loads

    def load(self, cfg: dict) -> int:
        """Loads a file (or folder, or glob) of records; gives the number of rows it stored."""
        kind = cfg.get("source", cfg.get("type", "file"))
        if kind != "file":
            raise ValueError(f"Unsupported input source: {kind}")
        if cfg.get("format", "tsv") != "tsv":
            raise ValueError("unknown input format (supported formats: TSV)")
        table = self.table(cfg["table"])
        paths = cfg["file"] if isinstance(cfg["file"], list) else [cfg["file"]]
        for p in paths:
            if not self.files.matches(p):
                raise ValueError(f"File not accessible: {p}")
        fields = ingest.input_fields(table.spec, cfg.get("columns"))
        width = len(cfg["columns"]) if "columns" in cfg else len(fields)
        records = ingest.tsv(self.spark, paths, width, table.batch + 1, bool(cfg.get("recursive")))
        marks = dict(cfg.get("marks", {}))
        if "batch_id" in cfg:
            marks["micro"] = int(cfg["batch_id"])
        return self.load_records(table, records, fields, cfg.get("partition_filter"), marks)

    def load_rows(self, name: str, rows: list[list[str]], columns: list[str] | None = None, partition_filter: dict | None = None) -> int:
        """Loads rows of texts from memory."""
        table = self.table(name)
        fields = ingest.input_fields(table.spec, columns)
        return self.load_records(table, ingest.memory(self.spark, rows, table.batch + 1), fields, partition_filter)

    def load_records(self, table: Table, records: DataFrame, fields: dict[str, int], partition_filter: dict | None = None, marks: dict[str, int] | None = None) -> int:
        """Loads (f, sequence) records; ``marks`` are the numbers of batches or streams that they complete."""
        if partition_filter:
            records = ingest.partition_filtered(records, table.spec, fields, partition_filter)
        return self._store(table, ingest.typed(table.spec, records, fields, int(self.clock())), marks)

    def load_frame(self, name: str, df: DataFrame) -> int:
        """Loads a DataFrame whose columns are named like the input fields."""
        table = self.table(name)
        return self._store(table, ingest.from_columns(table.spec, df, int(self.clock()), table.batch + 1))

    def _store(self, table: Table, rows: DataFrame, marks: dict[str, int] | None = None) -> int:
        """Limits, full-key merge, and one written delta; visible only when all of it is written."""
        if table.source is not None:
            raise ValueError(f"Table {table.spec.name} lies over a DataFrame")
        began = time.perf_counter()
        with self._writer:
            table.batch += 1
            fresh: dict[str, str] = {}
            for d in table.spec.dimensions:
                if d.kind == "string" and d.cardinality < UNLIMITED:
                    old = self._admitted(table, f"cap-{d.name}", f"v {d.spark}")
                    new = limits.newly_capped(rows, d, old, old.count() if old is not None else 0)
                    rows = limits.capped(rows, d, self._admit(table, f"cap-{d.name}", new, old, fresh))
            for d in table.spec.dimensions:
                if d.guard:
                    kinds = ", ".join(f"k{i} {table.spec.column(k).spark}" for i, k in enumerate(d.guard.dimensions))
                    old = self._admitted(table, f"guard-{d.name}", f"{kinds}, v {d.spark}")
                    rows = limits.guarded(rows, d, self._admit(table, f"guard-{d.name}", limits.newly_guarded(rows, d, old), old, fresh))
            delta = merge.record_states(table.spec, rows)
            times = [col(d.name) for d in table.spec.dimensions if d.kind == "time"]
            path = self._write(table, delta, times)
            if not table.schema:
                table.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in delta.schema.fields)
            stored = self.spark.read.parquet(path).count() if self.files.holds(path, ".parquet") else 0
            for key, p in fresh.items():
                table.admitted.setdefault(key, []).append(p)
            if stored:
                table.deltas[path] = stored
            for k, v in (marks or {}).items():
                table.applied[k] = max(v, table.applied.get(k, v))
            # One step makes everything visible.
            self._publish(table)
            self.loads.append(LoadStats(table.spec.name, (time.perf_counter() - began) * 1000, stored))
            self._report(self.loads[-1])
            if len(table.deltas) >= COMPACT_AT:
                self.compact(table.spec.name)
            return stored

    def _write(self, table: Table, rows: DataFrame, times: list) -> str:
        """One delta: laid out by the key's partition, and sorted by time so that row groups have narrow ranges to skip by."""
        path = f"{table.path}/__delta={table.batch:08d}-{uuid.uuid4().hex[:8]}"
        if table.spec.partitions:
            keys = [col(k).cast("string") for k in table.spec.partition_by]
            rows = rows.drop("__part").withColumn("__part", F.pmod(F.crc32(F.concat(*keys)), F.lit(table.spec.partitions)).cast("int"))
            rows.sortWithinPartitions("__part", *times).write.partitionBy("__part").parquet(path)
        else:
            (rows.sortWithinPartitions(*times) if times else rows).write.parquet(path)
        return path

    def _admitted(self, table: Table, key: str, schema: str) -> DataFrame | None:
        paths = table.admitted.get(key)
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def _admit(self, table: Table, key: str, new: DataFrame, old: DataFrame | None, fresh: dict[str, str]) -> DataFrame:
        path = f"{table.path}/admitted-{zlib.crc32(key.encode()):08x}-{table.batch:08d}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(path)
        fresh[key] = path
        written = self.spark.read.schema(new.schema).parquet(path)
        return written if old is None else old.unionByName(written)

    def compact(self, name: str) -> None:
        """Merges a table's deltas into one, in which every key has a single row."""
        table = self.table(name)
        with self._writer:
            if len(table.deltas) < 2:
                return
            table.batch += 1
            rows = merge.stored_rows(table.spec, self.deltas(table))
            path = self._write(table, rows, [col(d.name) for d in table.spec.dimensions if d.kind == "time"])
            gone, table.retired = table.retired, list(table.deltas)
            table.deltas = {path: self.spark.read.parquet(path).count()}
            self._publish(table)
            for p in gone:
                self.files.delete(p)

    # Queries

    def deltas(self, table: Table, f: dict | None = None) -> DataFrame:
        """All states of a table that may pass the filter, not merged with each other."""
        if table.source is not None:
            p = pushdown.implied(table.spec, table.source, f)
            source = table.source if p is None else table.source.where(p)
            return row_states(table.spec, ingest.from_columns(table.spec, source, int(self.clock()), 0, ordered=False))
        if table.deltas:
            # One scan, however many loads there were; its files are listed once for each state of the table.
            if table.scan is None or table.scan[0] != table.version:
                part = ", `__part` int" if table.spec.partitions and "`__part`" not in table.schema else ""
                read = self.spark.read.schema(table.schema + part).option("basePath", table.path).parquet(*table.deltas)
                table.scan = (table.version, read.drop("__delta"))
            return table.scan[1]
        empty = self.spark.createDataFrame([], "f array<string>, " + f"{SEQ} struct<b:int,f:string,o:bigint,n:bigint>")
        fields = {c.name: 0 for c in table.spec.columns}
        return row_states(table.spec, ingest.typed(table.spec, empty, fields, int(self.clock())))

    def query(self, q: dict) -> DataFrame:
        """The typed result of a query descriptor."""
        kind = q.get("type")
        if kind == "show":
            if q.get("what") == "tables":
                return self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "table string")
            if q.get("what") == "workers":
                return self.workers()
            raise ValueError(f"don't know how to show {q.get('what')}")
        plan = {"aggregate": planner.aggregate, "select": planner.select, "search": planner.search}.get(kind)
        if plan is None:
            raise ValueError(f"unsupported query type: {kind}")
        table = self.table(q["table"])
        q = q | {"arrival": table.source is None}
        return plan(table.spec, self._pruned(table, q.get("filter")), q, int(self.clock()), table.is_merged)

    def _pruned(self, table: Table, f: dict | None) -> DataFrame:
        rows = self.deltas(table, f)
        if not table.spec.partitions or table.source is not None:
            return rows
        spec = table.spec
        targets = partitions.target_partitions(f, list(spec.partition_by), spec.partitions, canonical=lambda name, text: filters.stored_text(spec.column(name), text))
        return rows if targets is None else rows.where(F.col("__part").isin(targets))

    def workers(self) -> DataFrame:
        """Block managers of the session as host:port."""
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        found = sorted(str(k) for k in self.spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status.keySet()))
        return self.spark.createDataFrame([(w,) for w in found], "worker string")

    def sql(self, text: str) -> DataFrame | None:
        """The result of a SQL query; None after COPY statements."""
        statements = sql.parse(text)
        for s in statements:
            if "load" in s:
                self.load(s["load"])
        return None if "load" in statements[0] else self.query(statements[0])

    def rows(self, q: dict | str, header: bool | None = None) -> Iterator[list[str]]:
        """The result as texts, streamed."""
        df = self.sql(q) if isinstance(q, str) else self.query(q)
        if df is None:
            return iter(())
        wanted = header if header is not None else isinstance(q, dict) and bool(q.get("header"))
        return render.rows(df, wanted and not (isinstance(q, dict) and q.get("type") == "show"))

    def tsv(self, q: dict | str, header: bool = False) -> Iterator[str]:
        for r in self.rows(q, header or None):
            yield "\t".join(r) + "\n"

    def profile(self, q: dict) -> QueryStats:
        """Runs a query, whose rows go nowhere, and tells what it took."""
        name = q.get("table", "")
        stored = self.table(name) if name else None
        began = time.perf_counter()
        df, seen = self.query(q), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        ms, plan = (time.perf_counter() - began) * 1000, df._jdf.queryExecution().executedPlan().toString()
        stats = QueryStats(q["type"], name, ms, len(stored.deltas) if stored else 0, stored.records if stored else 0, seen.get["n"], plan)
        self._report(stats)
        return stats

    def _report(self, stats: LoadStats | QueryStats) -> None:
        if self.statsd:
            lines = stats.lines(self.statsd.get("prefix", ""))
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                s.sendto("\n".join(lines).encode(), (self.statsd.get("host", "127.0.0.1"), int(self.statsd.get("port", 8125))))

    # Metadata

    def meta(self) -> dict:
        return {"tables": [{"name": n} for n in self.tables]}

    def table_meta(self, name: str) -> dict:
        """Row count, ranges of numeric and time dimensions, and numbers of distinct strings."""
        table = self.table(name)
        spec = table.spec
        ranged = [d for d in spec.dimensions if d.kind in ("numeric", "time")]
        strings = [d for d in spec.dimensions if d.kind == "string"]
        aggs = [F.count(F.lit(1)).alias("n")]
        aggs += [f(col(d.name)).alias(f"{k}{i}") for i, d in enumerate(ranged) for k, f in (("lo", F.min), ("hi", F.max))]
        aggs += [F.count_distinct(col(d.name)).alias(f"s{i}") for i, d in enumerate(strings)]
        r = merge.stored_rows(spec, self.deltas(table), [], seq=False).agg(*aggs).first()
        segment = {d.name: {"min": r[f"lo{i}"], "max": r[f"hi{i}"]} for i, d in enumerate(ranged)}
        # The stand-in for values beyond a limit counts as one.
        counts = {d.name: r[f"s{i}"] + 1 for i, d in enumerate(strings)}
        return {
            "name": spec.name, "segments": [segment] if r["n"] else [], "records_num": r["n"],
            "dimensions": [{"name": d.name} | ({"cardinality": counts[d.name]} if d.name in counts else {}) for d in spec.dimensions],
            "metrics": [{"name": m.name} for m in spec.metrics],
        }
