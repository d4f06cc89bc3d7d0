"""Queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans.partitions import partition_of
from .types import NUM_TYPES

#: A fixed present for rollup by age: 2024-01-01 00:00:00 UTC.
NOW = 1704067200

COUNT = {"name": "count", "type": "count"}
LINEITEM = {
    "name": "lineitem",
    "dimensions": [{"name": "l_returnflag"}, {"name": "l_linestatus"}, {"name": "l_shipdate", "type": "time", "granularity": "month"}],
    "metrics": [
        COUNT, {"name": "qty_sum", "type": "double_sum", "field": "l_quantity"}, {"name": "price_min", "type": "double_min", "field": "l_extendedprice"}, {"name": "price_max", "type": "double_max", "field": "l_extendedprice"},
        {"name": "disc_avg", "type": "double_avg", "field": "l_discount"}, {"name": "line_sum", "type": "int_sum", "field": "l_linenumber"},
    ],
}
EVENTS = {
    "name": "events",
    "dimensions": [{"name": "event_type"}, {"name": "ts", "type": "time"}],
    "metrics": [COUNT, {"name": "value_sum", "type": "double_sum", "field": "value"}, {"name": "value_max", "type": "double_max", "field": "value"}, {"name": "users", "type": "bitset", "field": "user_id"}],
}
DAILY = EVENTS | {"dimensions": [{"name": "event_type"}, {"name": "ts", "type": "time", "granularity": "day"}]}
ORDERS = {
    "name": "orders",
    "dimensions": [{"name": "o_orderstatus"}, {"name": "o_orderpriority"}, {"name": "o_orderdate", "type": "time", "granularity": "month"}],
    "metrics": [COUNT, {"name": "total_sum", "type": "double_sum", "field": "o_totalprice"}, {"name": "custs", "type": "bitset", "field": "o_custkey"}],
}
CUSTOMER = {"name": "customer", "dimensions": [{"name": "c_mktsegment"}, {"name": "c_nationkey", "type": "int"}], "metrics": [{"name": "bal_avg", "type": "double_avg", "field": "c_acctbal"}, {"name": "bal_min", "type": "double_min", "field": "c_acctbal"}]}
PART = {"name": "part", "dimensions": [{"name": "p_brand"}, {"name": "p_size", "type": "int"}], "metrics": [COUNT, {"name": "price_sum", "type": "double_sum", "field": "p_retailprice"}]}
CUBES = {c["name"]: c for c in (LINEITEM, EVENTS, ORDERS, CUSTOMER, PART)}

#: SQL for stored rows: merged on the full key.
STORED = {
    "events": "SELECT event_type, epoch_us(ts) // 1000000 AS ts, count(*) AS count, sum(value) AS value_sum, max(value) AS value_max, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "daily": "SELECT event_type, epoch_us(date_trunc('day', ts)) // 1000000 AS ts, count(*) AS count, sum(value) AS value_sum, max(value) AS value_max, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "orders": "SELECT o_orderstatus, o_orderpriority, epoch_us(date_trunc('month', o_orderdate)) // 1000000 AS o_orderdate, count(*) AS count, sum(o_totalprice) AS total_sum, count(DISTINCT o_custkey) AS custs FROM orders GROUP BY ALL",
    "part": "SELECT p_brand, p_size, count(*) AS count, sum(p_retailprice) AS price_sum FROM part GROUP BY ALL",
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, cfg: dict, now: int = NOW) -> Engine:
    """An engine with one table over a Parquet table."""
    e = Engine(spark, clock=lambda: now)
    name = cfg.get("parquet", cfg["name"])
    e.create_table(cfg, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return e


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 2).alias(c) if c in names else F.col(c) for c in df.columns))


def over(cfg: dict, q: dict | str, *money: str) -> Query:
    """A query over one cube; sums of doubles named in ``money`` are rounded, as their order is free."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, cfg)
        df = e.sql(q) if isinstance(q, str) else e.query({"type": "aggregate", "table": cfg["name"]} | q)
        return rounded(df, *money)

    return run


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def op(kind: str, column: str, value: str) -> dict:
    return {"op": kind, "column": column, "value": value}


def _aggregations() -> None:
    add("agg_count_sum", over(LINEITEM, {"dimensions": ["l_returnflag", "l_linestatus"], "metrics": ["count", "qty_sum"]}, "qty_sum"),
        "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 2) AS qty_sum FROM lineitem GROUP BY ALL")
    add("agg_min_max", over(LINEITEM, {"dimensions": ["l_linestatus"], "metrics": ["price_min", "price_max"]}),
        "SELECT l_linestatus, min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max FROM lineitem GROUP BY ALL")
    add("agg_avg", over(LINEITEM, {"dimensions": ["l_returnflag"], "metrics": ["disc_avg"]}, "disc_avg"),
        "SELECT l_returnflag, round(sum(l_discount) / count(*), 2) AS disc_avg FROM lineitem GROUP BY ALL")
    add("agg_avg_hidden_count", over(CUSTOMER, {"dimensions": ["c_mktsegment"], "metrics": ["bal_avg", "bal_min"]}, "bal_avg"),
        "SELECT c_mktsegment, round(sum(c_acctbal) / count(*), 2) AS bal_avg, min(c_acctbal) AS bal_min FROM customer GROUP BY ALL")
    for t in NUM_TYPES.values():
        metrics = [COUNT, *({"name": f"m_{a}", "type": f"{t.name}_{a}", "field": "l_linenumber"} for a in ("sum", "min", "max", "avg"))]
        cfg = {"name": "lineitem", "dimensions": [{"name": "l_returnflag"}], "metrics": metrics}
        kind = {"float": "FLOAT", "double": "DOUBLE", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "decimal(20,0)": "BIGINT"}[t.spark]
        total = "DOUBLE" if t.is_float else "BIGINT"

        def typed(spark: SparkSession, sf_dir: str, cfg: dict = cfg) -> DataFrame:
            df = engine(spark, sf_dir, cfg).query({"type": "aggregate", "table": "lineitem", "dimensions": ["l_returnflag"], "metrics": ["count", "m_sum", "m_min", "m_max", "m_avg"]})
            # Decimals, which stand for 64 unsigned bits, as bigints: engines show them differently.
            return df.select(*(F.col(c).cast("bigint").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))

        add(f"agg_{t.name}_metrics", typed,
            f"SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS {total}) AS m_sum, CAST(min(l_linenumber) AS {kind}) AS m_min, CAST(max(l_linenumber) AS {kind}) AS m_max, sum(l_linenumber)::DOUBLE / count(*) AS m_avg FROM lineitem GROUP BY ALL")
    # Values over the whole range of each type, negative ones too.
    for t in (t for t in NUM_TYPES.values() if not t.is_float):
        span, low = t.high - t.low + 1, t.low
        wide = 1 << 40 if t.high > 1 << 40 else span
        cfg = {"name": "lineitem", "dimensions": [{"name": "l_returnflag"}], "metrics": [COUNT, *({"name": f"m_{a}", "type": f"{t.name}_{a}", "field": "v"} for a in ("sum", "min", "max", "avg"))]}
        shift = f"(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % {wide} - {-low if low and wide == span else (wide // 2 if low else 0)}"

        def ranged(spark: SparkSession, sf_dir: str, cfg: dict = cfg, shift: str = shift) -> DataFrame:
            e = Engine(spark)
            e.create_table(cfg, spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_returnflag", f"{shift} AS v"))
            df = e.query({"type": "aggregate", "table": "lineitem", "dimensions": ["l_returnflag"], "metrics": ["count", "m_sum", "m_min", "m_max", "m_avg"]})
            return df.select("l_returnflag", "count", *(F.col(c).cast("bigint").alias(c) for c in ("m_sum", "m_min", "m_max")), "m_avg")

        add(f"agg_{t.name}_range", ranged,
            f"SELECT l_returnflag, count(*) AS count, CAST(sum(v) AS BIGINT) AS m_sum, CAST(min(v) AS BIGINT) AS m_min, CAST(max(v) AS BIGINT) AS m_max, sum(v)::DOUBLE / count(*) AS m_avg FROM (SELECT l_returnflag, {shift} AS v FROM lineitem) GROUP BY ALL")
    # Sums beyond the declared width wrap: 64 bits always, others where asked for.
    for kind, width, value, extra in (("long", 64, "l_linenumber * CAST(1152921504606846976 AS BIGINT) - 1", {}), ("int", 32, "l_orderkey % 1000 * 2000000 + l_linenumber", {"strict_width": True}), ("byte", 8, "l_orderkey % 250 - 125", {"strict_width": True})):
        cfg = {"name": "lineitem", "dimensions": [{"name": "l_returnflag"}], "metrics": [COUNT, {"name": "v_sum", "type": f"{kind}_sum", "field": "v"}]} | extra

        def wrapped(spark: SparkSession, sf_dir: str, cfg: dict = cfg, value: str = value) -> DataFrame:
            e = Engine(spark, {"tables": [cfg]})
            df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_returnflag", "l_linenumber", f"{value} AS v")
            e.load_frame("lineitem", df.where("l_linenumber < 4").drop("l_linenumber"))
            e.load_frame("lineitem", df.where("l_linenumber >= 4").drop("l_linenumber"))
            return e.sql("SELECT l_returnflag, v_sum FROM lineitem").select("l_returnflag", F.col("v_sum").cast("bigint").alias("v_sum"))

        half, whole = 1 << width - 1, 1 << width
        add(f"agg_{kind}_wrap", wrapped,
            f"SELECT l_returnflag, CAST(((sum(({value})::HUGEINT) + {half}::HUGEINT) % {whole}::HUGEINT + {whole}::HUGEINT) % {whole}::HUGEINT - {half}::HUGEINT AS BIGINT) AS v_sum FROM lineitem GROUP BY ALL")
    add("agg_bitset_users", over(EVENTS, {"dimensions": ["event_type"], "metrics": ["users", "count", "value_sum"]}, "value_sum"),
        "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS count, round(sum(value), 2) AS value_sum FROM events GROUP BY ALL")
    add("agg_no_dims", over(EVENTS, {"dimensions": [], "metrics": ["count", "users", "value_max"]}),
        "SELECT count(*) AS count, count(DISTINCT user_id) AS users, max(value) AS value_max FROM events")
    add("agg_no_dims_empty", over(EVENTS, {"dimensions": [], "metrics": ["count"], "filter": op("eq", "event_type", "none")}),
        "SELECT count(*) AS count FROM events WHERE event_type = 'none' HAVING count(*) > 0")
    add("agg_no_metrics_distinct", over(LINEITEM, {"dimensions": ["l_returnflag", "l_linestatus"], "metrics": []}),
        "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
    add("agg_wildcard", over(PART, {"select": [{"column": "*"}]}, "price_sum"), "SELECT p_brand, p_size, count, round(price_sum, 2) AS price_sum FROM (" + STORED["part"] + ")")
    add("agg_select_order", over(LINEITEM, {"select": [{"column": "count"}, {"column": "l_returnflag"}, {"column": "line_sum"}]}),
        "SELECT count(*) AS count, l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS line_sum FROM lineitem GROUP BY l_returnflag")


def _filters() -> None:
    def by_size(name: str, f: dict | None, where: str) -> None:
        q = {"dimensions": ["p_brand", "p_size"], "metrics": ["count"]} | ({"filter": f} if f else {})
        add(name, over(PART, q), f"SELECT p_brand, p_size, count(*) AS count FROM part WHERE {where} GROUP BY ALL")

    for kind, sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
        by_size(f"filter_{kind}", op(kind, "p_size", "20"), f"p_size {sign} 20")
    some = {"op": "in", "column": "p_size", "values": ["1", "7", "30"]}
    both = [op("gt", "p_size", "10"), op("lt", "p_brand", "Brand#3")]
    by_size("filter_in", some, "p_size IN (1, 7, 30)")
    by_size("filter_not_in", {"op": "not", "filter": some}, "p_size NOT IN (1, 7, 30)")
    by_size("filter_and", {"op": "and", "filters": both}, "p_size > 10 AND p_brand < 'Brand#3'")
    by_size("filter_or", {"op": "or", "filters": both}, "p_size > 10 OR p_brand < 'Brand#3'")
    by_size("filter_not_demorgan", {"op": "not", "filter": {"op": "or", "filters": both}}, "p_size <= 10 AND p_brand >= 'Brand#3'")
    by_size("filter_not_not", {"op": "not", "filter": {"op": "not", "filter": both[0]}}, "p_size > 10")
    by_size("filter_empty", None, "true")
    by_size("filter_unknown_string", op("eq", "p_brand", "nowhere"), "false")
    by_size("filter_unknown_string_ne", op("ne", "p_brand", "nowhere"), "true")
    add("filter_metric_stored", over(ORDERS, {"dimensions": ["o_orderstatus"], "metrics": ["count", "total_sum"], "filter": op("gt", "count", "3")}, "total_sum"),
        f"SELECT o_orderstatus, CAST(sum(count) AS BIGINT) AS count, round(sum(total_sum), 2) AS total_sum FROM ({STORED['orders']}) WHERE count > 3 GROUP BY ALL")
    add("filter_bitset_cardinality", over(ORDERS, {"dimensions": ["o_orderstatus"], "metrics": ["count"], "filter": op("gt", "custs", "2")}),
        f"SELECT o_orderstatus, CAST(sum(count) AS BIGINT) AS count FROM ({STORED['orders']}) WHERE custs > 2 GROUP BY ALL")
    flag = {"name": "part", "parquet": "part", "dimensions": [{"name": "p_brand"}, {"name": "big", "type": "boolean"}], "metrics": [COUNT]}

    def boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.create_table(flag, spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("big", F.col("p_size") > 25))
        return e.query({"type": "aggregate", "table": "part", "dimensions": ["p_brand", "big"], "metrics": ["count"], "filter": op("eq", "big", "true"), "sort": [{"column": "big"}]})

    add("filter_boolean", boolean, "SELECT p_brand, p_size > 25 AS big, count(*) AS count FROM part WHERE p_size > 25 GROUP BY ALL")
    for name, text, where in (
        ("date", "1996-06-01", "ts >= TIMESTAMP '2024-01-15'"), ("datetime", "2024-01-15 12:30:00", "ts >= TIMESTAMP '2024-01-15 12:30:00'"), ("epoch", "1705321800", "ts >= TIMESTAMP '2024-01-15 12:30:00'"),
    ):
        text = "2024-01-15" if name == "date" else text
        add(f"filter_time_literal_{name}", over(EVENTS, {"dimensions": ["event_type"], "metrics": ["count"], "filter": op("ge", "ts", text)}),
            f"SELECT event_type, count(*) AS count FROM events WHERE {where} GROUP BY ALL")
    add("having_simple", over(PART, {"dimensions": ["p_size"], "metrics": ["count"], "having": op("gt", "count", "3")}),
        "SELECT p_size, count(*) AS count FROM part GROUP BY ALL HAVING count(*) > 3")
    add("having_and", over(PART, {"dimensions": ["p_size"], "metrics": ["count", "price_sum"], "having": {"op": "and", "filters": [op("gt", "count", "2"), op("lt", "price_sum", "50000")]}}, "price_sum"),
        "SELECT p_size, count(*) AS count, round(sum(p_retailprice), 2) AS price_sum FROM part GROUP BY ALL HAVING count(*) > 2 AND sum(p_retailprice) < 50000")
    add("having_dim", over(PART, {"dimensions": ["p_size"], "metrics": ["count"], "having": op("le", "p_size", "10")}),
        "SELECT p_size, count(*) AS count FROM part WHERE p_size <= 10 GROUP BY ALL")


def _pages() -> None:
    size = {"dimensions": ["p_size"], "metrics": ["count"]}
    by_count = [{"column": "count"}, {"column": "p_size", "ascending": True}]
    group = "SELECT p_size, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, p_size"
    add("sort_multi", over(PART, size | {"sort": by_count}), group)
    add("topn", over(PART, size | {"sort": by_count, "limit": 5}), group + " LIMIT 5")
    add("limit_offset", over(PART, size | {"sort": by_count, "limit": 5, "skip": 3}), group + " LIMIT 5 OFFSET 3")
    add("sort_negative", over(CUSTOMER, {"dimensions": ["c_nationkey", "c_mktsegment"], "metrics": ["bal_min"], "sort": [{"column": "bal_min", "ascending": True}, {"column": "c_nationkey"}, {"column": "c_mktsegment"}], "limit": 10}),
        "SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS bal_min FROM customer GROUP BY ALL ORDER BY bal_min, c_nationkey DESC, c_mktsegment DESC LIMIT 10")
    part = f"({STORED['part']})"
    add("select_raw", over(PART, {"type": "select", "dimensions": ["p_brand", "p_size"], "metrics": ["count"]}), f"SELECT p_brand, p_size, count FROM {part}")
    add("select_raw_star", over(PART, {"type": "select", "select": [{"column": "*"}]}, "price_sum"), f"SELECT p_brand, p_size, count, round(price_sum, 2) AS price_sum FROM {part}")
    add("select_raw_filter", over(PART, {"type": "select", "dimensions": ["p_brand", "p_size"], "metrics": ["count"], "filter": {"op": "and", "filters": [op("gt", "count", "1"), op("lt", "p_size", "25")]}}),
        f"SELECT p_brand, p_size, count FROM {part} WHERE count > 1 AND p_size < 25")
    add("select_raw_bitset", over(ORDERS, {"type": "select", "dimensions": ["o_orderstatus", "o_orderdate", "o_orderpriority"], "metrics": ["custs"]}),
        f"SELECT o_orderstatus, o_orderdate, o_orderpriority, custs FROM ({STORED['orders']})")
    add("search_contains", over(PART, {"type": "search", "dimension": "p_brand", "term": "2"}), "SELECT DISTINCT p_brand FROM part WHERE contains(p_brand, '2')")
    add("search_empty_term", over(LINEITEM, {"type": "search", "dimension": "l_returnflag", "term": ""}), "SELECT DISTINCT l_returnflag FROM lineitem")
    add("search_numeric", over(PART, {"type": "search", "dimension": "p_size", "term": "1", "filter": op("gt", "p_size", "12")}),
        "SELECT DISTINCT p_size::VARCHAR AS p_size FROM part WHERE p_size > 12 AND contains(p_size::VARCHAR, '1')")
    add("search_metric_filter", over(PART, {"type": "search", "dimension": "p_brand", "term": "Brand", "filter": op("gt", "count", "1")}),
        f"SELECT DISTINCT p_brand FROM {part} WHERE count > 1")

    def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        for c in CUBES.values():
            e.create_table(c, spark.read.parquet(f"{sf_dir}/{c['name']}.parquet"))
        return e.sql("SHOW TABLES")

    add("show_tables", tables, 'SELECT * FROM (VALUES ' + ", ".join(f"('{n}')" for n in sorted(CUBES)) + ') v("table")')
    # Names of workers depend on the cluster; that there are some doesn't.
    add("show_workers", lambda spark, sf_dir: Engine(spark).sql("SHOW WORKERS").agg((F.count(F.when(F.col("worker").rlike(r":\d+$"), 1)) > 0).alias("has_workers")), "SELECT true AS has_workers")


def _times() -> None:
    for unit in ("year", "month", "day", "hour", "minute", "second"):
        add(f"time_gran_{unit}", over(EVENTS, {"select": [{"column": "ts", "granularity": unit}, {"column": "count"}]}),
            f"SELECT CAST(epoch_us(date_trunc('{unit}', ts)) // 1000000 AS BIGINT) AS ts, count(*) AS count FROM events GROUP BY ALL")
    add("time_format", over(EVENTS, {"select": [{"column": "event_type"}, {"column": "ts", "granularity": "hour", "format": "%Y-%m-%d %T"}, {"column": "count"}], "sort": [{"column": "ts", "ascending": True}]}),
        "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS count FROM events GROUP BY ALL")
    add("time_format_letters", over(EVENTS, {"select": [{"column": "ts", "granularity": "day", "format": "%a %d %b %y, day %j"}, {"column": "count"}]}),
        "SELECT strftime(date_trunc('day', ts), '%a %d %b %y, day %j') AS ts, count(*) AS count FROM events GROUP BY ALL")
    for form, per in (("posix", 1_000_000), ("millis", 1000), ("micros", 1)):
        for kind in ("time", "microtime"):
            cfg = {"name": "events", "dimensions": [{"name": "event_type"}, {"name": "t", "type": kind, "format": form, "field": "raw"}], "metrics": [COUNT]}

            def units(spark: SparkSession, sf_dir: str, cfg: dict = cfg, per: int = per) -> DataFrame:
                e = Engine(spark)
                micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
                e.create_table(cfg, spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", ((micros - F.pmod(micros, F.lit(per))) / per).cast("bigint").alias("raw")))
                return e.query({"type": "aggregate", "table": "events", "dimensions": ["event_type", "t"], "metrics": ["count"]})

            to = f"epoch_us(ts) // {per} * {per}"
            add(f"time_units_{form}_{kind}", units, f"SELECT event_type, CAST({to}{' // 1000000' if kind == 'time' else ''} AS BIGINT) AS t, count(*) AS count FROM events GROUP BY ALL")
    rules = [{"granularity": "hour", "after": "1 days"}, {"granularity": "day", "after": "1 weeks"}, {"granularity": "month", "after": "2 weeks"}]
    now = "TIMESTAMP '2024-01-25 12:00:00'"
    by_age = f"CASE WHEN ts < {now} - INTERVAL 14 DAY THEN date_trunc('month', ts) WHEN ts < {now} - INTERVAL 7 DAY THEN date_trunc('day', ts) WHEN ts < {now} - INTERVAL 1 DAY THEN date_trunc('hour', ts) ELSE date_trunc('second', ts) END"

    def rollup(at_query: bool) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            clock = [0 if at_query else 1706184000]
            cfg = {"name": "events", "dimensions": [{"name": "event_type"}, {"name": "ts", "type": "time", "rollup_rules": rules}], "metrics": [COUNT]}
            e = Engine(spark, {"tables": [cfg]}, clock=lambda: clock[0])
            e.load_frame("events", spark.read.parquet(f"{sf_dir}/events.parquet"))
            # Rows stored when they were young are rolled up when a later query reads them.
            clock[0] = 1706184000
            return e.query({"type": "aggregate", "table": "events", "dimensions": ["event_type", "ts"], "metrics": ["count"]})

        return run

    # A row rolled up when it was stored may fall under an older rule at the query.
    for name, rows in (("rollup_ingest", f"SELECT event_type, {by_age} AS ts FROM events"), ("rollup_query", "SELECT event_type, ts FROM events")):
        add(name, rollup(name == "rollup_query"), f"SELECT event_type, CAST(epoch_us({by_age}) // 1000000 AS BIGINT) AS ts, count(*) AS count FROM ({rows}) GROUP BY ALL")


def _loads() -> None:
    shape = {"name": "orders", "dimensions": [{"name": "o_orderstatus"}, {"name": "o_orderpriority"}], "metrics": [COUNT, {"name": "total_sum", "type": "double_sum", "field": "o_totalprice"}, {"name": "total_max", "type": "double_max", "field": "o_totalprice"}]}
    group = "SELECT o_orderstatus, o_orderpriority, count(*) AS count, round(sum(o_totalprice), 2) AS total_sum, max(o_totalprice) AS total_max FROM orders GROUP BY ALL"

    def loaded(spark: SparkSession, sf_dir: str, compact: bool) -> DataFrame:
        e = Engine(spark, {"tables": [shape]})
        df = spark.read.parquet(f"{sf_dir}/orders.parquet")
        e.load_frame("orders", df.where("o_orderkey % 2 = 0"))
        e.load_frame("orders", df.where("o_orderkey % 2 <> 0"))
        if compact:
            e.compact("orders")
        return rounded(e.sql("SELECT * FROM orders"), "total_sum")

    add("upsert_two_batches", lambda s, d: loaded(s, d, False), group)
    add("compaction", lambda s, d: loaded(s, d, True), group)
    capped = {"name": "part", "dimensions": [{"name": "p_type", "length": 5}], "metrics": [COUNT]}
    add("length_cap", over(capped, {"dimensions": ["p_type"], "metrics": ["count"]}), "SELECT left(p_type, 5) AS p_type, count(*) AS count FROM part GROUP BY ALL")

    def records(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
        """A table as records whose order of arrival is that of their first column."""
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        seq = F.struct(F.lit(1).alias("b"), F.lit("").alias("f"), F.lit(0).cast("bigint").alias("o"), F.col(columns[0]).cast("bigint").alias("n"))
        return df.select(F.array(*(F.col(c).cast("string") for c in columns)).alias("f"), seq.alias("__seq"))

    def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [{"name": "part", "dimensions": [{"name": "p_type", "cardinality": 3}], "metrics": [COUNT]}]})
        e.load_records(e.table("part"), records(spark, sf_dir, "part", ["p_partkey", "p_type"]), {"p_type": 1})
        return e.sql("SELECT p_type, count FROM part")

    add("card_cap", cap, """WITH f AS (SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) AS r FROM part GROUP BY ALL)
SELECT CASE WHEN r <= 3 THEN p_type ELSE '__exceeded' END AS p_type, count(*) AS count FROM part JOIN f USING (p_type) GROUP BY ALL""")

    def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = {"dimensions": ["o_orderstatus"], "limit": 3}
        e = Engine(spark, {"tables": [{"name": "orders", "dimensions": [{"name": "o_orderstatus"}, {"name": "o_orderpriority", "cardinality_guard": rule}], "metrics": [COUNT]}]})
        e.load_records(e.table("orders"), records(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]), {"o_orderstatus": 1, "o_orderpriority": 2})
        return e.sql("SELECT * FROM orders")

    add("card_guard", guard, """WITH v AS (SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL),
f AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY first) AS r FROM v),
k AS (SELECT o_orderstatus, CASE WHEN r <= 3 THEN o_orderpriority ELSE '__exceeded' END AS o_orderpriority FROM orders JOIN f USING (o_orderstatus, o_orderpriority))
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM k GROUP BY ALL""")

    lines = ["o_orderstatus", "o_orderpriority", "o_totalprice"]

    def copied(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{Engine(spark).path}/orders.tsv"
        df = spark.read.parquet(f"{sf_dir}/orders.parquet")
        df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in lines)).alias("value")).write.text(path)
        e = Engine(spark, {"tables": [shape]})
        e.sql(f"COPY orders ({', '.join(lines)}) FROM '{path}' WITH FORMAT TSV")
        return rounded(e.sql("SELECT * FROM orders"), "total_sum")

    add("sql_copy", copied, group)

    def text_of(spark: SparkSession, sf_dir: str, path: str, where: str = "true", **options: str) -> str:
        """Orders as a file of fields in the order of ``lines``."""
        df = spark.read.parquet(f"{sf_dir}/orders.parquet").where(where)
        df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in lines)).alias("value")).write.options(**options).text(path)
        return path

    def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [shape]})
        e.load({"table": "orders", "file": text_of(spark, sf_dir, f"{e.path}/in"), "columns": lines})
        return rounded(e.sql("SELECT o_orderstatus, total_sum, total_max FROM orders"), "total_sum")

    add("field_mapping", mapped, "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total_sum, max(o_totalprice) AS total_max FROM orders GROUP BY ALL")

    def several(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [shape]})
        paths = [text_of(spark, sf_dir, f"{e.path}/in{k}", f"o_orderkey % 2 = {k}") for k in range(2)]
        e.sql(";\n".join(f"COPY orders ({', '.join(lines)}) FROM '{p}'" for p in paths) + "; -- both")
        return rounded(e.sql("SELECT * FROM orders"), "total_sum")

    add("sql_copy_list", several, group)

    def folder(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [shape]})
        for k in range(2):
            text_of(spark, sf_dir, f"{e.path}/in/sub{k}", f"o_orderkey % 2 = {k}", compression="gzip")
        e.load({"table": "orders", "file": f"{e.path}/in", "columns": lines, "recursive": True})
        return rounded(e.sql("SELECT * FROM orders"), "total_sum")

    add("load_compressed_folder", folder, group)

    def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [{"name": "nation", "dimensions": [{"name": "n_regionkey", "type": "ubyte"}, {"name": "n_name"}], "metrics": [COUNT, {"name": "keys", "type": "int_sum"}]}]})
        e.load_rows("nation", [[str(v) for v in r] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_name", "n_nationkey").collect()])
        return e.sql("SELECT n_regionkey, count, keys FROM nation").select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "count", "keys")

    add("load_memory_default_mapping", memory, "SELECT CAST(n_regionkey AS INTEGER) AS n_regionkey, count(*) AS count, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY n_regionkey")

    def announced(spark: SparkSession, sf_dir: str, historic: bool) -> DataFrame:
        from .streaming import watch

        e = Engine(spark, {"tables": [shape]})
        where = lambda k: {"orders": {"paths": [f"{e.path}/in{k}"], "columns": lines}}
        for k in range(2):
            text_of(spark, sf_dir, f"{e.path}/in{k}" + "/part=0" * (k == 0 and historic), f"o_orderkey % 2 = {k}", compression="gzip")
        if historic:
            watch.bootstrap(e, {"id": 3, "microbatch": 6, "tables": where(0)}, partitions=[0])
        else:
            watch.apply_message(e, {"id": 6, "tables": where(0)})
        # A number that is not new changes nothing.
        done = [watch.apply_message(e, {"id": n, "tables": where(1)}) for n in (6, 7, 7, 5)]
        assert done == [False, True, False, False]
        return rounded(e.sql("SELECT * FROM orders"), "total_sum")

    add("stream_announcements", lambda s, d: announced(s, d, False), group)
    add("stream_bootstrap", lambda s, d: announced(s, d, True), group)

    def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A watched folder whose engine is lost between batches: its successor has all rows, each once."""
        from .streaming import watch

        first = Engine(spark, {"tables": [shape]})
        path = first.path
        for k in range(3):
            e = first if k == 0 else Engine(spark, path=path)
            (text_of(spark, sf_dir, f"{path}/.draft{k}", f"o_orderkey % 3 = {k}"))
            spark.read.text(f"{path}/.draft{k}").write.mode("append").text(f"{path}/.in")
            query = watch.watch(e, "orders", f"{path}/.in", f"{path}/.checkpoint", extensions=(".txt",), columns=lines, trigger={"availableNow": True})
            query.awaitTermination()
        return rounded(Engine(spark, path=path).sql("SELECT * FROM orders"), "total_sum")

    add("stream_restart", reopened, group)

    def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [shape]})
        e.load_records(e.table("orders"), records(spark, sf_dir, "orders", ["o_orderkey", *lines]), {c: i + 1 for i, c in enumerate(lines[:2])} | {"total_sum": 3, "total_max": 3}, {"columns": lines[:1], "total_partitions": 3, "values": [0, 2]})
        return rounded(e.sql("SELECT * FROM orders"), "total_sum")

    # The order statuses whose hash falls into the partitions asked for.
    kept = ", ".join(f"'{s}'" for s in "FOP" if partition_of([s], 3) in (0, 2))
    add("partition_filter", filtered, group.replace("FROM orders", f"FROM orders WHERE o_orderstatus IN ({kept})"))

    def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [shape | {"partitioning": {"columns": ["o_orderstatus"], "total": 4}}]})
        e.load_frame("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
        return rounded(e.sql("SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')"), "total_sum")

    add("partition_pruning", pruned, group.replace("FROM orders", "FROM orders WHERE o_orderstatus IN ('F', 'O')"))

    # A literal may be written in another way than the stored key's text.
    for name, kind, value, texts, where in (
        ("int", "int", "o_custkey % 20", ["07", " 11"], "o_custkey % 20 IN (7, 11)"),
        ("time", "time", "unix_seconds(cast(o_orderdate AS timestamp))", ["1995-03-01", "1996-02-05 00:00:00"], "o_orderdate IN (DATE '1995-03-01', DATE '1996-02-05')"),
        ("double", "double", "cast(o_custkey % 20 AS double) / 2", ["1", "2.50"], "o_custkey % 20 IN (2, 5)"),
        ("boolean", "boolean", "o_custkey % 2 = 0", ["no"], "o_custkey % 2 <> 0"),
    ):
        cfg = {"name": "orders", "dimensions": [{"name": "o_orderstatus"}, {"name": "k", "type": kind}], "metrics": [COUNT], "partitioning": {"columns": ["k"], "total": 16}}

        def by_type(spark: SparkSession, sf_dir: str, cfg: dict = cfg, value: str = value, texts: list = texts) -> DataFrame:
            e = Engine(spark, {"tables": [cfg]})
            zoned = value.replace("cast(o_orderdate AS timestamp)", "to_timestamp(concat(cast(o_orderdate AS date), ' 00:00:00Z'))")
            e.load_frame("orders", spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderstatus", f"{zoned} AS k"))
            return e.query({"type": "aggregate", "table": "orders", "dimensions": ["o_orderstatus"], "metrics": ["count"], "filter": {"op": "in", "column": "k", "values": texts}})

        add(f"partition_pruning_{name}", by_type, f"SELECT o_orderstatus, count(*) AS count FROM orders WHERE {where} GROUP BY ALL")

    def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, {"tables": [{"name": "orders", "dimensions": [{"name": "o_orderkey", "type": "uint"}, {"name": "o_orderstatus"}], "metrics": [COUNT]}]})
        e.load_records(e.table("orders"), records(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]), {"o_orderkey": 0, "o_orderstatus": 1})
        return e.sql("SELECT RAW(o_orderkey, o_orderstatus) FROM orders LIMIT 5, 10")

    add("raw_skip_limit", arrived, "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")

    def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .streaming import watch

        e = Engine(spark, {"tables": [shape]})
        base = e.path
        df = spark.read.parquet(f"{sf_dir}/orders.parquet")
        text = df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in lines)).alias("value"))
        text.write.text(f"{base}/in")
        query = watch.watch(e, "orders", f"{base}/in", f"{base}/checkpoint", extensions=(".txt",), columns=lines, trigger={"availableNow": True})
        query.awaitTermination()
        return rounded(e.sql("SELECT * FROM orders"), "total_sum")

    add("stream_watch", streamed, group)

    def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = engine(spark, sf_dir, PART).table_meta("part")
        size = m["segments"][0]["p_size"]
        return spark.createDataFrame([(m["records_num"], size["min"], size["max"], m["dimensions"][0]["cardinality"])], "records_num long, lo int, hi int, brands long")

    add("table_meta", meta, f"SELECT count(*) AS records_num, min(p_size) AS lo, max(p_size) AS hi, count(DISTINCT p_brand) + 1 AS brands FROM ({STORED['part']})")

    def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .functions import render

        return render.lines(engine(spark, sf_dir, PART).sql("SELECT p_brand, p_size, count FROM part"))

    def texts(cfg: dict, q: dict) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .functions import render

            return render.lines(engine(spark, sf_dir, cfg).query({"type": "aggregate", "table": cfg["name"]} | q))

        return run

    floats = {"name": "part", "dimensions": [{"name": "p_size"}], "metrics": [{"name": "hi", "type": "double_max", "field": "p_retailprice"}, {"name": "lo", "type": "float_min", "field": "p_retailprice"}]}
    add("render_numbers", texts(floats, {"dimensions": ["p_size"], "metrics": ["hi", "lo"]}),
        r"SELECT p_size || chr(9) || regexp_replace(max(p_retailprice)::VARCHAR, '\.0$', '') || chr(9) || regexp_replace(min(p_retailprice)::FLOAT::VARCHAR, '\.0$', '') AS value FROM part GROUP BY p_size")

    def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .functions import render

        e = Engine(spark)
        e.create_table({"name": "part", "dimensions": [{"name": "big", "type": "boolean"}], "metrics": [COUNT]}, spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_size > 25 AS big"))
        return render.lines(e.sql("SELECT big, count FROM part"))

    add("render_booleans", flags, "SELECT (p_size > 25)::VARCHAR || chr(9) || count(*) AS value FROM part GROUP BY p_size > 25")
    dated = {"name": "events", "dimensions": [{"name": "ts", "type": "time", "granularity": "day", "format": "%d.%m.%Y"}], "metrics": [COUNT]}

    def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The select form takes the column's own format, the dimensions form none."""
        e = engine(spark, sf_dir, dated)
        plain = e.query({"type": "aggregate", "table": "events", "dimensions": ["ts"], "metrics": ["count"]})
        return e.sql("SELECT ts, count FROM events").unionByName(plain.withColumn("ts", F.col("ts").cast("string")))

    add("time_default_format", formats, """SELECT strftime(ts, '%d.%m.%Y') AS ts, count(*) AS count FROM events GROUP BY ALL
UNION ALL SELECT CAST(CAST(epoch_us(date_trunc('day', ts)) // 1000000 AS BIGINT) AS VARCHAR), count(*) FROM events GROUP BY ALL""")
    add("limit_without_sort", lambda s, d: engine(s, d, PART).sql("SELECT p_size, count FROM part LIMIT 7").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_size").alias("sizes")), "SELECT least(7, count(DISTINCT p_size)) AS n, least(7, count(DISTINCT p_size)) AS sizes FROM part")

    def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans.partitions import placement

        workers = [{"hostname": f"h{h}", "rack_id": str(h % 2), "http_port": p} for h in range(4) for p in (1, 2)]
        return spark.createDataFrame([(k, h, p) for k, hosts in enumerate(placement(4, 2, workers)) for h, p in hosts], "partition int, host string, port int")

    add("placement", placed, """SELECT CAST(i // 2 AS INTEGER) AS partition, 'h' || h AS host, CAST(port AS INTEGER) AS port FROM
(SELECT row_number() OVER (ORDER BY port, turn, rack) - 1 AS i, 2 * turn + rack AS h, port FROM range(1, 3) p(port), range(2) t(turn), range(2) r(rack))""")
    add("sql_limit_offset", over(PART, "SELECT p_size, count FROM part ORDER BY count DESC, p_size LIMIT 4 OFFSET 2"), "SELECT p_size, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, p_size LIMIT 4 OFFSET 2")

    def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Which of some statements are refused."""
        e, out = engine(spark, sf_dir, PART), []
        for text in ("SELECT p_size FROM", "SELECT p_size, FROM part", "SELECT x FROM part", "SELECT p_size FROM part WHERE p_size LIKE 1", "SELECT p_size FROM part ORDER BY count", "SELECT p_size FROM part"):
            try:
                e.sql(text)
                out.append((text, True))
            except ValueError:
                out.append((text, False))
        return spark.createDataFrame(out, "statement string, accepted boolean")

    add("sql_errors", errors, """SELECT * FROM (VALUES ('SELECT p_size FROM', false), ('SELECT p_size, FROM part', false), ('SELECT x FROM part', false),
('SELECT p_size FROM part WHERE p_size LIKE 1', false), ('SELECT p_size FROM part ORDER BY count', false), ('SELECT p_size FROM part', true)) v(statement, accepted)""")
    add("render_tsv", rendered, f"SELECT p_brand || chr(9) || p_size || chr(9) || count AS value FROM ({STORED['part']})")


def _sql() -> None:
    add("sql_aggregate", over(LINEITEM, "SELECT l_returnflag, count, qty_sum FROM lineitem WHERE l_linestatus = 'O' HAVING count > 1 ORDER BY l_returnflag", "qty_sum"),
        "SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 2) AS qty_sum FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING count(*) > 1")
    add("sql_between", over(PART, "SELECT p_brand, count FROM part WHERE p_size BETWEEN 10 AND 20"), "SELECT p_brand, count(*) AS count FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY ALL")
    add("sql_not", over(PART, "SELECT p_size, count FROM part WHERE NOT (p_size < 10 OR p_size IN (15, 16)) AND p_brand != 'Brand#11'"),
        "SELECT p_size, count(*) AS count FROM part WHERE NOT (p_size < 10 OR p_size IN (15, 16)) AND p_brand <> 'Brand#11' GROUP BY ALL")
    add("sql_top", over(PART, "SELECT p_size, count FROM part ORDER BY count DESC, p_size LIMIT 2, 4"), "SELECT p_size, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, p_size LIMIT 4 OFFSET 2")
    add("sql_raw", over(PART, "SELECT RAW(p_brand, p_size, count) FROM part WHERE count > 1"), f"SELECT p_brand, p_size, count FROM ({STORED['part']}) WHERE count > 1")
    add("sql_search", over(PART, "SELECT SEARCH(p_brand, '1') FROM part WHERE p_size > 5"), "SELECT DISTINCT p_brand FROM part WHERE contains(p_brand, '1') AND p_size > 5")
    add("sql_time", over(EVENTS, "SELECT event_type, count FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-20 06:00:00'"),
        "SELECT event_type, count(*) AS count FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 06:00:00' GROUP BY ALL")


for _section in (_aggregations, _filters, _pages, _times, _loads, _sql):
    _section()
