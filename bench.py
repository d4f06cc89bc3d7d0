"""Headline queries, timed: one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.  Each query is run once to warm up
and then three times; its time is the median.  Loads are timed apart from queries over the
stored table, and the same question over the raw table is the control.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rollstore import Engine, catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def timed(f, runs: int = RUNS) -> float:
    f()
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        f()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    out: dict[str, float] = {}

    stored = Engine(spark, clock=lambda: catalog.NOW)
    for cfg, column in ((catalog.LINEITEM, "lineitem"), (catalog.DAILY, "events"), (catalog.ORDERS, "orders")):
        source = spark.read.parquet(f"{SF}/{column}.parquet")

        def load(cfg: dict = cfg, source=source) -> None:
            if cfg["name"] in stored.tables:
                stored.drop_table(cfg["name"])
            stored.create_table(cfg)
            stored.load_frame(cfg["name"], source)

        out[f"load_{column}"] = timed(load)

    queries = {
        "agg_flags": "SELECT l_returnflag, l_linestatus, count, qty_sum, disc_avg FROM lineitem",
        "agg_filtered": "SELECT l_shipdate, count, price_max FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= '1997-01-01'",
        "agg_bitset": "SELECT event_type, users, count FROM events",
        "filter_on_metric": "SELECT o_orderstatus, count, total_sum FROM orders WHERE count > 100",
        "top": "SELECT o_orderdate, total_sum FROM orders ORDER BY total_sum DESC LIMIT 10",
        "raw_rows": "SELECT RAW(*) FROM orders WHERE o_orderstatus = 'F' LIMIT 50",
        "search": "SELECT SEARCH(o_orderpriority, 'E') FROM orders",
    }
    for name, text in queries.items():
        out[name] = timed(lambda text=text: done(stored.sql(text)))
    for name in ("agg_count_sum", "agg_bitset_users", "time_gran_day", "time_format", "rollup_query", "filter_metric_stored"):
        out[f"source_{name}"] = timed(lambda name=name: done(catalog.QUERIES[name](spark, SF)))
    raw = spark.read.parquet(f"{SF}/lineitem.parquet")
    out["control_raw_groupby"] = timed(lambda: done(raw.groupBy("l_returnflag", "l_linestatus").agg(F.count("*"), F.sum("l_quantity"))))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": SF}))


if __name__ == "__main__":
    main()
