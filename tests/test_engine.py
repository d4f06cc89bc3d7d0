import pytest
from fixtures import BASIC, COUNT, INAPP, SORT, TENANT_ROWS, TENANTS, TIME, TIME_ROWS, USER_ROWS, USERS, split

from rollstore import Engine


def engine(spark, cfg, *loads, clock=None):
    e = Engine(spark, {"tables": [cfg]}, **({"clock": clock} if clock else {}))
    for rows in loads:
        e.load_rows(cfg["name"], rows)
    return e


def got(e, q, ordered=False):
    out = [" ".join(r) for r in e.rows(q)]
    return out if ordered else sorted(out)


def agg(dims, metrics, **more):
    return {"type": "aggregate", "table": "events", "dimensions": dims, "metrics": metrics} | more


def flt(op, column, value):
    return {"op": op, "column": column, "value": value}


@pytest.fixture(scope="module")
def basic(spark):
    return engine(spark, INAPP, split(BASIC))


@pytest.fixture(scope="module")
def sort(spark):
    return engine(spark, INAPP, split(SORT[:3]), split(SORT[3:]))


@pytest.fixture(scope="module")
def times(spark):
    return engine(spark, TIME, split(TIME_ROWS))


@pytest.fixture(scope="module")
def users(spark):
    return engine(spark, USERS, split(USER_ROWS))


def test_aggregate(basic):
    assert got(basic, agg(["event_name", "country"], ["revenue"], filter=flt("eq", "country", "US"))) == ["donate US 5", "purchase US 1.2"]
    assert got(basic, agg(["country"], ["revenue"], header=True), True) == ["country revenue", "US 6.2"]
    assert got(basic, agg(["event_name", "country"], ["revenue"], having=flt("gt", "revenue", "2"))) == ["donate US 5"]
    assert got(basic, agg([], ["revenue"])) == ["6.2"]
    assert got(basic, agg([], ["revenue"], filter=flt("eq", "country", "RU"))) == []
    assert got(basic, agg(["event_name"], ["revenue"], filter=flt("gt", "revenue", "4"))) == ["donate 5"]
    assert got(basic, agg(["event_name"], [])) == ["donate", "purchase"]
    assert got(basic, agg(["event_name"], [], filter=flt("ne", "country", "RU"))) == ["donate", "purchase"]
    select = {"type": "aggregate", "table": "events", "select": [{"column": "revenue"}, {"column": "country"}]}
    assert got(basic, select) == ["6.2 US"]


def test_errors(basic):
    for q, text in (
        (agg(["country"], ["revenue"], having=flt("gt", "count", "1")), "not selected"),
        (agg(["country"], ["revenue"], sort=[{"column": "count"}]), "Sort column"),
        (agg(["country"], ["revenue"], filter=flt("like", "country", "1")), "filter operator"),
        (agg(["nowhere"], []), "No such column"),
        (agg(["country", "country"], []), "twice"),
        ({"type": "join"}, "unsupported query type"),
        (agg(["country"], []) | {"table": "none"}, "No such table"),
        (agg(["country"], [], filter=flt("eq", "country", 5)), "must be a string"),
    ):
        with pytest.raises(ValueError, match=text):
            basic.query(q)
    with pytest.raises(ValueError, match="already exists"):
        basic.create_table(INAPP)
    with pytest.raises(ValueError, match="not accessible"):
        basic.load({"table": "events", "file": "/nowhere/x.tsv"})
    with pytest.raises(ValueError, match="unknown input format"):
        basic.load({"table": "events", "file": "/x", "format": "csv"})


def test_negation(sort):
    inner = {"op": "and", "filters": [flt("gt", "revenue", "0.1"), flt("lt", "revenue", "2")]}
    assert got(sort, agg(["event_name", "country"], ["revenue"], filter={"op": "not", "filter": inner})) == ["purchase US 0.1", "review KZ 5"]
    twice = {"op": "not", "filter": {"op": "not", "filter": flt("eq", "country", "US")}}
    assert got(sort, agg(["country"], ["count"], filter=twice)) == ["US 1"]
    not_in = {"op": "not", "filter": {"op": "in", "column": "install_time", "values": ["20141111", "20141112"]}}
    assert got(sort, agg(["country"], ["count"], filter=not_in)) == ["KZ 1", "US 1"]


def test_sort_and_pages(sort):
    q = "SELECT country, revenue FROM events ORDER BY revenue DESC, country"
    expected = ["KZ 5", "AZ 1.1", "CH 1.1", "IL 1.01", "RU 1", "US 0.1"]
    assert got(sort, q, True) == expected
    assert got(sort, q + " LIMIT 2, 3", True) == expected[2:5]
    assert got(sort, q + " LIMIT 3 OFFSET 2", True) == expected[2:5]
    assert got(sort, agg(["country"], ["revenue"], sort=[{"column": "revenue"}], limit=1), True) == ["KZ 5"]
    assert len(got(sort, agg(["country"], ["revenue"], limit=2))) == 2
    assert got(sort, "SELECT country, revenue FROM events HAVING revenue > 1 ORDER BY country LIMIT 2", True) == ["AZ 1.1", "CH 1.1"]


def test_sql(basic, sort, times):
    assert got(basic, "SELECT RAW(*) FROM events", True) == ["US purchase 20141112 1 0.1", "US purchase 20141113 1 1.1", "US donate 20141112 1 5"]
    assert got(basic, "select raw(country, revenue) from events where revenue > 1 limit 1 offset 1", True) == ["US 5"]
    assert got(sort, "SELECT SEARCH(event_name, 'r') FROM events WHERE revenue > 1.0 LIMIT 10") == ["refund", "review"]
    assert got(sort, "SELECT install_time, event_name, count FROM events WHERE install_time BETWEEN 20141111 AND 20141112") == ["20141111 refund 3", "20141112 donate 1"]
    assert got(times, "SELECT install_time, event_name, count FROM events WHERE install_time BETWEEN '2015-01-03' AND '2015-01-04'") == ["1420257600 closeapp 1", "1420287194 purchase 1"]
    assert got(sort, "SELECT country FROM events WHERE NOT (country = 'US' OR country IN ('RU', 'KZ')) -- three\n;") == ["AZ", "CH", "IL"]
    assert got(basic, "SHOW TABLES") == ["events"]
    assert len(got(basic, "SHOW WORKERS")) >= 1
    for bad in ("SELECT", "SELECT a FROM", "SELECT a b FROM c", "DROP TABLE x", "SELECT a FROM b WHERE c LIKE 'd'"):
        with pytest.raises(ValueError, match="syntax error"):
            basic.sql(bad)
    with pytest.raises(ValueError, match="Multiple SQL"):
        basic.sql("SELECT country FROM events; SELECT country FROM events")


def test_hyphens(spark):
    cfg = {"name": "user-events", "dimensions": [{"name": "app-id"}, {"name": "event-name"}], "metrics": [COUNT]}
    e = engine(spark, cfg, [["a", "x"], ["a", "x"], ["b", "y"]])
    assert got(e, 'SELECT "app-id", `event-name`, count FROM "user-events" WHERE "app-id" = \'a\'') == ["a x 2"]


def test_bitset(users):
    q = agg(["country"], ["user_id"], filter=flt("gt", "time", "1495475514"))
    assert got(users, q) == ["IL 1", "KZ 2", "RU 1", "US 3"]
    assert got(users, agg([], ["user_id"])) == ["8"]
    assert got(users, agg(["country"], ["user_id"], filter=flt("ge", "user_id", "1"))) == ["IL 1", "KZ 2", "RU 1", "US 4"]
    assert got(users, agg(["country"], ["user_id"], filter=flt("ge", "user_id", "2"))) == []


def test_metric_types(spark):
    for num in ("byte", "short", "int", "long"):
        names = [f"{t}_{a}" for t in (num, "u" + num) for a in ("sum", "min", "max", "avg")]
        cfg = {"name": "events", "dimensions": [{"name": "country"}], "metrics": [COUNT, *({"name": n, "type": n} for n in names)]}
        e = engine(spark, cfg, [["US", *[str(v)] * 8] for v in (1, 2, 3)], [["IL", *[str(v)] * 8] for v in (1, 2)])
        assert got(e, agg(["country"], ["count", *names])) == ["IL 2 3 1 2 1.5 3 1 2 1.5", "US 3 6 1 3 2 6 1 3 2"]


def test_average_without_count(spark):
    cfg = {"name": "events", "dimensions": [{"name": "country"}], "metrics": [{"name": "avg_revenue", "type": "double_avg"}]}
    e = engine(spark, cfg, split(["US 16", "US 6"]), split(["US 2.6", "IL 20.7", "IL 11"]))
    assert got(e, agg(["country"], ["avg_revenue"])) == ["IL 15.85", "US 8.2"]
    assert got(e, agg([], ["avg_revenue"])) == ["11.26"]
    assert got(e, agg(["country"], ["avg_revenue"], having=flt("gt", "avg_revenue", "10"))) == ["IL 15.85"]


def test_strict_width(spark):
    cfg = {"name": "events", "dimensions": [{"name": "k"}], "metrics": [{"name": "s", "type": "byte_sum"}], "strict_width": True}
    assert got(engine(spark, cfg, [["a", "100"], ["a", "100"]]), agg(["k"], ["s"])) == ["a -56"]


def test_numeric_and_boolean_dimensions(spark):
    kinds = ("byte", "ubyte", "short", "ushort", "int", "uint", "long", "ulong", "float", "double")
    cfg = {"name": "events", "dimensions": [{"name": k, "type": k} for k in kinds], "metrics": [COUNT]}
    rows = ["-1 2 -257 145 -10245 23456 -281734 182745 21.124 1.092743", "-1 7 257 14 -10245 1982 0 1111111111 21.124 1.092743", "-6 2 -257 98 -98 777 198 0 0.78 7.912435", "9 29 -128 145 0 23456 -281734 182745 1.11 139834.12313"]
    e = engine(spark, cfg, split(rows))
    assert got(e, agg(["byte", "float", "double"], ["count"])) == sorted(["-1 21.124 1.092743 2", "-6 0.78 7.912435 1", "9 1.11 139834.12313 1"])
    assert got(e, agg(["byte"], ["count"], filter=flt("lt", "byte", "-1"))) == ["-6 1"]
    cfg = {"name": "events", "dimensions": [{"name": "event_name"}, {"name": "is_organic", "type": "boolean"}], "metrics": [COUNT]}
    e = engine(spark, cfg, split(["purchase true", "purchase false", "open true", "open false", "open true"]))
    assert got(e, agg(["event_name", "is_organic"], ["count"], filter=flt("eq", "is_organic", "true"))) == ["open true 2", "purchase true 1"]


def test_limits(spark):
    cfg = {"name": "events", "dimensions": [{"name": "m", "cardinality": 5}], "metrics": [COUNT]}
    e = engine(spark, cfg, split(["GET", "POST", "HEAD", "PUT", "DELETE", "BLAH", "BLAH"]))
    assert got(e, agg(["m"], ["count"], filter=flt("gt", "count", "1"))) == ["__exceeded 2"]
    e.load_rows("events", split(["GET", "NEW"]))
    assert got(e, agg(["m"], ["count"], filter=flt("gt", "count", "1"))) == ["GET 2", "__exceeded 3"]
    guard = {"dimensions": ["device_id"], "limit": 3}
    cfg = {"name": "events", "dimensions": [{"name": "device_id"}, {"name": "event_name", "cardinality_guard": guard}], "metrics": [COUNT]}
    rows = split(["13873844 purchase", "13873844 open-app", "13873844 close-app", "13873844 donate", "13873844 click-add", "13873755 purchase", "13873844 purchase"])
    expected = sorted(["13873844 purchase 2", "13873844 open-app 1", "13873844 close-app 1", "13873844 __exceeded 2", "13873755 purchase 1"])
    assert got(engine(spark, cfg, rows), agg(["device_id", "event_name"], ["count"])) == expected
    # Loading in batches is the same as loading at once.
    assert got(engine(spark, cfg, rows[:2], rows[2:5], rows[5:]), agg(["device_id", "event_name"], ["count"])) == expected
    e = engine(spark, INAPP, [["US", "a" * 30, "1", "1"], ["US", "ü" * 15, "1", "1"]])
    assert got(e, agg(["event_name"], [])) == sorted(["a" * 20, "ü" * 10])


def test_wide_caps(spark):
    """Caps as wide as 32 bits, which all values fit under, and one that is counted first and then exceeded."""
    cfg = {"name": "events", "dimensions": [{"name": "a", "cardinality": 254}, {"name": "b", "cardinality": 65534}, {"name": "c", "cardinality": 4294967294}, {"name": "d", "cardinality": 4294967296}], "metrics": [COUNT]}
    assert got(engine(spark, cfg, split(["a b c d"] * 3)), agg(["a", "b", "c", "d"], ["count"])) == ["a b c d 3"]
    cfg = {"name": "events", "dimensions": [{"name": "m", "cardinality": 20000}], "metrics": [COUNT]}
    e = engine(spark, cfg, [[str(k)] for k in range(20100)])
    assert got(e, agg([], ["count"], filter=flt("eq", "m", "__exceeded"))) == ["100"] and got(e, agg(["m"], [], filter=flt("eq", "m", "19999"))) == ["19999"]


def test_batches_merge(spark):
    whole = engine(spark, INAPP, split(SORT + BASIC))
    parts = engine(spark, INAPP, split(SORT[:2]), split(SORT[2:]), split(BASIC))
    for q in (agg(["country", "event_name", "install_time"], ["count", "revenue"]), "SELECT RAW(*) FROM events"):
        assert got(whole, q) == got(parts, q)
    before = got(parts, "SELECT RAW(*) FROM events", True)
    parts.compact("events")
    assert len(parts.table("events").deltas) == 1
    assert got(parts, "SELECT RAW(*) FROM events", True) == before


def test_partitions(spark):
    e = Engine(spark, {"tables": [TENANTS]})
    e.load_rows("events", split(TENANT_ROWS), partition_filter={"columns": ["app_id"], "total_partitions": 5, "values": [0]})
    assert got(e, agg(["app_id"], ["count"])) == ["com.horse 3"]
    e = Engine(spark, {"tables": [TENANTS]})
    e.load_rows("events", split(TENANT_ROWS), partition_filter={"columns": ["app_id", "country"], "total_partitions": 5, "values": [0]})
    assert got(e, agg(["app_id", "country"], ["count"])) == ["com.bird KZ 1"]
    cfg = TENANTS | {"partitioning": {"columns": ["app_id"], "total": 5}}
    e = engine(spark, cfg, split(TENANT_ROWS))
    q = agg(["app_id"], ["count"], filter=flt("eq", "app_id", "com.horse"))
    assert got(e, q) == ["com.horse 3"]
    assert "PartitionFilters: [__part" in e.query(q)._jdf.queryExecution().executedPlan().toString().replace("isnotnull(__part", "__part").replace("[(__part", "[__part")


def test_metadata(basic):
    m = basic.table_meta("events")
    assert m["records_num"] == 3 and m["segments"] == [{"install_time": {"min": 20141112, "max": 20141113}}]
    assert m["dimensions"][0] == {"name": "country", "cardinality": 2}
    assert basic.meta() == {"tables": [{"name": "events"}]}
    stats = basic.profile(agg(["country"], ["count"]))
    assert stats.output_recs == 1 and stats.scanned_segments == 1 and stats.scanned_recs == 3 and stats.lines()[1] == "query.aggregate.events.rows:1|c"


def test_empty_table(spark):
    e = engine(spark, INAPP)
    assert got(e, agg(["country"], ["count"])) == got(e, agg([], ["count"])) == got(e, "SELECT RAW(*) FROM events") == []
    e.drop_table("events")
    assert got(e, "SHOW TABLES") == []


def test_shell(spark, tmp_path):
    import io

    from rollstore.__main__ import open_engine, run

    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").coalesce(1).write.parquet(str(tmp_path / "t"))
    e = open_engine(spark, {"tables": [{"name": "t", "parquet": str(tmp_path / "t"), "dimensions": [{"name": "k"}], "metrics": [{"name": "n", "type": "int_sum"}]}]})
    out = io.StringIO()
    run(e, io.StringIO("SELECT k, n FROM t\nORDER BY k;\nSELECT nothing FROM t;\n"), out, header=True)
    assert out.getvalue().startswith("k\tn\na\t1\nb\t2\nError: No such column")


def test_without_training_operators(tmp_path):
    """The entry module works where the training-data operators are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "rollstore", tmp_path / "rollstore", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": ""})
