import gzip
import json

import pytest
from fixtures import BASIC, COUNT, INAPP

from rollstore import Engine
from rollstore.functions import render
from rollstore.streaming import watch

RAW = "SELECT RAW(country, event_name, revenue) FROM events"
TEXT = "\n".join(r.replace(" ", "\t") for r in BASIC)


def got(e, q):
    return [" ".join(r) for r in e.rows(q)]


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(TEXT)
    e = Engine(spark, {"tables": [INAPP]})
    assert e.load({"table": "events", "file": str(tmp_path / "a.tsv"), "batch_id": 7}) == 3
    assert got(e, RAW) == ["US purchase 0.1", "US purchase 1.1", "US donate 5"] and e.last_batch_id == 7
    (tmp_path / "b.tsv").write_text("x\t1.5\tUS\tsale\t20150101")
    e.sql(f"COPY events (index, revenue, country, event_name, install_time) FROM '{tmp_path / 'b.tsv'}' WITH FORMAT TSV")
    assert got(e, RAW)[-1] == "US sale 1.5"
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "c.tsv.gz", "wt") as f:
        f.write("FR\tsale\t20150101\t9\n")
    e.load({"table": "events", "file": str(tmp_path / "sub"), "recursive": True})
    assert got(e, RAW)[-1] == "FR sale 9"


def test_failed_loads_leave_nothing(spark, tmp_path):
    e = Engine(spark, {"tables": [INAPP]})
    for bad in ("US\tx\t1\t2.0\t3\n", "US\tx\tnone\t2.0\n", "US\tx\t\t2.0\n", "US\tx\t99999999999\t1\n"):
        (tmp_path / "bad.tsv").write_text("US\tx\t1\t2.0\n" + bad)
        with pytest.raises(Exception, match="too big|Can't parse"):
            e.load({"table": "events", "file": str(tmp_path / "bad.tsv")})
    assert got(e, RAW) == []
    with pytest.raises(ValueError, match="'revenue' is not specified"):
        e.load({"table": "events", "file": str(tmp_path / "bad.tsv"), "columns": ["country", "event_name", "install_time"]})


def test_field_aliases(spark):
    cfg = {"name": "events", "dimensions": [{"name": "country"}, {"name": "install_time", "type": "time"}], "metrics": [COUNT, {"name": "revenue_sum", "type": "double_sum", "field": "revenue"}, {"name": "revenue_max", "type": "double_max", "field": "revenue"}]}
    e = Engine(spark, {"tables": [cfg]})
    e.load_rows("events", [["1", "US", "1420107084"], ["2.5", "US", "1420107084"], ["-3", "IL", "1420107084"]], columns=["revenue", "country", "install_time"])
    assert sorted(got(e, "SELECT country, count, revenue_sum, revenue_max FROM events")) == ["IL 1 -3 -3", "US 2 3.5 2.5"]
    with pytest.raises(ValueError, match="aliases"):
        e.load_rows("events", [["1", "US"]])


def test_watched_folder(spark, tmp_path):
    e = Engine(spark, {"tables": [INAPP]})
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.tsv").write_text(TEXT)
        (folder / f"{k}.txt").write_text("no record")
        q = watch.watch(e, "events", str(folder), str(tmp_path / "checkpoint"), trigger={"availableNow": True})
        q.awaitTermination()
        assert got(e, "SELECT count FROM events") == [str(3 * (k + 1))]


def test_announcements(spark, tmp_path):
    e = Engine(spark, {"tables": [INAPP]})
    (tmp_path / "h" / "part=0").mkdir(parents=True)
    (tmp_path / "h" / "part=1").mkdir()
    (tmp_path / "h" / "part=0" / "a.tsv").write_text(TEXT)
    (tmp_path / "h" / "part=1" / "a.tsv").write_text(TEXT)
    (tmp_path / "m.tsv").write_text(TEXT)
    watch.bootstrap(e, {"id": 5, "tables": {"events": {"paths": [str(tmp_path / "h")]}}}, partitions=[1])
    assert got(e, "SELECT count FROM events") == ["3"] and e.last_batch_id == 5
    news = tmp_path / "news"
    news.mkdir()
    message = lambda n: json.dumps({"id": n, "tables": {"events": {"paths": [str(tmp_path / "m.tsv")], "columns": ["country", "event_name", "install_time", "revenue"]}}})
    (news / "1").write_text(message(6) + "\n" + message(4) + "\n")
    watch.announcements(e, spark.readStream.text(str(news)), str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination()
    assert got(e, "SELECT count FROM events") == ["6"] and e.last_batch_id == 6


def test_text_forms(spark):
    assert [render.text(v) for v in (1, 1.0, 0.1, 1e21, True, None, 1 / 3)] == ["1", "1", "0.1", "1e+21", "true", "", "0.333333333333333"]
    df = spark.createDataFrame([("a", 1.5, 2), ("b", 2.0, 3)], "k string, x double, n int")
    assert [r[0] for r in render.lines(df).collect()] == ["a\t1.5\t2", "b\t2\t3"] == [s.strip() for s in render.tsv(df)]


def test_reopened_tables(spark, tmp_path):
    """An engine that is lost leaves its tables: deltas, admitted values, batch numbers."""
    cfg = {"name": "a b", "dimensions": [{"name": "k", "cardinality": 2}, {"name": "n", "type": "int"}], "metrics": [COUNT], "partitioning": {"columns": ["n"], "total": 4}}
    e = Engine(spark, {"tables": [cfg, INAPP]}, path=str(tmp_path))
    e.load_rows("a b", [["x", "1"], ["y", "2"], ["z", "3"]])
    e.mark(["a b"], {"micro": 9})
    e = Engine(spark, path=str(tmp_path))
    assert sorted(e.tables) == ["a b", "events"] and e.last_batch_id == 9 and e.last_historic_id == 0
    e.load_rows("a b", [["x", "1"], ["w", "2"]])
    q = {"type": "select", "table": "a b", "dimensions": ["k", "n"], "metrics": ["count"]}
    expected = ["__exceeded 2 1", "__exceeded 3 1", "x 1 2", "y 2 1"]
    assert sorted(got(e, q)) == expected
    e.compact("a b")
    e = Engine(spark, {"tables": [cfg, INAPP]}, path=str(tmp_path))
    assert sorted(got(e, q)) == expected and e.table("a b").is_merged
    assert got(e, q | {"filter": {"op": "eq", "column": "n", "value": "03"}}) == ["__exceeded 3 1"]
    with pytest.raises(ValueError, match="another definition"):
        Engine(spark, {"tables": [cfg | {"metrics": []}]}, path=str(tmp_path))
    e.drop_table("a b")
    assert sorted(Engine(spark, path=str(tmp_path)).tables) == ["events"]


def test_watched_folder_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.tsv").write_text(TEXT)
        e = Engine(spark, {"tables": [INAPP]}, path=str(tmp_path / "tables"))
        watch.watch(e, "events", str(folder), str(tmp_path / "checkpoint"), trigger={"availableNow": True}).awaitTermination()
        assert got(e, "SELECT count FROM events") == [str(3 * (k + 1))]
    # A batch that ran but was not committed to the checkpoint runs again, and is not loaded twice.
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink()
    e = Engine(spark, path=str(tmp_path / "tables"))
    watch.watch(e, "events", str(folder), str(tmp_path / "checkpoint"), trigger={"availableNow": True}).awaitTermination()
    assert got(e, "SELECT count FROM events") == ["9"]
    (folder / "bad.tsv").write_text("US\tx\t1\t2.0\t3\t4\n")
    with pytest.raises(Exception, match="too big"):
        watch.watch(e, "events", str(folder), str(tmp_path / "checkpoint"), trigger={"availableNow": True}).awaitTermination()
    assert got(e, "SELECT count FROM events") == ["9"]


def test_watch_option(spark, tmp_path):
    e = Engine(spark, {"tables": [INAPP | {"watch": {"directory": str(tmp_path / "in"), "extensions": [".tsv", ".txt"]}}]}, path=str(tmp_path / "tables"))
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    e.table("events").stream.processAllAvailable()
    e.stop()
    assert got(e, "SELECT count FROM events") == ["3"]


def test_one_scan_and_no_needless_merge(spark):
    e = Engine(spark, {"tables": [INAPP]})
    for k in range(5):
        e.load_rows("events", [["US", "sale", "1", str(k)]])
    plan = lambda q: e.sql(q)._jdf.queryExecution().executedPlan().toString()
    q = "SELECT country, count FROM events WHERE count > 1"
    assert plan(q).count("FileScan") == 1
    before = plan(q).count("Exchange")
    e.compact("events")
    assert plan(q).count("Exchange") == before - 1 and got(e, q) == ["US 5"]


def test_compaction_by_itself(spark, monkeypatch):
    from rollstore import engine

    monkeypatch.setattr(engine, "COMPACT_AT", 3)
    e = Engine(spark, {"tables": [INAPP]})
    for k in range(7):
        e.load_rows("events", [["US", "sale", "1", str(k)]])
    assert len(e.table("events").deltas) < 3 and got(e, "SELECT count, revenue FROM events") == ["7 21"]
    assert e.loads[-1].stored_recs == 1 and e.loads[-1].lines()[1] == "load.events.rows:1|c"


def test_wrapping_sums(spark):
    cfg = {"name": "t", "dimensions": [{"name": "k"}], "metrics": [{"name": "s", "type": "long_sum"}]}
    e = Engine(spark, {"tables": [cfg]})
    most = str(2**63 - 1)
    e.load_rows("t", [["a", most], ["a", most], ["b", "-5"], ["b", "3"], ["c", str(-(2**63))]])
    e.load_rows("t", [["a", "1"], ["c", "-1"], ["b", "-9000000000000000000"]])
    assert sorted(got(e, "SELECT k, s FROM t")) == ["a -1", "b -9000000000000000002", f"c {most}"]


def test_statistics_are_sent(spark):
    import socket

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        e = Engine(spark, {"tables": [INAPP]}, statsd={"port": s.getsockname()[1], "prefix": "here."})
        e.load_rows("events", [["US", "sale", "1", "2"]])
        assert s.recv(1000).decode().splitlines()[1] == "here.load.events.rows:1|c"
        e.profile({"type": "search", "table": "events", "dimension": "country", "term": "U"})
        lines = s.recv(1000).decode().splitlines()
        assert "here.query.search.events.rows:1|c" in lines and "here.query.search.events.segments:1|c" in lines
