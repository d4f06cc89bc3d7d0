import calendar
import random
import time

import pytest
from fixtures import COUNT, TIME, TIME_ROWS, split

from rollstore import Engine, timeops

NOW = 1496570140


def load(spark, dim, rows, now=NOW):
    e = Engine(spark, {"tables": [{"name": "events", "dimensions": [{"name": "t"} | dim], "metrics": [COUNT]}]}, clock=lambda: now)
    e.load_rows("events", [[r] for r in rows])
    return e


def result(e, **item):
    q = {"type": "aggregate", "table": "events", "select": [{"column": "t"} | item, {"column": "count"}]}
    return sorted(" ".join(r) for r in e.rows(q))


@pytest.mark.parametrize(
    ("dim", "text", "stored"),
    [
        ({"type": "time"}, "1420107084", 1420107084), ({"type": "time", "format": "posix"}, "1420107084", 1420107084), ({"type": "time", "format": "millis"}, "1420107084123", 1420107084), ({"type": "time", "format": "micros"}, "1420107084123456", 1420107084),
        ({"type": "microtime"}, "1420107084123456", 1420107084123456), ({"type": "microtime", "format": "posix"}, "1420107084", 1420107084000000), ({"type": "microtime", "format": "millis"}, "1420107084123", 1420107084123000), ({"type": "microtime", "format": "micros"}, "1420107084123456", 1420107084123456),
        ({"type": "time", "format": "%Y-%m-%d %T"}, "2015-01-01 10:11:24", 1420107084), ({"type": "microtime", "format": "%Y-%m-%d %T"}, "2015-01-01 10:11:24", 1420107084000000), ({"type": "time", "format": "%d/%b/%y"}, "01/Jan/15", 1420070400),
    ],
)
def test_input_formats(spark, dim, text, stored):
    e = load(spark, dim, [text])
    assert e.query({"type": "aggregate", "table": "events", "dimensions": ["t"], "metrics": []}).first()[0] == stored


RULES = [{"granularity": "hour", "after": "1 days"}, {"granularity": "day", "after": "1 weeks"}, {"granularity": "month", "after": "1 years"}]
ROLLED = ["1496566539 1", "1496555739 1", "1496555700 1", "1496404800 2", "1496314800 1", "1495929600 2", "1495843200 1", "1420070400 2", "1459468800 1"]


def test_rollup(spark):
    rows = ["1496566539", "1496555739", "1496555700", "1496408066", "1496405460", "1496315533", "1495948331", "1495941131", "1495854731", "1461801600", "1422403212", "1421153666"]
    assert result(load(spark, {"type": "time", "rollup_rules": RULES}, rows), format="") == sorted(ROLLED)
    micro = ["1496408066102001", "1496405460111113", "1495948331000000", "1495941131010826", "1461801600000100"]
    assert result(load(spark, {"type": "microtime", "rollup_rules": RULES}, micro), format="") == sorted(["1496404800000000 2", "1495929600000000 2", "1459468800000000 1"])


def test_rollup_of_texts(spark):
    rules = [{"granularity": "minute", "after": "1 hours"}, {"granularity": "hour", "after": "1 days"}, {"granularity": "day", "after": "1 months"}, {"granularity": "month", "after": "1 years"}]
    rows = ["2017-06-04 09:55:50", "2017-06-04 08:55:39", "2017-06-04 08:55:30", "2017-06-02 18:13:22", "2017-06-02 18:24:10", "2017-05-03 12:14:05", "2017-05-03 15:25:32", "2016-02-03 18:21:09", "2016-02-04 04:44:45", "2012-06-03 12:31:57"]
    e = load(spark, {"type": "time", "format": "%Y-%m-%d %T", "rollup_rules": rules}, rows)
    expected = ["2017-06-04 09:55:50 1", "2017-06-04 08:55:00 2", "2017-06-02 18:00:00 2", "2017-05-03 00:00:00 2", "2016-02-01 00:00:00 2", "2012-06-01 00:00:00 1"]
    assert result(e) == sorted(expected)


def test_rollup_at_query(spark):
    clock = [1496566600]
    e = Engine(spark, {"tables": [{"name": "events", "dimensions": [{"name": "t", "type": "time", "rollup_rules": RULES}], "metrics": [COUNT]}]}, clock=lambda: clock[0])
    e.load_rows("events", [["1496566539"], ["1496566540"]])
    assert len(result(e)) == 2
    clock[0] += 2 * 86400
    assert result(e, format="") == ["1496563200 2"]


def test_granularity_and_format(spark):
    e = Engine(spark, {"tables": [TIME]})
    e.load_rows("events", split(TIME_ROWS))
    q = {"type": "aggregate", "table": "events", "select": [{"column": "country"}, {"column": "install_time", "format": "%Y-%m-%d %T", "granularity": "month"}, {"column": "count"}]}
    assert sorted(" ".join(r) for r in e.rows(q)) == [f"{c} 2015-01-01 00:00:00 {n}" for c, n in (("IL", 1), ("KZ", 2), ("RU", 1), ("US", 4))]
    for unit, to in (("year", "2005-01-01 00:00:00"), ("month", "2005-05-01 00:00:00"), ("day", "2005-05-05 00:00:00"), ("hour", "2005-05-05 05:00:00"), ("minute", "2005-05-05 05:06:00"), ("second", "2005-05-05 05:06:05")):
        e = load(spark, {"type": "time", "format": "%Y-%m-%d %T", "granularity": unit}, ["2005-05-05 05:06:05"] * 2)
        assert result(e) == [f"{to} 2"]
    with pytest.raises(ValueError, match="granularity"):
        load(spark, {"type": "time", "granularity": "week"}, [])


def test_durations():
    at = lambda *t: calendar.timegm(t)
    assert timeops.Duration.parse("1 months").before(at(2017, 3, 31, 1, 2, 3)) == at(2017, 3, 3, 1, 2, 3)
    assert timeops.Duration.parse("1 years").before(at(2016, 2, 29, 0, 0, 0)) == at(2015, 3, 1, 0, 0, 0)
    assert timeops.Duration.parse("2 weeks").before(at(2017, 3, 15, 0, 0, 0)) == at(2017, 3, 1, 0, 0, 0)
    for bad in ("0 days", "days", "1 fortnights", "x days"):
        with pytest.raises(ValueError):
            timeops.Duration.parse(bad)


def test_columns_against_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    seconds = [0, 951782400, 951868799, *(rng.randrange(4_000_000_000) for _ in range(200))]
    df = spark.createDataFrame([(s,) for s in seconds], "s long")
    form = "%a %b %d %Y %y %j %H:%M:%S %T"
    out = df.select("s", timeops.formatted(F.col("s"), form, False).alias("t"), *(timeops.truncated(F.col("s"), u, False).alias(u) for u in timeops.UNITS if u != "week")).collect()
    for r in out:
        g = time.gmtime(r.s)
        assert r.t == time.strftime(form, g)
        for n, u in enumerate(("year", "month", "day", "hour", "minute", "second"), 1):
            assert r[u] == calendar.timegm((*g[:n], *(0, 1, 1, 0, 0, 0)[n:]))


def test_literals():
    assert timeops.literal("2015-01-03", False) == 1420243200
    assert timeops.literal("2015-01-03 00:00:01", True) == 1420243201000000
    assert timeops.literal("2015-01-03 00:00:01.25", True) == 1420243201250000
    assert timeops.literal("17", False) == 17
    for bad in ("yesterday", "0", ""):
        with pytest.raises(ValueError, match="time format"):
            timeops.literal(bad, False)
