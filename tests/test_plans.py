import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollstore.plans import filters, partitions, sql


def test_parser():
    q = sql.parse('SELECT a, "b-c" FROM t WHERE NOT a=1 AND b BETWEEN 2 AND 3 OR c IN (\'x\', 4) HAVING a >= .5 ORDER BY a DESC, b LIMIT 5, 6; -- end')[0]
    assert q == {
        "type": "aggregate", "select": [{"column": "a"}, {"column": "b-c"}], "table": "t",
        "filter": {"op": "or", "filters": [
            {"op": "and", "filters": [{"op": "not", "filter": {"op": "eq", "column": "a", "value": "1"}}, {"op": "and", "filters": [{"op": "ge", "column": "b", "value": "2"}, {"op": "le", "column": "b", "value": "3"}]}]},
            {"op": "in", "column": "c", "values": ["x", "4"]},
        ]},
        "having": {"op": "ge", "column": "a", "value": ".5"}, "sort": [{"column": "a", "ascending": False}, {"column": "b", "ascending": True}], "skip": 5, "limit": 6,
    }
    assert sql.parse("copy t (a, b) from 'f.tsv' with format tsv; copy u from 'g'") == [
        {"load": {"type": "file", "table": "t", "format": "tsv", "columns": ["a", "b"], "file": "f.tsv"}}, {"load": {"type": "file", "table": "u", "format": "tsv", "file": "g"}},
    ]
    assert sql.parse("show workers") == [{"type": "show", "what": "workers"}]
    with pytest.raises(sql.SqlError, match=r"syntax error.*at 1\.8"):
        sql.parse("SELECT ; FROM t")


def part(*values):
    return zlib.crc32("".join(values).encode()) % 7


def eq(c, v):
    return {"op": "eq", "column": c, "value": v}


def test_targets():
    one, two = ["user"], ["user", "date"]
    both = {"op": "and", "filters": [eq("user", "a"), {"op": "ne", "column": "country", "value": ""}]}
    assert partitions.target_partitions(eq("user", "1"), one, 7) == partitions.target_partitions({"op": "and", "filters": [eq("user", "1")]}, one, 7) == [part("1")]
    assert partitions.target_partitions(both, one, 7) == [part("a")]
    pairs = {"op": "or", "filters": [{"op": "and", "filters": [eq("user", u), eq("date", d)]} for u, d in (("a", "1"), ("b", "2"))]}
    assert partitions.target_partitions(pairs, two, 7) == sorted({part("a", "1"), part("b", "2")})
    crossed = {"op": "and", "filters": [{"op": "in", "column": "user", "values": ["a", "b"]}, {"op": "in", "column": "date", "values": ["1", "2"]}]}
    assert partitions.target_partitions(crossed, two, 7) == sorted({part(u, d) for u in "ab" for d in "12"})
    # A branch without the key reaches every partition.
    assert partitions.target_partitions({"op": "or", "filters": [eq("user", "a"), eq("country", "x")]}, one, 7) is None
    with pytest.raises(ValueError, match="Key columns are missing from filter: date"):
        partitions.target_partitions(eq("user", "a"), two, 7, strict=True)


def test_placement():
    def workers(*spec):
        return [{"hostname": h, "rack_id": r, "http_port": p} for h, r in spec for p in (5000, 5001)]

    two_racks = workers(("host1", "1"), ("host2", "2"), ("host3", "1"), ("host4", "2"))
    assert partitions.placement(2, 2, two_racks) == [[("host1", 5000), ("host2", 5000)], [("host3", 5000), ("host4", 5000)]]
    flat = partitions.placement(4, 1, workers(("host1", ""), ("host2", "")))
    assert [p[0] for p in flat] == [("host1", 5000), ("host2", 5000), ("host1", 5001), ("host2", 5001)]
    with pytest.raises(ValueError, match="Can't place 3 copies of 3 partitions on 0 workers"):
        partitions.placement(3, 3, [])
    with pytest.raises(ValueError, match="Replication factor of 3 is smaller than the number of racks: 1"):
        partitions.placement(1, 3, workers(("host1", "1"), ("host2", "1")))


_leaf = st.builds(lambda c, v, op: {"op": op, "column": c, "value": v}, st.sampled_from("ab"), st.sampled_from("123"), st.sampled_from(["eq", "ne"]))
_tree = st.recursive(_leaf, lambda x: st.builds(lambda op, fs: {"op": op, "filters": fs}, st.sampled_from(["and", "or"]), st.lists(x, min_size=1, max_size=3)) | st.builds(lambda f: {"op": "not", "filter": f}, x), max_leaves=6)


def holds(f, row):
    match f["op"]:
        case "and":
            return all(holds(x, row) for x in f["filters"])
        case "or":
            return any(holds(x, row) for x in f["filters"])
        case "not":
            return not holds(f["filter"], row)
    return (row[f["column"]] == f["value"]) == (f["op"] == "eq")


@settings(max_examples=300, deadline=None)
@given(_tree)
def test_targets_cover_every_passing_row(f):
    found = partitions.target_partitions(f, ["a", "b"], 5)
    assert filters.columns(f) <= {"a", "b"}
    for a in "1234":
        for b in "1234":
            if found is not None and holds(f, {"a": a, "b": b}):
                assert partitions.partition_of([a, b], 5) in found
