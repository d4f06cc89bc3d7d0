import pytest

from rollstore.llm import rows
from rollstore.llm.common import Scratch
from pyspark.sql import functions as F


@pytest.fixture()
def table(spark, tmp_path):
    """Several files of several row groups; columns named like those that the class adds."""
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id) AS text", "id AS __file", "'x' AS __VALUE", "id AS file", "id AS row", "struct(id) AS _metadata")
    df.repartition(3).write.option("parquet.block.size", "8192").parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("most", [rows.MASK_BYTES, 700])
def test_decisions_reach_their_rows(table, spark, monkeypatch, most):
    """At once, and in groups of files whose masks are small enough."""
    monkeypatch.setattr(rows, "MASK_BYTES", most)
    at = rows.Rows(table, Scratch(spark, "rows"))
    value = F.expr("case when doc_id % 7 = 0 then 2 when doc_id % 5 = 0 then 1 when doc_id % 11 = 0 then 3 else 0 end")
    chosen = at.df.select(*at.place(), value.alias("value"))
    out = at.decided(chosen, lambda df, v: df.select(*table.columns, F.col(v).alias("v")), values=3)
    assert out.columns == [*table.columns, "v"]
    assert sorted(r.doc_id for r in out.collect()) == list(range(5000))
    assert out.where(F.col("v") != value).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_other_sources_are_written_first(spark, table):
    scratch = Scratch(spark, "rows")
    for df in (spark.range(10), table.select("doc_id").union(table.select("doc_id")), table.select(F.explode(F.array("doc_id", F.lit(1)))), table.limit(5), table.where(F.rand() < 2)):
        assert not rows.Rows(df, scratch).df.inputFiles()[0].startswith(table.inputFiles()[0].rsplit("/", 1)[0])
        scratch.drop("rows")
    some = rows.Rows(table.where("doc_id % 2 = 0").select("doc_id"), scratch)
    assert "rows" not in scratch.names and some.df.count() == 2500
    assert some.df.select(*some.place()).distinct().count() == 2500


def test_work_tables_are_removed(spark, table):
    """Operators leave their narrow result; inside ``removed_after`` they leave nothing."""
    import os

    from rollstore.llm import common, mixing, near_dedup

    root = common.work_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with common.removed_after():
        assert near_dedup.near_dedup(table.select("doc_id", "text")).count() == 5000
        assert mixing.mix(table.selectExpr("doc_id", "text", "'s' AS source")).count() == 5000
    assert set(os.listdir(root)) == before
    near_dedup.near_dedup(table.select("doc_id", "text"))
    (left,) = set(os.listdir(root)) - before
    assert [n for n in os.listdir(f"{root}/{left}") if not n.startswith(".")] == ["result"]
