import brute
import corpus_pipeline

from rollstore.llm import bytebpe, quality
from rollstore.llm.common import Scratch


def test_stages(docs, texts, spark, tmp_path):
    """Each stage against its brute-force version, on its own input."""
    spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in texts], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = docs.where("doc_id = 3")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    scratch, sf = Scratch(spark, "test"), str(tmp_path)
    whole = docs.unionByName(extra)
    out = scratch.save(stages["quality"](spark, whole, sf), "a")
    model = quality.train(whole, spark.read.parquet(sf + "/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in quality.classify(whole, model).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted([i for i, _ in texts if scores[i]] + [3] * scores[3])
    assert out.columns == docs.columns

    once = scratch.save(stages["exact_dedup"](spark, whole, sf), "b")
    assert sorted(r.doc_id for r in once.collect()) == [r[0] for r in brute.exact(texts) if r[3]]
    assert once.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in once.collect()]
    near = scratch.save(stages["near_dedup"](spark, once, sf), "c")
    assert sorted(r.doc_id for r in near.collect()) == [r[0] for r in brute.near(kept) if r[3]]

    mix = scratch.save(stages["mixing"](spark, near, sf), "d")
    assert mix.columns == docs.columns
    from rollstore.llm import mixing

    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert sorted(r.doc_id for r in mix.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    tokens = stages["bpe"](spark, mix, sf)
    coder = bytebpe.coder(bytebpe.vocabulary("byte_bpe_50k.json"))
    text = dict(texts)
    assert all(bytes(r.ids) == coder.encode(text[r.doc_id] or "") for r in tokens.collect()) and tokens.count() == mix.count()


def test_empty(empty, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_and_nulls(docs, spark, tmp_path):
    """Whatever other columns are called, they come through as they were; null ids, null texts and repeated rows have their place."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["__file", "__row", "__value", "__key", "__copy", "_carry0", "file", "row", "word", "copies", "size", "_t", "_h", "_w", "_c", "_n", "_i", "_s", "_b", "_null", "value", "part"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    wide = wide.unionByName(wide.where("doc_id % 10 = 0").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(wide.where("doc_id = 3"))
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        again = out.where(" and ".join(f"`{n}` = concat('{n}', _id)" for n in names))
        assert 0 < out.count() == again.count(), name
    once = corpus_pipeline.no_copies(spark, wide, str(tmp_path))
    texts = wide.select(F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    assert once.count() == texts == once.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert once.where("doc_id is null").count() == 0
    near = corpus_pipeline.no_near_copies(spark, wide, str(tmp_path))
    assert near.where("doc_id is null").count() == wide.where("doc_id is null").count()
