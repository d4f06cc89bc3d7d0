"""A corpus from raw documents: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and
returns a DataFrame, which is written as Parquet and read again.  All but the last return
the columns of ``documents``, whatever their names.  No stage shuffles texts: what is
decided about a row is brought to the file that it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollstore.llm import bytebpe, common, exact_dedup, mixing, near_dedup, quality
from rollstore.llm.rows import Rows, fresh


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled documents among ``docs``.

    A null text is scored as an empty one.  Rows repeated with one id are decided by their
    own texts.  Without labels every score is 0.5, which is accepted.  An empty table gives
    no rows.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id.

    Null and empty texts are equal.  A null id ranks below all others.  Of rows repeated
    whole, and of equal texts under one id, the last in the files stays.  An empty table
    gives no rows.
    """
    rows = Rows(docs, common.Scratch(spark, "no-copies"))
    key = fresh(rows.df.columns, "__key")
    # Places make ids unique, and are compared last.
    keyed = rows.df.withColumn(key, F.struct(F.col("doc_id").alias("id"), *rows.place()))
    gone = exact_dedup.exact_dedup(keyed, key).where("not kept")
    gone = gone.select(F.col(key)["file"].alias("file"), F.col(key)["row"].alias("row"), F.lit(1).alias("value"))
    return rows.decided(gone, lambda df, v: df.where(F.col(v) == 0).select(docs.columns))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id.

    Texts without words, null ones too, are linked with nothing and stay, as do rows without
    an id.  Rows with one id are one document: all stay or all go.  An empty table gives no
    rows.
    """
    scratch = common.Scratch(spark, "no-near-copies")
    rows = Rows(docs, scratch)
    places = near_dedup.near_dedup(rows.df, places=True, located=rows).where("not kept")
    return rows.decided(places.select("file", "row", F.lit(1).alias("value")), lambda df, v: df.where(F.col(v) == 0).select(docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    A text without words, or null, has size 0 and is taken as its rank among its source's
    documents says; a null source is a source of its own.  Rows repeated with one id are
    taken each by its own rank.  An empty table gives no rows.
    """
    rows = Rows(docs, common.Scratch(spark, "mixed"))
    copies = mixing.mix(rows.df, carry=(rows.file, rows.row))
    copies = copies.select(F.col(rows.file).alias("file"), F.col(rows.row).alias("row"), F.col("copies").alias("value"))

    def repeated(df: DataFrame, v: str) -> DataFrame:
        copy = fresh(df.columns, "__copy")
        df = df.where(F.col(v) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(v).cast("int"))))
        return df.select(docs.columns)

    # No document is taken more than twice: its source's target is twice its size at most.
    return rows.decided(copies, repeated, values=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mixture, and digests of what they decode to.

    A null text counts as empty; an empty one has no tokens.  Repeated rows give a row each.
    An empty table gives no rows.
    """
    return bytebpe.encode(docs, bytebpe.vocabulary("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: The classifier and the near-duplicate components are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next reads it."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with common.removed_after():
            docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
