"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

DataFrame operations only.  Three passes over the text column, each over fewer
groups: the first counts rows by byte length, the second hashes the prefix of rows
whose length is shared, the third hashes the whole text of rows whose (length,
prefix hash) is shared.  Only narrow rows (ids, lengths, hashes) are shuffled, never
text: each pass marks its rows through the keys that survived the pass before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_side, text_or_empty

#: Characters hashed in the second pass.
PREFIX_CHARS = 128


def _marked(rows: DataFrame, keys: DataFrame, n: int, on: list[str], flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: its key is in ``keys`` (distinct, ``n`` of them)."""
    side = small_side(keys.select(*on, F.lit(True).alias(flag)), n, 48)
    return rows.join(side, on, "left").withColumn(flag, F.col(flag).isNotNull())


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False,
    normalise=None,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalise`` (a Column function; none by
    default); of equal texts the row with the largest id stays.  A null text counts
    as empty, and empty texts are equal to each other.  A null id ranks below all
    others.  Rows repeated with the same id and text count in group_size and are
    all marked kept, as they can't be told apart by id.  Columns other than the two named
    are ignored, whatever their names.  An empty table gives no rows.
    text_sha256 is null for a text that no other row's prefix matches, unless
    ``digest_all`` asks for every digest.
    """
    text: Column = text_or_empty(text_col) if normalise is None else F.coalesce(normalise(F.col(text_col)), F.lit(""))
    src = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    scratch = Scratch(docs.sparkSession, "exact")

    length = F.octet_length("_t").cast("long").alias("_n")
    prefix = F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_p")

    by_length = scratch.save(src.select(length).groupBy("_n").count().where("count > 1").select("_n"), "length")
    n = by_length.count()
    if n:
        # Narrow before the join, which may shuffle.
        second = _marked(src.select(length, prefix), by_length, n, ["_n"], "_shared")
        by_prefix = second.where("_shared").groupBy("_n", "_p").count().where("count > 1").select("_n", "_p")
        by_prefix = scratch.save(by_prefix, "prefix")
        n = by_prefix.count()
    full = F.sha2("_t", 256)
    # Rows whose prefix is shared are hashed whole. Without a broadcast the narrow keys must
    # not drag the text through the join's shuffle, so the digest is then taken in the scan.
    rows = src.select("_id", length, prefix, "_t")
    if n and small_side(by_prefix, n, 48) is not by_prefix:
        rows = _marked(rows, by_prefix, n, ["_n", "_p"], "_shared")
        rows = rows.select("_id", "_n", "_p", "_shared", (full if digest_all else F.when(F.col("_shared"), full)).alias("_h"))
    elif n:
        rows = _marked(rows.select("_id", "_n", "_p", full.alias("_h")), by_prefix, n, ["_n", "_p"], "_shared")
    else:
        rows = rows.select("_id", "_n", "_p", F.lit(False).alias("_shared"), (full if digest_all else F.lit(None).cast("string")).alias("_h"))
    rows = rows.withColumn("_h", F.unhex("_h"))
    groups = rows.where("_shared").groupBy("_h", "_n").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = scratch.save(groups, "groups")
    # Groups are unique by digest, and read from a table: a hot digest is on one side only, and its rows can be split at run time.
    joined = rows.join(groups, ["_h", "_n"], "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_h")).alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, digest_all=True)


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
