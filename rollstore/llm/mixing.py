"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies (target words
over source words), so the prefix sum of expected copies at rank k is k times that
rate.  Ranks come from three small counting levels - by size, by hash bucket within
a size, by id within a bucket - so that no source, size or group of copies is ever
ordered as a whole in one task.  One random offset per source is added and a copy
goes out for each integer boundary that a document's stretch crosses.  As ranks follow
size, the words taken stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Hash buckets that share the rows of one (source, size): as many as two hex digits give.
BUCKETS = 256


def hex_number(text: Column, digits: int) -> Column:
    """The first ``digits`` hex digits of md5(text) as a number, which other SQL engines can form too."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """From (source, source_size, n): the words that each source is to give.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    words; what a source can't take (more than ``most`` times its size) is shared anew
    among the rest by weight, until none is above.  The fixed point is a level: a source
    takes min(cap, weight x level), and those at their cap come first by cap over weight.
    One row a source; the windows hold only those.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)).cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    ranked = ranked.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_wrest", F.sum("_w").over(rest))
    # The level that holds if this row and all after it stay below their caps.
    ranked = ranked.withColumn("_level", F.col("_left") / F.col("_wrest")).withColumn("_open", F.col("_w") * F.col("_level") <= F.col("_cap"))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(W.partitionBy())
    ranked = ranked.withColumn("_fixed", level["_level"])
    target = F.when(F.col("_fixed").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_fixed")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 9,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target, copies, taken, and the columns named in ``carry``.

    ``size`` counts the words of the whole text (null: 0); ``copies`` is how often the mix
    has the document, at most ``most`` rounded up; ``taken`` = copies x size.  A source
    without words has target 0 and takes nothing.  A null source is a source of its own,
    the last.  Rows repeated with one id rank in any order: they are the same rows, so the
    result is the same.  Other columns are ignored.  An empty table gives no rows.  Reruns
    agree: the offset comes from the seed and the source's name.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)))
    # Sources as a plain key: a null can't be joined, so it becomes a flag beside an empty string.
    rows = scratch.save(rows.withColumn("_null", F.col("source").isNull()).withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_b", hex_number(F.coalesce(F.col("_id").cast("string"), F.lit("")), 2)), "sizes")
    key = ["_null", "_s"]

    by_bucket = scratch.save(rows.groupBy(*key, "size", "_b").agg(F.count(F.lit(1)).alias("_n")), "buckets")
    by_size = by_bucket.groupBy(*key, "size").agg(F.sum("_n").alias("_n"))
    sources = by_size.groupBy(*key).agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    sources = sources.select(*key, F.when(~F.col("_null"), F.col("_s")).alias("source"), "source_size")
    goal = targets(sources, list(weights), share, most).select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_s"), "source_size", "target")

    def running(over: list[str], order: str):
        return F.coalesce(F.sum("_n").over(W.partitionBy(*over).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    size_base = by_size.select(*key, "size", running(key, "size").alias("_base_size"))
    bucket_base = by_bucket.select(*key, "size", "_b", running([*key, "size"], "_b").alias("_base_bucket"))
    base = (
        bucket_base.join(size_base, [*key, "size"]).join(goal, key)
        .select(*key, "size", "_b", (F.col("_base_size") + F.col("_base_bucket")).alias("_base"), "source_size", "target")
    )
    rank = F.row_number().over(W.partitionBy(*key, "size", "_b").orderBy("_id")).cast("long") - 1
    placed = rows.withColumn("_r", rank).join(base, [*key, "size", "_b"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # The offset has 20 binary digits, so that with a whole rate no sum is rounded across a boundary.
    offset = hex_number(F.concat(F.lit(f"{seed}:"), F.when(F.col("_null"), "null").otherwise(F.concat(F.lit("="), "_s"))), 5) / F.lit(float(1 << 20))
    k = F.col("_base") + F.col("_r")
    copies = (F.floor((k + 1) * rate + offset) - F.floor(k * rate + offset)).cast("long")
    return placed.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, cap / w) FILTER (w * level <= cap) AS level FROM l),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.level IS NULL THEN cap ELSE least(cap, w * f.level) END AS target,
             ('0x' || substr(md5('9:' || coalesce('=' || l.source, 'null')), 1, 5))::INT / 1048576.0::DOUBLE AS u FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 2))::INT, d.doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor((k + 1) * rate + u) - floor(k * rate + u))::BIGINT * size)::BIGINT AS taken
FROM r
"""
