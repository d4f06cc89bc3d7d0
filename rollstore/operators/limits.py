"""Limits on distinct values: a cap for a column, a guard within a key.

Which values are admitted depends on arrival.  Values admitted by earlier loads are a
small table (value, or key and value); a load ranks its new values by first arrival,
admits those for which there is room, and collapses the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import EXCEEDED, SEQ, Dimension
from ..types import col

#: Most bytes of admitted values that are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Room beyond which new values are counted first: a cap that all of them fit under needs no order.
COUNTED_ROOM = 10_000


def collapsed(d: Dimension) -> Column:
    return F.lit({"string": EXCEEDED, "boolean": False}.get(d.kind, 0)).cast(d.spark)


def newly_capped(rows: DataFrame, d: Dimension, admitted: DataFrame | None, n_admitted: int) -> DataFrame:
    """(v): the new values of ``rows`` that the cap still admits."""
    first = rows.groupBy(col(d.name).alias("v")).agg(F.min(SEQ).alias("s"))
    if admitted is not None:
        first = first.join(admitted, "v", "left_anti")
    first = first.where(F.col("v") != EXCEEDED)
    room = max(0, d.cardinality - n_admitted)
    if room > COUNTED_ROOM and first.count() <= room:
        return first.select("v")
    return first.orderBy("s").limit(min(room, (1 << 31) - 1)).select("v")


def capped(rows: DataFrame, d: Dimension, admitted: DataFrame) -> DataFrame:
    size = admitted.agg(F.sum(F.octet_length("v") + 32)).first()[0] or 0
    side = F.broadcast(admitted) if size <= BROADCAST_BYTES else admitted
    known = side.select(F.col("v"), F.lit(True).alias("__in"))
    joined = rows.join(known, col(d.name) == F.col("v"), "left")
    return _replaced(joined, d, rows.columns)


def newly_guarded(rows: DataFrame, d: Dimension, admitted: DataFrame | None) -> DataFrame:
    """(k0.., v): the new values within each key that the guard still admits."""
    keys = [col(k).alias(f"k{i}") for i, k in enumerate(d.guard.dimensions)]
    names = [f"k{i}" for i in range(len(keys))]
    first = rows.groupBy(*keys, col(d.name).alias("v")).agg(F.min(SEQ).alias("s"))
    # Values that a cap has collapsed already take no room.
    first = first.where(F.col("v") != collapsed(d)) if d.kind == "string" else first
    room = F.lit(d.guard.limit)
    if admitted is not None:
        first = first.join(admitted, [*names, "v"], "left_anti")
        used = admitted.groupBy(*names).agg(F.count(F.lit(1)).alias("used"))
        first = first.join(used, names, "left")
        room = room - F.coalesce("used", F.lit(0))
    rank = F.row_number().over(W.partitionBy(*names).orderBy("s"))
    return first.withColumn("r", rank).where((F.col("r") <= d.guard.limit) & (F.col("r") <= room)).select(*names, "v")


def guarded(rows: DataFrame, d: Dimension, admitted: DataFrame) -> DataFrame:
    known = admitted.withColumn("__in", F.lit(True))
    on = col(d.name) == F.col("v")
    for i, k in enumerate(d.guard.dimensions):
        on = on & (col(k) == F.col(f"k{i}"))
    return _replaced(rows.join(known, on, "left"), d, rows.columns)


def _replaced(joined: DataFrame, d: Dimension, columns: list[str]) -> DataFrame:
    value = F.when(F.col("__in"), col(d.name)).otherwise(collapsed(d))
    return joined.select(*(value.alias(c) if c == d.name else col(c) for c in columns))
