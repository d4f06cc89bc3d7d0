"""States of single records, for tables that lie over a DataFrame and store nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COUNT, SEQ, TableSpec
from ..types import col


def row_states(spec: TableSpec, rows: DataFrame) -> DataFrame:
    """Each record as a delta row of its own: a projection, so that filters and pruning pass through it."""
    out = []
    for m in spec.metrics:
        c = col(m.name)
        match m.agg:
            case "count":
                c = F.lit(1).cast("bigint")
            case "bitset":
                c = F.when(c.isNull(), F.array().cast(m.state)).otherwise(F.array(c.cast(m.num.spark)))
            case "sum" | "avg":
                c = F.coalesce(c.cast(m.num.wide), F.lit(0).cast(m.num.wide))
        out.append(c.alias(m.name))
    extra = [F.lit(1).cast("bigint").alias(COUNT)] if spec.hidden_count else []
    return rows.select(*(col(d.name) for d in spec.dimensions), *out, *extra, SEQ)
