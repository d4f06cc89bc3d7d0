"""Aggregation states: made from records, merged with each other, finished for a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNT, SEQ, Metric, TableSpec
from ..types import col


#: Bits of a piece of a 64-bit number: sums of pieces hold for two trillion rows.
PIECE = 22


def wrapping_sum(c: Column) -> Column:
    """The sum of 64-bit integers modulo 2^64, as fixed-width arithmetic leaves it, where a plain sum would fail.

    The number is cut into three pieces, which are summed apart and put together with carries.
    """
    mask = F.lit((1 << PIECE) - 1)
    low, middle = F.sum(c.bitwiseAND(mask)), F.sum(F.shiftright(c, PIECE).bitwiseAND(mask))
    middle = middle + F.shiftright(low, PIECE)
    high = F.sum(F.shiftright(c, 2 * PIECE)) + F.shiftright(middle, PIECE)
    return F.shiftleft(high, 2 * PIECE).bitwiseOR(F.shiftleft(middle.bitwiseAND(mask), PIECE)).bitwiseOR(low.bitwiseAND(mask))


def total(m: Metric, c: Column) -> Column:
    return wrapping_sum(c) if m.num.name == "long" else F.sum(c)


def initial(m: Metric) -> Column:
    """The state of a group of records."""
    c = col(m.name)
    match m.agg:
        case "count":
            out = F.count(F.lit(1))
        case "bitset":
            out = F.collect_set(c.cast(m.num.spark))
        case "sum" | "avg":
            out = F.coalesce(total(m, c.cast(m.num.wide)), F.lit(0)).cast(m.num.wide)
        case "min":
            out = F.min(c)
        case _:
            out = F.max(c)
    return out.alias(m.name)


def merged(m: Metric) -> Column:
    """The state of a group of states."""
    c = col(m.name)
    match m.agg:
        case "count":
            out = F.sum(c).cast(m.state)
        case "sum" | "avg":
            out = total(m, c).cast(m.state)
        case "bitset":
            out = F.array_distinct(F.flatten(F.collect_list(c)))
        case "min":
            out = F.min(c)
        case _:
            out = F.max(c)
    return out.alias(m.name)


def finished(spec: TableSpec, m: Metric, state: Column | None = None) -> Column:
    """The value of a state; a bitset's state may already be a number."""
    c = col(m.name) if state is None else state
    if m.agg == "avg":
        return (c.cast("double") / col(spec.count_column)).alias(m.name)
    if m.agg == "bitset":
        return F.size(c).cast("bigint").alias(m.name)
    if m.agg == "sum" and spec.strict_width:
        return m.num.wrapped(c).alias(m.name)
    if m.agg == "sum" and m.num.name == "ulong":
        return c.cast("decimal(38,0)").alias(m.name)
    return c.alias(m.name)


def record_states(spec: TableSpec, rows: DataFrame) -> DataFrame:
    """Records merged on the full key: what a load stores."""
    extra = [F.count(F.lit(1)).alias(COUNT)] if spec.hidden_count else []
    keys = [col(d.name) for d in spec.dimensions]
    return rows.groupBy(*keys).agg(*map(initial, spec.metrics), *extra, F.min(SEQ).alias(SEQ))


def stored_rows(spec: TableSpec, deltas: DataFrame, metrics: list[str] | None = None, seq: bool = True) -> DataFrame:
    """Deltas merged on the full key: the stored rows, of which only ``metrics`` are asked for."""
    need = [m for m in spec.metrics if metrics is None or m.name in metrics]
    extra = [F.sum(COUNT).alias(COUNT)] if spec.hidden_count else []
    extra += [F.min(SEQ).alias(SEQ)] if seq else []
    keys = [col(d.name) for d in spec.dimensions]
    aggs = [*map(merged, need), *extra]
    return deltas.groupBy(*keys).agg(*aggs) if aggs else deltas.select(*keys).distinct()
