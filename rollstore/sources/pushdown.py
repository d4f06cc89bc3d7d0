"""Predicates on source columns that a filter on dimensions implies.

A dimension is an expression over its source column (nulls replaced, time truncated),
which a Parquet scan can't be asked for.  Where a comparison on the dimension implies one
on the column itself, that one is added below, so that row groups are skipped.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import timeops
from ..plans import filters
from ..schema import Dimension, TableSpec
from ..types import col

_EMPTY = {"string": "", "numeric": 0, "boolean": False}


def implied(spec: TableSpec, df: DataFrame, f: dict | None) -> Column | None:
    if not f:
        return None
    if f["op"] == "and":
        parts = [p for p in (implied(spec, df, x) for x in f["filters"]) if p is not None]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out & p
        return out
    if f["op"] not in ("eq", "lt", "le", "gt", "ge", "in"):
        return None
    d = spec.column(f["column"])
    if not isinstance(d, Dimension):
        return None
    kind = dict(df.dtypes)[d.field]
    if d.kind == "time":
        return _time(d, kind, f)
    if kind != d.spark or d.kind == "boolean" or d.kind == "string" and d.length >= 0:
        return None
    values = f["values"] if f["op"] == "in" else [f["value"]]
    # A null stands for an empty text or zero; if that passes, nulls must pass too.
    if any(_passes(d, f["op"], v) for v in values):
        return None
    return filters.build(f, spec, lambda _: col(d.field))


def _passes(d: Dimension, op: str, text: str) -> bool:
    empty = _EMPTY[d.kind]
    value = text if d.kind == "string" else d.num.parse(text)
    return {"eq": empty == value, "in": empty == value, "lt": empty < value, "le": empty <= value, "gt": empty > value, "ge": empty >= value}[op]


def _time(d: Dimension, kind: str, f: dict) -> Column | None:
    """Truncated time is never later than the time itself, and less than a second earlier if only fractions go."""
    if kind != "timestamp_ntz" or f["op"] == "in":
        return None
    scale = 1_000_000 if d.micro else 1
    at = timeops.literal(f["value"], d.micro)
    start = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=at // scale, microseconds=at % scale if d.micro else 0)
    after = start + (datetime.timedelta(microseconds=1) if d.micro else datetime.timedelta(seconds=1))
    lit = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    c = col(d.field)
    low = {"ge": c >= lit(start), "gt": c >= lit(after), "eq": c >= lit(start)}.get(f["op"])
    if d.granularity or d.rollup:
        return low
    high = {"le": c < lit(after), "lt": c < lit(start), "eq": c < lit(after)}.get(f["op"])
    # Without a lower bound nulls, which stand for the beginning of time, would pass.
    if low is None:
        return c.isNull() | high
    return low if high is None else low & high
