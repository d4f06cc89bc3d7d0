"""Filter descriptors as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import timeops
from ..schema import Dimension, Metric, TableSpec
from ..types import NumType, whole

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def columns(f: dict | None) -> set[str]:
    """The columns that a filter mentions."""
    if not f:
        return set()
    if "column" in f:
        return {f["column"]}
    return set().union(*map(columns, f.get("filters", [f.get("filter")])))


def _number(value: int | float, num: NumType) -> Column:
    # A float column is compared with a float, or 21.124 would equal nothing.
    return F.lit(value).cast(num.spark) if num.is_float else whole(value)


def literal(c: Dimension | Metric, text: str) -> Column:
    """A filter's text as a value of the column's type."""
    if not isinstance(text, str):
        raise ValueError(f"Filter value must be a string: {text!r}")
    if isinstance(c, Metric):
        if c.agg in ("count", "bitset"):
            return whole(int(c.num.parse(text)))
        if c.agg == "avg":
            return F.lit(float(text))
        value = c.num.parse(text)
        return _number(value, c.num)
    match c.kind:
        case "string":
            return F.lit(text)
        case "boolean":
            return F.lit(text == "true")
        case "time":
            return F.lit(timeops.literal(text, c.micro))
    value = c.num.parse(text)
    return _number(value, c.num)


def stored_text(c: Dimension | Metric, text: str) -> str | None:
    """The text of the stored value that a literal equals, as a cast to string gives it; None if it isn't known here.

    Floating-point values print in more than one way, so they have none.
    """
    if not isinstance(text, str) or isinstance(c, Metric):
        return None
    match c.kind:
        case "string":
            return text
        case "boolean":
            return "true" if text == "true" else "false"
        case "time":
            return str(timeops.literal(text, c.micro))
    return None if c.num.is_float else str(c.num.parse(text))


def build(f: dict | None, spec: TableSpec, value: Callable[[str], Column]) -> Column | None:
    """The predicate; ``value`` gives the Column that stands for a name.  None for an empty filter."""
    if not f:
        return None
    op = f["op"]
    if op in ("and", "or"):
        parts = [p for p in (build(x, spec, value) for x in f["filters"]) if p is not None]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return out
    if op == "not":
        inner = build(f["filter"], spec, value)
        return None if inner is None else ~inner
    if op == "in":
        c = spec.column(f["column"])
        return value(c.name).isin(*(literal(c, v) for v in f["values"]))
    if op not in _COMPARE:
        raise ValueError(f"Unsupported filter operator: {op}")
    c = spec.column(f["column"])
    return _COMPARE[op](value(c.name), literal(c, f["value"]))
