"""Queries as DataFrame plans.

A filter sees stored rows, that is rows merged on the full key.  If it mentions no metric,
filtering before merging is the same and reaches the scan; and as every state merges
associatively, an aggregation then merges straight to the selected dimensions, without
the full-key merge below it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import timeops
from ..operators import merge
from ..schema import COUNT, SEQ, Dimension, Metric, TableSpec
from ..types import col
from . import filters


@dataclass(frozen=True)
class Item:
    """A selected column: its definition, and for time its text form and granularity."""

    column: Dimension | Metric
    format: str = ""
    granularity: str | None = None

    @property
    def name(self) -> str:
        return self.column.name

    @property
    def is_text(self) -> bool:
        return self.format not in timeops.NUMERIC_FORMATS


def selected(spec: TableSpec, q: dict) -> list[Item]:
    """The columns of a query, in output order."""
    items: list[Item] = []
    if "select" in q:
        for s in q["select"]:
            names = [c.name for c in spec.columns] if s["column"] == "*" else [s["column"]]
            for name in names:
                c = spec.column(name)
                if isinstance(c, Dimension) and c.kind == "time":
                    to = s.get("granularity")
                    items.append(Item(c, s.get("format", c.format), timeops.granularity(to) if to else None))
                else:
                    items.append(Item(c))
    else:
        for key, kind in (("dimensions", Dimension), ("metrics", Metric)):
            for name in q.get(key, []):
                c = spec.column(name)
                if not isinstance(c, kind):
                    raise ValueError(f"Column '{name}' is not among {key}")
                items.append(Item(c))
    names = [i.name for i in items]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"Column '{sorted(twice)[0]}' is selected twice")
    return items


def is_metric(spec: TableSpec, name: str) -> bool:
    return isinstance(spec.column(name), Metric)


def source(spec: TableSpec, deltas: DataFrame, f: dict | None, need: list[str], *, full: bool, seq: bool, merged: bool) -> DataFrame:
    """Rows that pass the filter: stored rows if ``full`` or if it tests metrics, else deltas (which still merge).

    Deltas that are ``merged`` have one row a key already: those are the stored rows.
    """
    mentioned = filters.columns(f)
    on_metrics = {n for n in mentioned if is_metric(spec, n)}
    if not on_metrics and (not full or merged):
        p = filters.build(f, spec, col)
        return deltas if p is None else deltas.where(p)
    if not on_metrics:
        p = filters.build(f, spec, col)
        return merge.stored_rows(spec, deltas if p is None else deltas.where(p), need, seq)
    rows = deltas if merged else merge.stored_rows(spec, deltas, [*need, *on_metrics], seq)
    finished = {n: merge.finished(spec, spec.column(n)) for n in on_metrics}
    return rows.where(filters.build(f, spec, lambda n: finished.get(n, col(n))))


def key(i: Item, now: int) -> Column:
    """A group key: stored time is rolled up again by its present age, then truncated."""
    d = i.column
    c = col(d.name)
    if d.kind == "time":
        c = timeops.rolled_up(c, list(d.rollup), now, d.micro) if d.rollup else c
        c = timeops.truncated(c, i.granularity, d.micro) if i.granularity else c
    return c.alias(d.name)


def shown(i: Item) -> Column:
    return timeops.formatted(col(i.name), i.format, i.column.micro).alias(i.name) if i.is_text else col(i.name)


def page(df: DataFrame, q: dict) -> DataFrame:
    skip, limit = int(q.get("skip", 0)), int(q.get("limit", 0))
    df = df.offset(skip) if skip else df
    return df.limit(limit) if limit else df


def aggregate(spec: TableSpec, deltas: DataFrame, q: dict, now: int, merged: bool = False) -> DataFrame:
    """Filter, group by the selected dimensions, having, sort, skip and limit."""
    items = selected(spec, q)
    names = [i.name for i in items]
    dims = [i for i in items if isinstance(i.column, Dimension)]
    metrics = [i.column for i in items if isinstance(i.column, Metric)]
    for n in filters.columns(q.get("having")):
        spec.column(n)
        if n not in names:
            raise ValueError(f"Column '{n}' is not selected")
    for s in q.get("sort", []):
        spec.column(s["column"])
        if s["column"] not in names:
            raise ValueError(f"Sort column '{s['column']}' is not selected")
    need = [m.name for m in metrics]
    if any(m.agg == "avg" for m in metrics) and spec.count_column != COUNT and spec.count_column not in need:
        need.append(spec.count_column)
    rows = source(spec, deltas, q.get("filter"), need, full=False, seq=False, merged=merged)
    keys = [key(i, now) for i in dims]
    if not metrics:
        out = rows.select(*keys).distinct()
    else:
        out = grouped(spec, rows, keys, [i.name for i in dims], metrics, need)
    having = filters.build(q.get("having"), spec, col)
    out = out if having is None else out.where(having)
    sort = []
    for s in q.get("sort", []):
        c = shown(next(i for i in items if i.name == s["column"]))
        sort.append(c.asc() if s.get("ascending", False) else c.desc())
    out = out.orderBy(*sort) if sort else out
    return page(out, q).select(*map(shown, items))


def grouped(spec: TableSpec, rows: DataFrame, keys: list[Column], names: list[str], metrics: list[Metric], need: list[str]) -> DataFrame:
    """States merged by the keys and finished.

    The elements of bitsets are laid out as rows and counted as distinct values, which is
    partial per task and per value; the other states count on the first of those rows only.
    """
    states = [spec.column(n) for n in need]
    bitsets = [m for m in states if m.agg == "bitset"]
    others = [m for m in states if m.agg != "bitset"]
    hidden = spec.hidden_count and any(m.agg == "avg" for m in metrics)
    wanted = [col(m.name) for m in others] + ([F.col(COUNT)] if hidden else [])
    if bitsets:
        # One bitset's elements need no tag.
        single = F.transform(col(bitsets[0].name), lambda x: F.struct(F.lit(0).alias("i"), x.alias("x"))) if len(bitsets) == 1 else None
        elements = [single] if single is not None else [F.transform(col(m.name), lambda x, i=i: F.struct(F.lit(i).alias("i"), x.cast("decimal(20,0)").alias("x"))) for i, m in enumerate(bitsets)]
        rows = rows.select(*keys, *wanted, F.posexplode_outer(F.concat(*elements)).alias("__at", "__e"))
        first = F.coalesce(F.col("__at"), F.lit(0)) == 0
        rows = rows.select(*map(col, names), *(F.when(first, c).alias(m.name) for m, c in zip(others, wanted, strict=False)), *([F.when(first, F.col(COUNT)).alias(COUNT)] if hidden else []), "__e")
    else:
        rows = rows.select(*keys, *wanted)
    aggs = [merge.merged(m) for m in others]
    aggs += [F.count_distinct(F.col("__e.x") if single is not None else F.when(F.col("__e.i") == i, F.col("__e.x"))).alias(m.name) for i, m in enumerate(bitsets)]
    aggs += [F.sum(COUNT).alias(COUNT)] if hidden else []
    if names:
        out = rows.groupBy(*map(col, names)).agg(*aggs)
    else:
        # Nothing in, nothing out: a bare aggregate would give one row of nulls.
        out = rows.agg(*aggs, F.count(F.lit(1)).alias("__n")).where("__n > 0")
    final = [col(m.name) if m.agg == "bitset" else merge.finished(spec, m) for m in metrics]
    return out.select(*map(col, names), *final)


def select(spec: TableSpec, deltas: DataFrame, q: dict, now: int, merged: bool = False) -> DataFrame:
    """Stored rows in order of arrival; a table over a DataFrame (``arrival`` false) has none, and isn't sorted."""
    items = selected(spec, q)
    metrics = [i.column for i in items if isinstance(i.column, Metric)]
    need = [m.name for m in metrics]
    if any(m.agg == "avg" for m in metrics) and spec.count_column != COUNT:
        need.append(spec.count_column)
    rows = source(spec, deltas, q.get("filter"), need, full=True, seq=True, merged=merged)
    out = page(rows.orderBy(SEQ) if q.get("arrival", True) else rows, q)
    return out.select(*(shown(i) if isinstance(i.column, Dimension) else merge.finished(spec, i.column) for i in items))


def search(spec: TableSpec, deltas: DataFrame, q: dict, now: int, merged: bool = False) -> DataFrame:
    """Distinct values of a dimension that contain the term."""
    d = spec.column(q["dimension"])
    if not isinstance(d, Dimension):
        raise ValueError(f"Column '{d.name}' is not a dimension")
    rows = source(spec, deltas, q.get("filter"), [], full=False, seq=False, merged=merged)
    text = col(d.name).cast("string").alias(d.name)
    # The term is tested before values are made distinct, so that others are never shuffled.
    return page(rows.select(text).where(F.contains(col(d.name), F.lit(q["term"]))).distinct(), {"limit": q.get("limit", 0)})
