"""Typed results as text, at the edge only: numbers in C form, tab-separated lines."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame


def text(value, is_float32: bool = False) -> str:
    """Integers in full, doubles with 15 digits, floats with 6, booleans as words."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.{6 if is_float32 else 15}g}"
    if isinstance(value, Decimal):
        return f"{value:f}"
    return str(value)


def rows(df: DataFrame, header: bool = False) -> Iterator[list[str]]:
    """The rows as texts, streamed partition by partition."""
    floats = [t == "float" for _, t in df.dtypes]
    if header:
        yield list(df.columns)
    for r in df.toLocalIterator():
        yield [text(v, f) for v, f in zip(r, floats, strict=True)]


def tsv(df: DataFrame, header: bool = False) -> Iterator[str]:
    for r in rows(df, header):
        yield "\t".join(r) + "\n"


def lines(df: DataFrame) -> DataFrame:
    """(value): the rows as tab-separated lines, formatted where they lie; write.text() makes files of them."""
    floats = [t == "float" for _, t in df.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [[text(v, f) for v in c.to_pylist()] for c, f in zip(b.columns, floats, strict=True)]
            yield pa.RecordBatch.from_pydict({"value": pa.array(["\t".join(r) for r in zip(*columns, strict=True)], pa.string())})

    return df.mapInArrow(run, "value string")
