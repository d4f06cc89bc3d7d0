"""From records to typed rows: column mapping, partition filter, parsing, time rules, limits.

The order is that of a load: the partition filter sees the input texts; dimensions are
parsed in table order (length, then time rules); caps and guards come last, each seeing
what the ones before have collapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import timeops
from ..schema import SEQ, Dimension, Metric, TableSpec
from ..types import col

#: The longest row of a TSV file, in bytes.
MAX_ROW = 1_024_000


def input_fields(spec: TableSpec, columns: list[str] | None) -> dict[str, int]:
    """Where each table column's input field is in a record.

    Without ``columns`` a record holds the dimensions, then the metrics that are no counts.
    """
    takes = [c for c in spec.columns if not (isinstance(c, Metric) and c.agg == "count")]
    if columns is None:
        if any(c.field != c.name for c in takes):
            raise ValueError("Field aliases need columns in the load description")
        return {c.name: i for i, c in enumerate(takes)}
    out = {}
    for c in takes:
        if c.field not in columns:
            raise ValueError(f"Column name '{c.field}' is not specified in load spec")
        out[c.name] = columns.index(c.field)
    return out


def tsv(spark: SparkSession, path: str | list[str], width: int | None, batch: int, recursive: bool = False) -> DataFrame:
    """(f: array of fields, seq) of tab-separated lines: no quoting, no header; compressed files and folders too.

    Each record's place is kept as (batch, file, offset of the split, line), which orders
    records without a shuffle.
    """
    read = spark.read.option("lineSep", "\n")
    if recursive:
        read = read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tsv,csv,gz}")
    return fields_of(read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start"), width, batch)


def fields_of(lines: DataFrame, width: int | None, batch: int) -> DataFrame:
    """(f, seq) of lines with their file and place; a row that is too long or has too many fields fails the job."""
    seq = F.struct(F.lit(batch).alias("b"), F.col("file_path").alias("f"), F.col("file_block_start").alias("o"), F.monotonically_increasing_id().alias("n"))
    long = F.raise_error(F.lit("row is too long")).cast("array<string>")
    fields = F.when(F.octet_length("value") > MAX_ROW, long).otherwise(F.split("value", "\t", -1))
    if width is not None:
        many = F.raise_error(F.concat(F.lit("number of input columns is too big: "), F.col("value"))).cast("array<string>")
        fields = F.when(F.size(F.split("value", "\t", -1)) > width, many).otherwise(fields)
    return lines.select(fields.alias("f"), seq.alias(SEQ))


def memory(spark: SparkSession, rows: list[list[str]], batch: int) -> DataFrame:
    data = [(list(map(str, r)), (batch, "", 0, i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"f array<string>, {SEQ} struct<b:int,f:string,o:bigint,n:bigint>")


def utf8_prefix(c: Column, n: int) -> Column:
    """At most ``n`` bytes; a character that the cut would split is left out."""
    by_chars = F.substring(c, 1, n)
    # As many characters as still fit: for ASCII the first guess, else counted by their bytes.
    chars = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(by_chars))), lambda k: F.octet_length(F.substring(by_chars, F.lit(1), k)) <= n)
    return F.when(F.octet_length(c) <= n, c).when(F.octet_length(by_chars) <= n, by_chars).otherwise(F.substring(by_chars, F.lit(1), F.size(chars)))


def from_text(c: Column, d: Dimension, now: int) -> Column:
    match d.kind:
        case "string":
            return utf8_prefix(c, d.length) if d.length >= 0 else c
        case "boolean":
            return c == "true"
        case "numeric":
            return d.num.from_text(c)
    return aged(timeops.parsed(c, d.format, d.micro), d, now)


def aged(ts: Column, d: Dimension, now: int) -> Column:
    if d.granularity:
        return timeops.truncated(ts, d.granularity, d.micro)
    return timeops.rolled_up(ts, list(d.rollup), now, d.micro) if d.rollup else ts


def typed(spec: TableSpec, records: DataFrame, fields: dict[str, int], now: int) -> DataFrame:
    """Records of texts as typed columns; a field that a record lacks is an empty text."""
    at = lambda name: F.coalesce(F.try_element_at("f", F.lit(fields[name] + 1)), F.lit(""))
    out = [from_text(at(d.name), d, now).alias(d.name) for d in spec.dimensions]
    out += [m.num.from_text(at(m.name)).alias(m.name) for m in spec.metrics if m.agg != "count"]
    return records.select(*out, SEQ)


def from_columns(spec: TableSpec, df: DataFrame, now: int, batch: int, ordered: bool = True) -> DataFrame:
    """Typed rows of a DataFrame whose columns are named like the fields; a null is an empty text, false or zero.

    Without ``ordered`` all rows arrive at once: a row number is not deterministic, and
    filters would not be pushed below it into the scan.
    """
    kinds = dict(df.dtypes)

    def dimension(d: Dimension) -> Column:
        c, kind = col(d.field), kinds[d.field]
        match d.kind:
            case "string":
                text = F.coalesce(c.cast("string"), F.lit(""))
                return utf8_prefix(text, d.length) if d.length >= 0 else text
            case "boolean":
                return F.coalesce(c if kind == "boolean" else c.cast("string") == "true", F.lit(False))
            case "numeric":
                return F.coalesce(c.cast(d.spark), F.lit(0).cast(d.spark))
        if kind == "string":
            return aged(timeops.parsed(F.coalesce(c, F.lit("")), d.format, d.micro), d, now)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return aged(F.coalesce(timeops.from_timestamp(c, kind, d.micro), F.lit(0)), d, now)
        return aged(timeops.parsed(F.coalesce(c.cast("string"), F.lit("0")), d.format if d.format in timeops.NUMERIC_FORMATS else "", d.micro), d, now)

    if missing := [c.field for c in spec.columns if c.field not in kinds and not (isinstance(c, Metric) and c.agg == "count")]:
        raise ValueError(f"Column name '{missing[0]}' is not specified in load spec")
    out = [dimension(d).alias(d.name) for d in spec.dimensions]
    out += [col(m.field).cast(m.num.spark).alias(m.name) for m in spec.metrics if m.agg != "count"]
    seq = F.struct(F.lit(batch).alias("b"), F.lit("").alias("f"), F.lit(0).cast("bigint").alias("o"), (F.monotonically_increasing_id() if ordered else F.lit(0).cast("bigint")).alias("n"))
    return df.select(*out, seq.alias(SEQ))


def partition_filtered(records: DataFrame, spec: TableSpec, fields: dict[str, int], rule: dict) -> DataFrame:
    """Records whose key columns' hash falls into one of ``values``."""
    part = F.pmod(F.crc32(F.concat(*(F.coalesce(F.try_element_at("f", F.lit(fields[c] + 1)), F.lit("")) for c in rule["columns"]))), F.lit(int(rule["total_partitions"])))
    return records.where(part.isin([int(v) for v in rule["values"]]))
