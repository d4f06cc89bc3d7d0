"""Column types: names, Spark storage types, ranges, and the text form of values."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(n: int) -> Column:
    """An integer literal; one beyond 64 bits is a decimal."""
    return F.lit(n) if -(1 << 63) <= n < 1 << 63 else F.lit(Decimal(n))


@dataclass(frozen=True)
class NumType:
    name: str
    spark: str
    #: Type that sums are kept in.
    wide: str
    low: int | None
    high: int | None

    @property
    def is_float(self) -> bool:
        return self.low is None

    def parse(self, text: str) -> int | float:
        """A literal of this type: leading blanks and trailing garbage are accepted, nothing at all is not."""
        m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?inf|nan)" if self.is_float else r"\s*([+-]?\d+)", text, re.I)
        if not m:
            raise ValueError(f"Can't parse '{text}' as {self.name}")
        return float(m[1]) if self.is_float else int(m[1])

    def from_text(self, c: Column) -> Column:
        """The same for a column of texts; a text that can't be parsed, or is out of range, fails the job."""
        pattern = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:inf(?:inity)?|nan))" if self.is_float else r"^\s*([+-]?\d+)"
        value = F.regexp_extract(c, pattern, 1).try_cast(self.spark)
        if self.low is not None:
            value = F.when(value.between(whole(self.low), whole(self.high)), value)
        return F.coalesce(value, F.raise_error(F.concat(F.lit(f"Can't parse as {self.name}: "), c)).cast(self.spark))

    def wrapped(self, c: Column) -> Column:
        """An integer sum reduced to the declared width, as fixed-width arithmetic leaves it."""
        if self.is_float:
            return c.cast(self.spark)
        span = self.high - self.low + 1
        shifted = c.cast("decimal(38,0)") - whole(self.low).cast("decimal(38,0)")
        return (F.pmod(shifted, whole(span).cast("decimal(38,0)")) + whole(self.low).cast("decimal(38,0)")).cast(self.spark)


def _int(name: str, bits: int, signed: bool, spark: str, wide: str = "bigint") -> NumType:
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return NumType(name, spark, wide, low, high)


#: Unsigned types are stored in the next wider signed one.
NUM_TYPES = {
    t.name: t
    for t in (
        _int("byte", 8, True, "tinyint"), _int("ubyte", 8, False, "smallint"), _int("short", 16, True, "smallint"), _int("ushort", 16, False, "int"),
        _int("int", 32, True, "int"), _int("uint", 32, False, "bigint"), _int("long", 64, True, "bigint"), _int("ulong", 64, False, "decimal(20,0)", "decimal(38,0)"),
        NumType("float", "float", "double", None, None), NumType("double", "double", "double", None, None),
    )
}


def num_type(name: str) -> NumType:
    if name not in NUM_TYPES:
        raise ValueError(f"Unsupported type: {name}")
    return NUM_TYPES[name]


def uint_for(most: int) -> NumType:
    """The unsigned type that a declared maximum asks for: 32 or 64 bits."""
    return NUM_TYPES["uint" if most <= 0xFFFFFFFF else "ulong"]
