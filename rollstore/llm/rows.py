"""Decisions about rows, brought to where the rows lie.

An operator decides from narrow columns which rows go, how often one is taken, or which
are to be read again.  A join of such decisions with the rows would shuffle all texts.
Here a row is known by its place, (file, row in the file), which its reader gives; the
decisions become bit masks, one for each 256 rows of a file, which are broadcast to the
scan of those files.  Masks are about half a byte a row.  Where all of a table's masks
exceed ``MASK_BYTES``, files are taken in groups whose masks don't, one scan after the
other; each file is read once, and no text is shuffled at any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Most bytes of masks that are broadcast at once.
MASK_BYTES = 64 << 20
#: Rows of a mask, as a power of two: four words of 64.
MASK_BITS = 8


def fresh(taken: list[str], name: str) -> str:
    """A column name that none of ``taken`` is, whatever case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def steady(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a file, the same whenever it is read."""
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias") and not node.nodeName().startswith("LogicalRelation") or not node.deterministic():
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


class Rows:
    """A table whose rows are known by place: ``df`` is it with the columns named ``file`` and ``row``.

    ``docs`` is used as it is if it comes from Parquet files; anything else is written to
    ``scratch`` first.  The file is a 64-bit hash of its path.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.columns, self.scratch = docs.columns, scratch
        try:
            places = self._places(docs)
            docs.select(*places).schema  # noqa: B018  analysed here
            one_row_each = steady(docs)
        except AnalysisException:
            one_row_each = False
        if not one_row_each:
            docs = scratch.save(docs, "rows")
            places = self._places(docs)
        self.file, self.row, self._path = (fresh(docs.columns, n) for n in ("__file", "__row", "__path"))
        path, row = places
        self.df = docs.select("*", F.xxhash64(path).alias(self.file), row.alias(self.row))
        self._with_path = docs.select("*", path.alias(self._path), F.xxhash64(path).alias(self.file), row.alias(self.row))

    @staticmethod
    def _places(docs: DataFrame) -> tuple[Column, Column]:
        about = docs.metadataColumn("_metadata")
        return about["file_path"], about["row_index"]

    def place(self) -> list[Column]:
        return [F.col(self.file).alias("file"), F.col(self.row).alias("row")]

    def masks(self, decisions: DataFrame, planes: int) -> DataFrame:
        """(file, word, bits): of decisions (file, row, value), for each 256 rows four words for each binary digit of the value."""
        word, quarter, bit = F.shiftright("row", MASK_BITS), F.shiftright("row", 6).bitwiseAND(F.lit(3)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(F.lit(63)).cast("int"))
        on = lambda p, q: (F.shiftright(F.col("value").cast("long"), p).bitwiseAND(F.lit(1)) == 1) & (quarter == q)
        bits = [F.coalesce(F.bit_or(F.when(on(p, q), bit)), F.lit(0).cast("long")).alias(f"b{p}{q}") for p in range(planes) for q in range(4)]
        return decisions.where("value > 0").groupBy("file", word.alias("word")).agg(*bits)

    def decided(self, decisions: DataFrame, then: Callable[[DataFrame, str], DataFrame], *, values: int = 1, name: str = "decided") -> DataFrame:
        """``then(rows, column)`` of all rows, with the value decided for each (0 where none is) in that column.

        ``decisions`` is (file, row, value), one for a row at most, values up to ``values``.
        """
        planes = max(1, values.bit_length())
        masks = self.scratch.save(self.masks(decisions, planes), f"{name}-masks")
        row_bytes = 96 + 32 * planes
        per_file = masks.groupBy("file").count()
        total = masks.count()
        if total * row_bytes <= MASK_BYTES:
            return self._joined(self.df, masks, planes, then)
        # A row for each file; the driver lists files to plan a scan anyway.
        sizes = {r["file"]: r["count"] for r in per_file.collect()}
        names = self._with_path.select(self._path, self.file).distinct().collect()
        groups: list[list] = [[]]
        held = 0
        for path, file in sorted(map(tuple, names)):
            if groups[-1] and (held + sizes.get(file, 0)) * row_bytes > MASK_BYTES:
                groups.append([])
                held = 0
            groups[-1].append((path, file))
            held += sizes.get(file, 0)
        for group in groups:
            rows = self._with_path.where(F.col(self._path).isin([p for p, _ in group])).drop(self._path)
            part = masks.where(F.col("file").isin([f for _, f in group]))
            self.scratch.append(self._joined(rows, part, planes, then), name)
        return self.scratch.read(name)

    def _joined(self, rows: DataFrame, masks: DataFrame, planes: int, then: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        taken = [*rows.columns]
        named = {c: fresh(taken, f"__m_{c}") for c in masks.columns}
        side = F.broadcast(masks.select(*(F.col(c).alias(n) for c, n in named.items())))
        row = F.col(self.row)
        at = (F.col(self.file) == F.col(named["file"])) & (F.shiftright(row, MASK_BITS) == F.col(named["word"]))
        quarter, shift = F.shiftright(row, 6).bitwiseAND(F.lit(3)), row.bitwiseAND(F.lit(63)).cast("int")
        value = F.lit(0).cast("long")
        for p in range(planes):
            bits = F.when(quarter == 0, F.col(named[f"b{p}0"])).when(quarter == 1, F.col(named[f"b{p}1"])).when(quarter == 2, F.col(named[f"b{p}2"])).otherwise(F.col(named[f"b{p}3"]))
            digit = F.call_function("shiftright", bits, shift).bitwiseAND(F.lit(1))
            value = value + F.call_function("shiftleft", F.coalesce(digit, F.lit(0).cast("long")), F.lit(p))
        out = fresh(taken, "__value")
        marked = rows.join(side, at, "left").select(*(F.col(f"`{c}`") for c in taken), value.alias(out))
        return then(marked, out)
