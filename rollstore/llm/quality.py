"""Quality classifier: a generalised additive model with pairwise interactions.

Training boosts shallow trees in turn, feature by feature, each on that feature's bins
alone; the trees of a feature add up to one lookup table.  Then pairs of features are
ranked by what a tree over both still gains, and the best are boosted in the same cyclic
way into two-dimensional tables.  A score is the sum of table entries: bins are found for
a whole batch at once and added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import word_hashes
from .common import prepare, slices, text_or_empty, utf8

#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Bins of a feature, bins of each side of a pair, pairs, boosting rounds, step.
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 48, 12, 8, 150, 0.12
#: Fewest rows in a leaf, and the shrinkage of its value.
LEAF_ROWS, RIDGE = 8, 2.0

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "upper", "digit", "symbol", "exclamation", "comma_stop", "space", "newline",
    "non_ascii", "distinct_words", "top_word", "repeats_before", "distinct_lines", "mean_line", "symbol_words", "upper_words", "short_words", "stops_per_word",
)

_CLASS = np.zeros((256, 7), bool)
_CLASS[65:91, 0] = True
_CLASS[48:58, 1] = True
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = True
_CLASS[33, 3] = True
_CLASS[[44, 46], 4] = True
_CLASS[[9, 11, 12, 13, 32], 5] = True
_CLASS[128:, 6] = True


def _per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a document, one column a feature; all finite, also for empty texts."""
    docs, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    hashes, starts, ends, doc = word_hashes(raw, offsets)
    edges = np.searchsorted(doc, np.arange(docs + 1))
    n = np.diff(edges).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    one, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    share = lambda c: _per_doc(_CLASS[raw, c], offsets) / bytes_
    mean = _per_doc(length, edges) / one
    out = np.zeros((docs, len(FEATURES)))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    run = np.flatnonzero(first)
    counts = np.diff(np.append(run, len(h)))
    top = np.zeros(docs)
    np.maximum.at(top, d[run], counts)
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, length)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    last = raw[ends - 1] if len(ends) else raw[:0]
    stop = np.isin(last, np.frombuffer(b".,;:", np.uint8))
    lines, distinct = np.ones(docs), np.ones(docs)
    data = raw.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts = data[a:b].split(b"\n")
        lines[i], distinct[i] = len(parts), len(set(parts))
    columns = (
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(0, _per_doc(length**2, edges) / one - mean**2)), np.log1p(longest), share(0), share(1), share(2), share(3), share(4), share(5), lines / bytes_,
        share(6), _per_doc(np.bincount(d[run], minlength=docs).astype(float), np.arange(docs + 1)) / one, top / one, _per_doc(again, edges) / one, distinct / lines, np.log1p(size / lines),
        _per_doc(_CLASS[last, 2] & ~stop, edges) / one, _per_doc(_CLASS[raw[starts], 0] if len(starts) else again, edges) / one, _per_doc(length <= 2, edges) / one, _per_doc(stop, edges) / one,
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


@dataclass
class Model:
    """Cuts of each feature, its table, the pairs with their coarser cuts and tables, and the constant."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins: its gain, and the number of bins to the left (0: none)."""
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    gain = _gain(cg, ch) + _gain(cg[-1] - cg, ch[-1] - ch) - _gain(cg[-1], ch[-1])
    gain[(cn < LEAF_ROWS) | (cn[-1] - cn < LEAF_ROWS)] = -1
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of a tree of up to four leaves over the bins of one feature."""
    out = np.zeros(len(g))
    spans = [(0, len(g))]
    for _ in range(2):
        after = []
        for a, b in spans:
            _, k = _split(g[a:b], h[a:b], n[a:b])
            after += [(a, a + k), (a + k, b)] if k else [(a, b)]
        spans = after
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature, then the other on each side: its gain and values."""
    best, values = 0.0, np.zeros(g.shape)
    for flip in (False, True):
        a, b, c = (x.T if flip else x for x in (g, h, n))
        for k in range(1, a.shape[0]):
            gain, cells = 0.0, np.zeros(a.shape)
            whole = _gain(a.sum(), b.sum())
            for rows in (slice(0, k), slice(k, None)):
                ga, hb, nc = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                more, cut = _split(ga, hb, nc)
                gain += more + _gain(ga.sum(), hb.sum())
                for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                    cells[rows, cols] = ga[cols].sum() / (hb[cols].sum() + RIDGE)
            if gain - whole > best:
                best, values = gain - whole, cells.T if flip else cells
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of P(y = 1); without rows 0.5, with one class only that class's smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(width)]
    sizes = [np.bincount(bins[j], minlength=len(cuts[j]) + 1) for j in range(width)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[j], g, len(sizes[j])), np.bincount(bins[j], h, len(sizes[j])), sizes[j])
            model.tables[j] += step
            total += step[bins[j]]
    small = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    shape = [len(coarse[j]) + 1 for j in range(width)]

    def cells(i: int, j: int, weights: np.ndarray | None) -> np.ndarray:
        return np.bincount(small[i] * shape[j] + small[j], weights, shape[i] * shape[j]).reshape(shape[i], shape[j]).astype(float)

    g, h = slopes()
    ranked = sorted(((_pair_tree(cells(i, j, g), cells(i, j, h), cells(i, j, None))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    counts = [cells(i, j, None) for i, j in model.pairs]
    for _ in range(ROUNDS // 5):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(cells(i, j, g), cells(i, j, h), counts[k])[1]
            model.pair_tables[k] += step
            total += step[small[i], small[j]]
    return model


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


def featured(src: DataFrame) -> DataFrame:
    """(_id, x) of (_id, _t)."""
    prepare(src.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", 1 << 20):
            x = features(*utf8(batch.column("_t")))
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model fitted on at most ``sample_rows`` labelled rows with remainder other than 0.

    A document with several labels counts as 1 if most are.  Only features, never texts,
    reach the driver, and no more than the sample's.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
    # Bounded by sample_rows, so it is broadcast.
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    # Copies of a row are one row; the sample stays bounded by its ids.
    rows = featured(src.join(F.broadcast(sample.select("_id")), "_id", "left_semi")).groupBy("_id").agg(F.first("x").alias("x")).join(F.broadcast(sample), "_id").select("_id", "x", "y").toArrow().sort_by("_id")
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(rows.column("x").to_pylist(), float), rows.column("y").to_numpy())


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``id_col``, score (0 to 1), predicted (1 if score >= ``threshold``).

    A null text counts as empty and is scored as such.  Labels, language, source and id are
    no inputs.  Rows repeated with one id give a row each; an empty table gives no rows;
    other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", 1 << 20):
            score = model.score(features(*utf8(batch.column("_t"))))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["_id", "score", "predicted"])

    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model accepts; decided where they are read."""
    prepare(docs.sparkSession)
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            yield batch.filter(pa.array(model.score(features(*utf8(batch.column(at)))) >= threshold))

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, train(docs, labels))
    return out.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", "predicted")
