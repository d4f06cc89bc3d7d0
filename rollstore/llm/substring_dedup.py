"""Substring deduplication by level-wise doubling, over words.

A window of 50 words that occurs in two documents holds, at each of its places, shared
windows of 25 and of 13 words.  So windows of 13 words are compared first; where they
are shared, windows of 25; where those are shared, all windows of 50.  At the lower
levels one window is compared for each longer one, the least by hash (a minimiser):
equal long windows choose equal short ones, and neighbouring ones mostly the same, so
about a twentieth of the places is sent.  At the last level the smallest document id of
each window decides which copies go.

Documents that equal one with a smaller id as a whole are settled by digest and send
nothing; a block sends each hash once with its smallest id.  So neither
copies nor common passages pile up in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import Scratch

#: Words in a window.
WINDOW = 50
#: The shortest length that is compared is at least this.
LEAST = 12

LOW32 = np.uint64(0xFFFFFFFF)


def levels(window: int, least: int = LEAST) -> list[int]:
    """Lengths that double up to the window: 13, 25, 50."""
    out = [window]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(units: np.ndarray, owner: np.ndarray, length: int, window: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring live windows with one least short window: first window, number of windows, hash."""
    h = B.window_hashes(units, length)
    starts = np.flatnonzero(live)
    if not len(starts):
        return starts, starts, h[:0]
    key = (h & ~LOW32) | np.arange(len(h), dtype=np.uint64)
    at = (B.window_min(key, window - length + 1)[starts] & LOW32).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), B.mixed(h[at[first]])


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of runs."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else first, n) + np.arange(int(n.sum()))


def whole_windows(owner: np.ndarray, window: int) -> np.ndarray:
    """Whether the window that starts at each place lies within one document."""
    n = len(owner) - window + 1
    return owner[:n] == owner[window - 1 :] if n > 0 else np.zeros(0, bool)


def in_two(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, each input's index among them, and whether two documents here have it."""
    uniq, inverse = np.unique(hashes, return_inverse=True)
    lo = np.full(len(uniq), np.iinfo(np.int64).max)
    hi = np.full(len(uniq), -1)
    np.minimum.at(lo, inverse, owner)
    np.maximum.at(hi, inverse, owner)
    return uniq, inverse, lo != hi


def refs(lists) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32)


class LiveBlock(B.Block):
    """A block with its units (hashes of words or bytes), each one's document, and which documents are copies."""

    units: np.ndarray
    owner: np.ndarray

    def __init__(self, row: dict):
        super().__init__(row)
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[row.get("copies") or []] = True

    def live_after(self, row: dict, lengths: list[int], window: int) -> np.ndarray:
        """The windows outside copies that are alive after the answers to the given lengths."""
        live = whole_windows(self.owner, window)
        live &= ~self.copy[self.owner[: len(live)]]
        for i, length in enumerate(lengths):
            first, n, h = anchors(self.units, self.owner, length, window, live)
            _, inverse, alive = in_two(h, self.owner[first])
            alive[refs(row[f"a{i}"])] = True
            keep = alive[inverse]
            live = np.zeros(len(live), bool)
            live[spread(first[keep], n[keep])] = True
        return live


class WordBlock(LiveBlock):
    def __init__(self, row: dict):
        super().__init__(row)
        self.units, self.starts, self.ends, self.owner = B.word_hashes(self.raw, self.offsets)


def survivors(packed: B.Packed, block: type[LiveBlock], lengths: list[int], window: int, parts: int) -> DataFrame:
    """The blocks with the answers a0, a1, ... to the given lengths, level by level, and the copies among their documents.

    At each length, a block sends the least window of that length in each live one, half of
    its hash beside the part; a chance match keeps a window alive in vain, nothing else.
    """
    carried = B.beside(packed.df, B.copies(packed.df, packed.scratch))

    def level(i: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in B.rows_of(batches):
                b = block(row)
                first, _, h = anchors(b.units, b.owner, lengths[i], window, b.live_after(row, lengths[:i], window))
                uniq, _, _ = in_two(h, b.owner[first])
                batch = B.entries(b.uid, uniq, np.arange(len(uniq)), None, parts)
                short = [(np.frombuffer(x.as_py(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column("hashes")]
                yield batch.set_column(2, "hashes", pa.array(short, pa.binary()))

        return send

    for i in range(len(lengths)):
        carried = B.answered(carried, B.shared(carried.mapInArrow(level(i), B.ENTRY), "u4"), f"a{i}", packed.scratch)
    return carried


def first_owner(sent: DataFrame) -> DataFrame:
    """(uid, refs): the references whose hash has a smaller owner elsewhere."""

    def part(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        owners = [np.frombuffer(x.as_py(), np.int64) for x in table.column("owners")]
        sent_refs = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("refs")]
        _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        least = np.full(inverse.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, np.concatenate(owners))
        out, at = [], 0
        for r, o in zip(sent_refs, owners, strict=True):
            out.append(r[o > least[inverse[at : at + len(r)]]].tobytes())
            at += len(r)
        return pa.table({"uid": table.column("uid"), "refs": pa.array(out, pa.binary())})

    return sent.groupBy("part").applyInArrow(part, "uid long, refs binary")


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    window: int = WINDOW,
    least: int = LEAST,
    keep_text: bool = False,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_removed, kept_sha256; kept_text on request.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.  A word is removed if
    it lies in a window of ``window`` words whose sequence also starts in a document with a
    smaller id; windows are judged on the input.  Kept words are joined by one space.  A
    null text has no words; a text shorter than a window loses none.  A null id ranks below
    all others.  Rows with one id don't remove each other's words.  An empty table gives no
    rows; other columns are ignored.  Windows are compared by 64-bit hashes of their words.
    """
    scratch = Scratch(docs.sparkSession, "windows")
    packed = B.Packed(docs, scratch, id_col, text_col, block_bytes)
    parts = B.parts_for(packed.df)
    lengths = levels(window, least)
    carried = survivors(packed, WordBlock, lengths[:-1], window, parts)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            _, uniq, _, least_id = top(WordBlock(row), row)
            yield B.entries(row["uid"], uniq, np.arange(len(uniq)), least_id, parts)

    def top(b: WordBlock, row: dict):
        """Starts of the windows that are alive outside copies, their distinct hashes, and each one's smallest id here."""
        live = b.live_after(row, lengths[:-1], window)
        starts = np.flatnonzero(live)
        uniq, inverse = np.unique(B.mixed(B.window_hashes(b.units, window)[starts]), return_inverse=True)
        least_id = np.full(len(uniq), np.iinfo(np.int64).max)
        np.minimum.at(least_id, inverse, b.ids[b.owner[starts]])
        return starts, uniq, inverse, least_id

    result = "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            b = WordBlock(row)
            starts, uniq, inverse, least_id = top(b, row)
            gone = np.zeros(len(uniq), bool)
            gone[refs(row["last"])] = True
            out = starts[gone[inverse] | (b.ids[b.owner[starts]] > least_id[inverse])]
            depth = np.zeros(len(b.owner) + 1, np.int64)
            np.add.at(depth, out, 1)
            np.add.at(depth, out + window, -1)
            removed = np.cumsum(depth[:-1]) > 0
            edges = np.searchsorted(b.owner, np.arange(len(b.ids) + 1))
            texts, n_removed = [], []
            for d in range(len(b.ids)):
                words = b.data[b.offsets[d] : b.offsets[d + 1]].split()
                mask = removed[edges[d] : edges[d + 1]]
                if b.copy[d] and len(words) >= window:
                    mask = np.ones(len(words), bool)
                n_removed.append(int(mask.sum()))
                texts.append(b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m) if n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_pydict({
                "_id": pa.array([None if i == -(2**63) else i for i in b.ids.tolist()], pa.int64()), "n_words": pa.array(np.diff(edges), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            } | ({"kept_text": pa.array([t.decode() for t in texts], pa.string())} if keep_text else {}))

    carried = B.answered(carried, first_owner(carried.mapInArrow(last, B.ENTRY)), "last", scratch)
    return packed.close(carried.mapInArrow(finish, f"_id long, {result}")).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f USING (s) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
r AS (SELECT u.doc_id, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY u.k) FILTER (g.k IS NULL) AS kept
      FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.k = g.k GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
