"""Suffix-array deduplication with longest-previous-factor arrays, over bytes.

A repeated string of 50 bytes holds a repeated string of 32 bytes, and equal strings of 50
choose the same one as their least by hash.  So blocks first send hashes of those, and
learn which of them two documents share; a line of some 30 bytes in many contexts goes no
further.  Runs of strings of 50 that are left are cut where their least string of 16
changes, and these stretches go to the part of that string's hash, where all equal strings
meet.  Equal stretches are one there, and are later copies as a whole but for the first.

A part builds suffix arrays of its distinct stretches, some thousand at a time, by prefix doubling, takes the common
prefix lengths of neighbours from the ranks that doubling left, and finds for each suffix
the previous and the next one in suffix order that belongs to a smaller document, by
pointer jumping, with the least common prefix on the way.  The longer of the two is its
longest previous factor.  Where that has 50 bytes or more, the string is a later copy.

Documents that equal one with a smaller id as a whole are settled by digest; a block
sends equal stretches once, with the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B
from .common import Scratch
from .substring_dedup import LiveBlock, anchors, refs, survivors

#: Bytes in a string.
WINDOW = 50
#: Bytes of the string inside it that is compared first, and of the one that stretches are cut by.
ANCHOR, CUT = 32, 16
#: Suffix arrays of a part: a string's hash tells which one it is in.
ARRAYS = 64
#: Bytes that a suffix is first ranked by: nine binary digits each, as the end is less than any byte.
FIRST = 7

STRETCH = "part int, uid long, refs binary, lengths binary, owners binary, counts binary, blob binary"


def suffix_array(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The order of all suffixes of the texts of the given lengths, which lie one after the other, and ranks by doubled prefixes.

    A suffix ends where its text does.  Ranks of a length are equal for suffixes whose first
    so many bytes, or all, are equal.
    """
    n = len(text)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        byte = np.zeros(n, np.uint64)
        byte[: max(0, n - k)] = text[k:].astype(np.uint64) + np.uint64(1)
        byte[left <= k] = 0
        key = (key << np.uint64(9)) | byte
    ranks: dict[int, np.ndarray] = {}
    length, longest = FIRST, int(lengths.max(initial=0))
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new)
        ranks[length] = rank
        if length >= longest or int(rank.max(initial=0)) == n:
            return order, ranks
        after = np.zeros(n, np.uint64)
        after[: max(0, n - length)] = rank[length:]
        after[left <= length] = 0
        key = (rank.astype(np.uint64) << np.uint64(32)) | after
        length *= 2


def common_prefixes(text: np.ndarray, lengths: np.ndarray, order: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
    """Of each suffix in order, the length of the prefix that it has in common with the one before; 0 for the first."""
    n = len(text)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    a, b = order[:-1], order[1:]
    most = np.minimum(left[a], left[b])
    have = np.zeros(len(a), np.int64)
    at = lambda x: np.minimum(x + have, n - 1)
    for length in sorted(ranks, reverse=True):
        # Once a suffix has ended there is nothing more to have in common.
        same = (have < most) & (ranks[length][at(a)] == ranks[length][at(b)])
        have = np.where(same, np.minimum(have + length, most), have)
    for _ in range(FIRST - 1):
        have += (have < most) & (text[at(a)] == text[at(b)])
    return np.concatenate([[0], have]) if n else have


def longest_previous_factors(owner: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in order, how long a prefix of it a suffix of a smaller owner begins with.

    The nearest smaller owners before and after share the most.  A pointer that finds an
    owner not smaller goes on to where that one points, as all between are no smaller either.
    """
    out = np.zeros(len(owner), np.int64)
    for owners, common in ((owner, lcp), (owner[::-1], np.concatenate([[0], lcp[1:][::-1]]) if len(lcp) else lcp)):
        n = len(owners)
        low = np.concatenate([[np.iinfo(owners.dtype).min], owners])
        to, least = np.arange(n + 1) - 1, np.concatenate([[0], common])
        to[0] = 0
        todo = np.flatnonzero(low[to] >= low)
        todo = todo[todo > 0]
        while len(todo):
            at = to[todo]
            to[todo], least[todo] = to[at], np.minimum(least[todo], least[at])
            todo = todo[low[to[todo]] >= low[todo]]
        found = np.where(to[1:] > 0, least[1:], 0)
        out = np.maximum(out, found if owners is owner else found[::-1])
    return out


class ByteBlock(LiveBlock):
    def __init__(self, row: dict):
        super().__init__(row)
        self.units, self.owner = B.BYTE_HASH[self.raw], B.group_rows(self.sizes)

    def stretches(self, row: dict, anchor: int, cut: int, window: int):
        """Start and number of strings of each stretch, the hash of its part, each one's index among the distinct, and of those: text, hash, smallest id here."""
        live = self.live_after(row, [anchor], window)
        s, n, h = anchors(self.units, self.owner, cut, window, live)
        ids = self.ids[self.owner[s]]
        index: dict[bytes, int] = {}
        inverse = np.fromiter((index.setdefault(self.data[a:b], len(index)) for a, b in zip(s.tolist(), (s + n + window - 1).tolist(), strict=True)), np.int64, len(s))
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, ids)
        hashes = np.zeros(len(index), np.uint64)
        hashes[inverse] = h
        return s, n, ids, inverse, list(index), hashes, least


def later_runs(texts: list[bytes], owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, count), sorted: runs of places in the texts whose strings a text of a smaller owner has too."""
    text, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    order, ranks = suffix_array(text, lengths)
    lcp = common_prefixes(text, lengths, order, ranks)
    which = B.group_rows(lengths)
    rank = np.unique(owner, return_inverse=True)[1].astype(np.int64)
    later = np.zeros(len(text), bool)
    later[order] = longest_previous_factors(rank[which[order]], lcp) >= window
    at = np.flatnonzero(later)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])
    first = np.flatnonzero(new)
    begins = np.cumsum(lengths) - lengths
    return which[at[first]], at[first] - begins[which[at[first]]], np.diff(np.append(first, len(at)))


def later_copies(sent: DataFrame, window: int) -> DataFrame:
    """(uid, refs): triples of a stretch, the first of its strings that is a later copy, and how many follow."""

    def part(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        index: list[dict[bytes, int]] = [{} for _ in range(ARRAYS)]
        refs_, owners, arrays, numbers, sizes, rows = [], [], [], [], [], []
        for i, row in enumerate(B.rows_of(iter(table.to_batches()))):
            lengths = np.frombuffer(row["lengths"], np.uint16).astype(np.int64)
            data = unzip.decompress(row["blob"], max_output_size=int(lengths.sum()))
            array = np.repeat(np.arange(ARRAYS), np.frombuffer(row["counts"], np.uint32))
            ends = np.cumsum(lengths)
            # Setting a default keeps one copy of each distinct text.
            found = [d.setdefault(data[a:b], len(d)) for d, a, b in zip(map(index.__getitem__, array.tolist()), (ends - lengths).tolist(), ends.tolist(), strict=True)]
            for held, x in ((refs_, np.frombuffer(row["refs"], np.uint32)), (owners, np.frombuffer(row["owners"], np.int64)), (arrays, array), (numbers, np.array(found, np.int64)), (sizes, lengths), (rows, np.full(len(array), i))):
                held.append(x)
        ref, owner, array, number, size, row_of = map(np.concatenate, (refs_, owners, arrays, numbers, sizes, rows))
        base = np.cumsum([0, *map(len, index)])
        number = number + base[array]
        least = np.full(int(base[-1]), np.iinfo(np.int64).max)
        np.minimum.at(least, number, owner)
        runs = [later_runs(list(d), least[base[k] : base[k + 1]], window) for k, d in enumerate(index)]
        text = np.concatenate([r[0] + base[k] for k, r in enumerate(runs)])
        first, count = (np.concatenate([r[j] for r in runs]) for j in (1, 2))
        # A stretch that another owner has before goes as a whole; the first one where other stretches say so.
        whole = np.flatnonzero(owner > least[number])
        some = np.flatnonzero(owner == least[number])
        lo, hi = np.searchsorted(text, number[some], "left"), np.searchsorted(text, number[some], "right")
        which = B.group_rows(hi - lo)
        run = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        stretch = np.concatenate([whole, some[which]])
        triples = np.stack([ref[stretch], np.concatenate([np.zeros(len(whole), np.int64), first[run]]), np.concatenate([size[whole] - window + 1, count[run]])], axis=1).astype(np.uint32)
        order = np.argsort(row_of[stretch], kind="stable")
        edges = np.searchsorted(row_of[stretch][order], np.arange(table.num_rows + 1))
        out = [triples[order[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"uid": table.column("uid"), "refs": pa.array(out, pa.binary())})

    return sent.groupBy("part").applyInArrow(part, "uid long, refs binary")


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    cut: int = CUT,
    keep_bytes: bool = False,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256; kept (binary) on request.

    A byte of the UTF-8 text is removed if a string of ``window`` bytes that also starts in a
    document with a smaller id covers it; overlapping strings count, and strings are judged
    on the input.  n_spans counts the maximal removed runs.  A null text counts as empty; a
    text shorter than a window loses nothing.  Matches never cross documents.  A null id
    ranks below all others; rows with one id don't remove each other's bytes.  An empty
    table gives no rows; other columns are ignored.  Kept bytes need not be valid UTF-8.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    packed = B.Packed(docs, scratch, id_col, text_col, block_bytes)
    parts = B.parts_for(packed.df)

    def send_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            _, _, _, _, texts, hashes, least = ByteBlock(row).stretches(row, anchor, cut, window)
            part, array = (hashes % np.uint64(parts)).astype(np.int32), (hashes // np.uint64(parts) % np.uint64(ARRAYS)).astype(np.int64)
            order = np.lexsort((array, part))
            edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            zip_ = zstandard.ZstdCompressor(level=1)
            out: dict[str, list] = {k: [] for k in ("part", "uid", "refs", "lengths", "owners", "counts", "blob")}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                some = order[a:b]
                chosen = [texts[i] for i in some.tolist()]
                out["part"].append(int(part[some[0]]))
                out["uid"].append(row["uid"])
                out["refs"].append(some.astype(np.uint32).tobytes())
                out["lengths"].append(np.array([len(x) for x in chosen], np.uint16).tobytes())
                out["owners"].append(least[some].tobytes())
                out["counts"].append(np.bincount(array[some], minlength=ARRAYS).astype(np.uint32).tobytes())
                out["blob"].append(zip_.compress(b"".join(chosen)))
            yield pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int32()), "uid": pa.array(out["uid"], pa.int64())} | {k: pa.array(out[k], pa.binary()) for k in ("refs", "lengths", "owners", "counts", "blob")})

    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            b = ByteBlock(row)
            s, n, ids, inverse, _, _, least = b.stretches(row, anchor, cut, window)
            depth = np.zeros(len(b.raw) + 1, np.int32)
            here = ids > least[inverse]
            np.add.at(depth, s[here], 1)
            np.add.at(depth, s[here] + n[here] + window - 1, -1)
            # A distinct stretch that is later somewhere is later in all documents here that have it.
            triples = refs(row["last"]).reshape(-1, 3).astype(np.int64)
            by_ref = np.argsort(inverse, kind="stable")
            lo = np.searchsorted(inverse[by_ref], triples[:, 0])
            hi = np.searchsorted(inverse[by_ref], triples[:, 0], side="right")
            which = B.group_rows(hi - lo)
            place = s[by_ref[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]] + triples[which, 1]
            np.add.at(depth, place, 1)
            np.add.at(depth, place + triples[which, 2] + window - 1, -1)
            removed = np.cumsum(depth[:-1]) > 0
            for d in np.flatnonzero(b.copy & (b.sizes >= window)):
                removed[b.offsets[d] : b.offsets[d + 1]] = True
            n_removed, spans, kept = [], [], []
            for a, z in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
                mask = removed[a:z]
                n_removed.append(int(mask.sum()))
                spans.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0)
                kept.append(b.raw[a:z][~mask].tobytes() if n_removed[-1] else b.data[a:z])
            yield pa.RecordBatch.from_pydict({
                "_id": pa.array([None if i == -(2**63) else i for i in b.ids.tolist()], pa.int64()), "n_bytes": pa.array(b.sizes), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            } | ({"kept": pa.array(kept, pa.binary())} if keep_bytes else {}))

    carried = survivors(packed, ByteBlock, [anchor], window, parts)
    carried = B.answered(carried, later_copies(carried.mapInArrow(send_stretches, STRETCH), window), "last", scratch)
    return packed.close(carried.mapInArrow(finish, f"_id long, {result}")).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true)::INT AS new FROM x JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
a AS (SELECT doc_id, min(i) AS lo, max(i) + 49 AS hi FROM k GROUP BY doc_id, span),
b AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM a),
r AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - 1 - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
      FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE kept END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
