"""Packed blocks of documents and an exchange of window hashes between them.

For operators that look for windows shared between documents.  A window a row would
shuffle many times the input, so documents are packed into blocks of a few MB, written
once, and each block sends only, for each of P parts, one row with its distinct hashes.
A part is a slice of the hash range: equal hashes meet there whatever their documents,
and however often a hash occurs, a block sends it once.  Answers go back by block: the
blocks are a table bucketed by their number, so a join brings the answers to the blocks
and moves no text.  A block's number is drawn so that it falls into the bucket of the task
that packs it, which makes the layout without a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, text_or_empty, utf8

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of text whose hashes share a part.
PART_BYTES = 16 << 20

BLOCK = "uid long, ids binary, sizes binary, digests binary, blob binary"

_rng = np.random.default_rng(20)
#: A random odd number for each byte, and the odd base of the rolling hashes.
BYTE_HASH = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
MASK64 = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of a public hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def window_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of each k consecutive unit hashes, made by doubling; len - k + 1 of them.

    High bits are well spread, low ones are not: mix those that are kept.
    """
    if len(units) < k:
        return units[:0]
    cur, n, power = units, 1, BASE
    acc: np.ndarray | None = None
    have = 0
    while k:
        if k & 1:
            if acc is None:
                acc, have = cur, n
            else:
                m = min(len(acc), len(cur) - have)
                acc = acc[:m] * np.uint64(power) + cur[have : have + m]
                have += n
        k >>= 1
        if k:
            cur = cur[:-n] * np.uint64(power) + cur[n:]
            power = power * power & MASK64
            n *= 2
    return acc


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n, out = 1, h
    while n * 2 <= w:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    rest = w - n
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word (bytes other than 0x20 and 0x09-0x0D): hash, start, end, document."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets >= 0) & (offsets <= n)]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    # Two segment sums over differently mixed bytes; a segment starts and ends at a word's edges.
    powers = _powers(int((ends - starts).max(initial=1)))
    at = np.arange(n, dtype=np.int64)
    word = np.cumsum(np.bincount(starts, minlength=n)[:n]) - 1
    keep = inside
    place = at[keep] - starts[word[keep]]
    values = BYTE_HASH[raw[keep]] * powers[place]
    sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(ends - starts)[:-1]])) if len(starts) else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return mixed(sums + (ends - starts).astype(np.uint64)), starts, ends, doc


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1 << 12)
        steps = np.full(size, np.uint64(BASE))
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def spark_hash(x: np.ndarray) -> np.ndarray:
    """The hash that Spark deals 64-bit integers into buckets by (Murmur3 of 32 bits, seed 42)."""

    def turn(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    h = np.full(len(x), 42, np.uint32)
    x = x.astype(np.uint64)
    for half in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        h = turn(h ^ turn(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = (h ^ np.uint32(8)) ^ ((h ^ np.uint32(8)) >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def number_in(bucket: int, buckets: int) -> int:
    """A random 63-bit number that Spark deals into the given bucket."""
    while True:
        drawn = np.frombuffer(os.urandom(16 * buckets + 64), np.int64) & np.int64(2**63 - 1)
        fits = np.flatnonzero(spark_hash(drawn).astype(np.int64) % buckets == bucket)
        if len(fits):
            return int(drawn[fits[0]])


def pack(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, buckets: int = 1) -> DataFrame:
    """The documents as blocks: uid, ids (int64), sizes (int64), digests (32 bytes each), blob (zstd of all texts)."""
    src = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_t"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            raw, offsets = utf8(table.column("_t").combine_chunks() if table.num_rows else table.column("_t"))
            data = raw.tobytes()
            digests = b"".join(hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            # Written once and committed with its task, so a random number is as good as any.
            uid = number_in(TaskContext.get().partitionId() % buckets, buckets)
            ids = np.array([x if x is not None else -(2**63) for x in table.column("_id").to_pylist()], np.int64)
            blob = zstandard.ZstdCompressor(level=3).compress(data)
            row = {"uid": pa.array([uid], pa.int64())}
            for k, v in (("ids", ids.tobytes()), ("sizes", np.diff(offsets).astype(np.int64).tobytes()), ("digests", digests), ("blob", blob)):
                row[k] = pa.array([v], pa.binary())
            return pa.RecordBatch.from_pydict(row)

        held: list[pa.RecordBatch] = []
        size = 0
        for piece in slices(batches, "_t", block_bytes):
            n = piece.column("_t").nbytes
            if held and size + n > block_bytes:
                yield made(held)
                held, size = [], 0
            held.append(piece)
            size += n
        if held:
            yield made(held)

    return src.mapInArrow(blocks, BLOCK)


class Block:
    """A block, unpacked."""

    def __init__(self, row: dict):
        self.uid = row["uid"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.digests = row.get("digests")
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, int(self.offsets[-1])))
        self.raw = np.frombuffer(self.data, np.uint8)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


def parts_for(blocks: DataFrame, part_bytes: int = PART_BYTES) -> int:
    total = blocks.agg(F.sum(F.length("blob"))).first()[0] or 0
    return max(8, int(-(-total * 3 // part_bytes)))


ENTRY = "part int, uid long, hashes binary, refs binary, owners binary"


def entries(uid: int, hashes: np.ndarray, refs: np.ndarray, owners: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """One row for each part with the block's distinct hashes in it."""
    part = (hashes % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, hashes, refs = part[order], hashes[order], refs[order].astype(np.uint32)
    owners = None if owners is None else owners[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(part)) if len(edges) else edges
    out: dict[str, list] = {"part": [], "uid": [], "hashes": [], "refs": [], "owners": []}
    for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
        out["part"].append(int(part[a]))
        out["uid"].append(uid)
        out["hashes"].append(hashes[a:b].tobytes())
        out["refs"].append(refs[a:b].tobytes())
        out["owners"].append(None if owners is None else owners[a:b].tobytes())
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(out["part"], pa.int32()), "uid": pa.array(out["uid"], pa.int64())} | {k: pa.array(out[k], pa.binary()) for k in ("hashes", "refs", "owners")}
    )


def group_rows(n: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(n)), n)


def shared(sent: DataFrame, width: str) -> DataFrame:
    """(uid, refs): the references whose hash (``width``: its dtype) another block sent too."""

    def part(table: pa.Table) -> pa.Table:
        uids = table.column("uid").to_numpy()
        lists = [np.frombuffer(x.as_py(), width) for x in table.column("hashes")]
        refs = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("refs")]
        _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        many = counts[inverse] > 1
        out, at = [], 0
        for r in refs:
            out.append(r[many[at : at + len(r)]].tobytes())
            at += len(r)
        return pa.table({"uid": pa.array(uids, pa.int64()), "refs": pa.array(out, pa.binary())})

    return sent.groupBy("part").applyInArrow(part, "uid long, refs binary")


def answered(blocks: DataFrame, answers: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """The blocks with what came back for each, as an array column.  A block's answers are no more than it sent.

    The answers are written, so that a later pass reads them and does not find them anew.
    """
    per = answers.groupBy("uid").agg(F.collect_list("refs").alias(name))
    return beside(blocks, scratch.save(per, name))


def beside(blocks: DataFrame, more: DataFrame) -> DataFrame:
    """The blocks with the columns of ``more`` (unique by uid), which are brought to their buckets."""
    return blocks.join(more.hint("shuffle_hash"), "uid", "left")


def copies(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, copies): places in the block of documents whose whole text has a copy with a smaller id."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids = np.frombuffer(row["ids"], np.int64)
            d = [row["digests"][i * 32 : i * 32 + 32] for i in range(len(ids))]
            yield pa.RecordBatch.from_pydict({"uid": pa.array([row["uid"]] * len(ids), pa.int64()), "at": pa.array(range(len(ids)), pa.int32()), "id": pa.array(ids), "digest": pa.array(d, pa.binary())})

    heads = blocks.select("uid", "ids", "digests").mapInArrow(headers, "uid long, at int, id long, digest binary")
    first = heads.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # Unique by digest, and read from a table: the rows of a hot digest can be split at run time.
    later = heads.join(scratch.save(first, "first"), "digest").where("id > first")
    return scratch.save(later.groupBy("uid").agg(F.sort_array(F.collect_list("at")).alias("copies")), "copies")


class Packed:
    """The blocks of a table of documents, bucketed; ``close`` removes them with all that was written beside them."""

    def __init__(self, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, block_bytes: int):
        self.spark, self.scratch = docs.sparkSession, scratch
        self.name = f"spark_catalog.default.rollstore_blocks_{uuid.uuid4().hex}"
        # No fewer than a shuffle has, or the planner would prefer to shuffle the blocks.
        buckets = min(100_000, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = pack(docs, id_col, text_col, block_bytes, buckets)
        blocks.write.format("parquet").option("compression", "none").option("path", scratch.path("blocks")).bucketBy(buckets, "uid").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def close(self, result: DataFrame) -> DataFrame:
        out = self.scratch.finish(result, "blocks")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return out
