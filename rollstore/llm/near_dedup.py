"""Near-duplicate detection with HyperMinHash signatures.

Each document becomes its set of five-word shingles and a signature: the shingle hashes
fall into buckets, and a bucket keeps of its least hash the number of leading zeros and a
few mantissa bits (16 bits a register).  An empty bucket borrows the register of another
by a fixed probe order, so that short texts fill all of them alike.  Bands of registers
propose pairs; the registers' agreement, corrected for chance collisions of compressed
registers, estimates the Jaccard similarity; pairs that may reach the threshold are
confirmed on the full sets.

Work is bounded where many documents share a band.  Documents with equal sets are one
class from the start.  In a band bucket every class is first compared with the bucket's
most popular class (the one with most company over all its buckets), which of a group of
near copies is the text that they were made from; links found that way make components.
What is left are buckets whose classes are still in different components.  There, pairs
of different components are compared by parity sketches: bit i of a sketch tells whether
an odd number of the set's hashes fall on i, so the sketches of two sets differ in no more
bits than the sets differ in shingles.  A pair whose sketches differ in more bits than a
link allows is no link.  That bound is exact, so no link between different texts is lost,
and thousands of texts that differ from one in a few places each, too many for links
among them, make few pairs: comparing two is a few machine words, inside the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import mixed, word_hashes
from .common import Scratch, slices, text_or_empty, utf8
from .rows import Rows

#: Words in a shingle.
SHINGLE = 5
#: Registers of a signature, and how they are banded: 42 bands of 6.
REGISTERS, BAND = 256, 6
#: Bits of a register: leading zeros (up to 63) and mantissa.
MANTISSA_BITS = 10
#: Standard errors below the threshold at which a pair is no longer confirmed.
SLACK = 6.0
#: 64-bit words of a parity sketch.
PARITY = 16
#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = [np.uint64(int(x)) for x in np.random.default_rng(5).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Of each document: the sorted distinct 64-bit hashes of its shingles; with fewer words, of its whole sequence."""
    words, _, _, doc = word_hashes(_LOWER[raw], offsets)
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    counts = np.diff(edges)
    full = np.zeros(0, np.uint64)
    if len(words) >= size:
        full = words[: len(words) - size + 1] * _PLACE[0]
        for k in range(1, size):
            full = full + words[k : len(words) - size + 1 + k] * _PLACE[k]
        full = mixed(full)
    out = []
    for a, n in zip(edges[:-1].tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(full[a : a + n - size + 1]))
        elif n:
            some = np.array([n], np.uint64)
            for k in range(n):
                some = some + words[a + k : a + k + 1] * _PLACE[k]
            out.append(mixed(some))
        else:
            out.append(full[:0])
    return out


def _probes() -> np.ndarray:
    """For each bucket, the order in which it looks for a filled one."""
    rng = np.random.default_rng(17)
    return np.stack([np.concatenate([[i], rng.permutation(np.delete(np.arange(REGISTERS), i))]) for i in range(REGISTERS)])


_PROBES = _probes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """The registers of a non-empty sorted set of hashes."""
    bits = REGISTERS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    # In a sorted set the first hash of a bucket is its least.
    rest = (hashes[first] << np.uint64(bits)) | np.uint64((1 << bits) - 1)
    zeros = 63 - np.floor(np.log2(np.maximum(rest, np.uint64(1)).astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    register = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    filled = np.zeros(REGISTERS, bool)
    filled[bucket[first]] = True
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = register
    if len(first) < REGISTERS:
        empty = np.flatnonzero(~filled)
        source = _PROBES[empty, filled[_PROBES[empty]].argmax(axis=1)]
        # A borrowed register says whose it is, or two buckets with one source would count twice as chance.
        out[empty] = out[source]
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of hashes, as words: of how many hashes fall on each bit, the last binary digit."""
    odd = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def differing_bits(x: str, y: str) -> Column:
    """In how many bits the sketches in the columns of two sides differ: at most as many as their sets differ in shingles."""
    out = F.bit_count(F.col(f"{x}0").bitwiseXOR(F.col(f"{y}0")))
    for i in range(1, PARITY):
        out = out + F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}")))
    return out


def chance_collision() -> float:
    """The probability that two unequal registers agree: equal zeros, then equal mantissa."""
    return sum(0.25 ** (z + 1) for z in range(64)) / (1 << MANTISSA_BITS)


def least_agreement(threshold: float, n: np.ndarray) -> np.ndarray:
    """The fewest agreeing registers that may come from the threshold, if ``n`` of them are independent."""
    c = chance_collision()
    p = threshold + (1 - threshold) * c
    return np.floor(REGISTERS * (p - SLACK * np.sqrt(p * (1 - p) / np.maximum(1, n))))


def bands() -> list[tuple[int, int]]:
    return [(i, i + BAND) for i in range(0, REGISTERS - BAND + 1, BAND)]


SKETCH = "_id long, file long, row long, n_shingles long, digest binary, signature binary, " + ", ".join(f"p{i} long" for i in range(PARITY))


def sketches(src: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t", CHUNK_BYTES):
            sets = shingle_sets(*utf8(batch.column("_t")))
            bits = np.stack([parity(s) for s in sets])
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id"), "file": batch.column("file"), "row": batch.column("row"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "signature": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            } | {f"p{i}": pa.array(bits[:, i]) for i in range(PARITY)})

    return src.mapInArrow(run, SKETCH)


def band_rows(classes: DataFrame) -> DataFrame:
    """(rep, band key) for each band; the key holds the band's number and the bytes of its registers, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, REGISTERS).astype(np.uint64)
            keys = []
            for n, (a, b) in enumerate(bands()):
                h = np.full(len(sig), np.uint64(n + 1))
                for k in range(a, b):
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                keys.append(h)
            reps = batch.column("rep").to_numpy()
            for at in range(0, len(keys), 6):
                some = keys[at : at + 6]
                yield pa.RecordBatch.from_pydict({"rep": pa.array(np.tile(reps, len(some))), "key": pa.array(np.concatenate(some).view(np.int64))})

    return classes.select("rep", "signature").mapInArrow(run, "rep long, key long")


def promising(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of pairs with both signatures whose estimated similarity may reach the threshold.

    Short texts have fewer independent registers than buckets, and are let through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            same = (x == y).sum(axis=1)
            # Registers that small sets have filled themselves are the independent ones.
            own = REGISTERS * -np.expm1(-np.minimum(na, nb) / REGISTERS)
            least = least_agreement(threshold, own)
            # Sets whose sizes are too far apart can't reach the threshold.
            ok = (same >= least) & (np.minimum(na, nb) >= np.ceil(threshold * np.maximum(na, nb) - 1e-9))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(ok)), "b": batch.column("b").filter(pa.array(ok))})

    return pairs.mapInArrow(run, "a long, b long")


class NearDuplicates:
    """The steps over one table of documents.  Rows with one id are one node: linked if any of their texts is."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, located: Rows | None = None):
        self.spark = docs.sparkSession
        self.percent = percent
        self.scratch = Scratch(self.spark, "near")
        self.id_col, self.text_col, self.rows = id_col, text_col, Rows(docs, self.scratch) if located is None else located
        self.sketches = self.scratch.save(sketches(self.texts(self.rows.df, *self.rows.place())), "sketches")
        full = self.sketches.where("digest is not null and _id is not null")
        self.classes = self.scratch.save(full.groupBy("digest").agg(F.min("_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), *(F.first(f"p{i}").alias(f"p{i}") for i in range(PARITY))), "classes")
        banded = band_rows(self.classes)
        shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        # A class has a key once: the band's number is in it.  Only an id with several texts may have it twice.
        buckets = banded.join(shared, "key")
        self.buckets = self.scratch.save(buckets.distinct() if self.repeated_ids() else buckets, "buckets")

    def texts(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(F.col(self.id_col).cast("long").alias("_id"), *more, text_or_empty(self.text_col).alias("_t"))

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """The distinct pairs (a, b) of classes that reach the threshold on their full sets."""
        percent = self.percent
        of = self.classes.select(F.col("rep"), "signature", "n")
        sides = [of.select(F.col("rep").alias(k), F.col("signature").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab"]
        likely = self.scratch.save(promising(pairs.distinct().join(sides[0], "a").join(sides[1], "b"), self.percent / 100), f"{name}-likely")
        wanted = self.scratch.save(likely.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), f"{name}-wanted")
        one = self.scratch.save(self.sets(wanted, f"{name}-texts"), f"{name}-sets")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keep = []
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                    u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    both = np.sort(np.concatenate([u, v]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)})

        with_sets = likely.join(one.select(F.col("_id").alias("a"), F.col("set").alias("sa")), "a").join(one.select(F.col("_id").alias("b"), F.col("set").alias("sb")), "b")
        out = self.scratch.save(with_sets.mapInArrow(check, "a long, b long").distinct(), name)
        self.scratch.drop(f"{name}-sets", f"{name}-likely", f"{name}-wanted", f"{name}-texts", f"{name}-texts-masks")
        return out

    def repeated_ids(self) -> bool:
        if not hasattr(self, "_repeated"):
            self._repeated = bool(self.sketches.groupBy("_id").count().where("count > 1").limit(1).count())
        return self._repeated

    def components(self, edges: DataFrame) -> DataFrame:
        """(rep, component): smallest class reachable, for the classes in ``edges`` (and itself for others)."""
        labels = connected(edges, self.scratch)
        return self.classes.select("rep").distinct().join(labels, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """(_id, digest, set) of the documents whose ids are in ``wanted`` (_id); read where the documents lie."""
        chosen = self.sketches.select("_id", "file", "row").join(wanted, "_id", "left_semi").select("file", "row", F.lit(1).alias("value"))
        texts = self.rows.decided(chosen, lambda df, v: self.texts(df.where(F.col(v) == 1)), name=name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_t", CHUNK_BYTES):
                found = shingle_sets(*utf8(batch.column("_t")))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "digest": pa.array(digests, pa.binary()), "set": pa.array([s.tobytes() for s in found], pa.binary())})

        full = texts.mapInArrow(run, "_id long, digest binary, set binary")
        return full.dropDuplicates(["_id", "digest"]) if self.repeated_ids() else full

    def run(self) -> DataFrame:
        """(rep, component) of every class."""
        popular = self.buckets.groupBy("rep").agg(F.sum("size").alias("company"))
        centre = self.buckets.join(popular, "rep").groupBy("key").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("centre"))
        star = self.buckets.join(centre, "key").where("rep != centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b"))
        links = self.confirmed(star, "star")
        if links.isEmpty() and self.buckets.isEmpty():
            return self.classes.select("rep", F.col("rep").alias("component")).distinct()
        label = self.scratch.save(self.components(links), "label-star")
        # Buckets whose classes are in one component need nothing more.
        placed = self.buckets.select("key", "rep").join(label, "rep")
        mixed_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
        left = self.scratch.save(placed.join(mixed_keys, "key"), "left")
        if left.isEmpty():
            return label
        left = left.join(self.classes.select("rep", "n", *(f"p{i}" for i in range(PARITY))), "rep")
        x, y = (left.select("key", *(F.col(c).alias(k + c) for c in ("rep", "component", "n")), *(F.col(f"p{i}").alias(f"{k}{i}") for i in range(PARITY))) for k in "xy")
        # Sets of n and m shingles are linked if they share at least (n + m) p / (100 + p).
        apart = F.expr(f"xn + yn - 2 * ceil((xn + yn) * {self.percent} / {100 + self.percent} - 1e-9)")
        near = F.expr(f"xcomponent < ycomponent and 100 * least(xn, yn) >= {self.percent} * greatest(xn, yn)") & (differing_bits("x", "y") <= apart)
        across = x.join(y, (x["key"] == y["key"]) & near).select(F.least("xrep", "yrep").alias("a"), F.greatest("xrep", "yrep").alias("b"))
        more = self.confirmed(across, "across")
        if more.isEmpty():
            return label
        return self.scratch.save(self.components(links.unionByName(more)), "label")


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, component) of the nodes of ``edges`` (a, b): each gets its component's least.

    Rounds of the two-step star contraction: every node's larger neighbours are hung on its
    least neighbour, then smaller ones on the node's least.  Degrees shrink to stars in a
    logarithmic number of rounds; only edges are shuffled, and each round is written.
    """
    edges = scratch.save(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-0")
    done, turn = edges.isEmpty(), 0
    while not done:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        turn += 1
        after = scratch.save(small, f"cc-{turn}")
        # A star forest does not change any more: every node hangs on one root, which hangs on none.
        done = not after.groupBy("b").count().where("count > 1").limit(1).count() and not after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        scratch.drop(f"cc-{turn - 1}")
        edges = after
    roots = edges.select(F.col("a").alias("rep"), F.col("a").alias("component")).distinct()
    return roots.unionByName(edges.select(F.col("b").alias("rep"), F.col("a").alias("component")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 85, places: bool = False, located: Rows | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    ``places`` adds file and row, as ``Rows`` has them: those of ``located``, if ``docs`` is its table.

    Texts are lower-cased (A-Z) and cut into words at 0x20 and 0x09-0x0D; two documents are
    linked if their sets of five-word shingles share at least ``percent`` of their union, by
    exact count over 64-bit hashes.  component_id is the smallest id reachable by links, the
    document's own included; kept marks the document that has it.  A text with fewer than
    five words is one shingle; without words, or null, it is linked with nothing.  Rows with
    a null id are linked with nothing and kept.  Rows repeated with one id count as
    one document, and each is returned.  An empty table gives no rows; other columns are ignored.
    """
    near = NearDuplicates(docs, id_col, text_col, percent, located)
    member = near.classes.join(near.run(), "rep").select("digest", "component")
    rows = near.sketches.select("_id", "n_shingles", "digest", "file", "row").join(member, "digest", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    place = [F.col(c).alias(f"_{c}") for c in ("file", "row")] if places else []
    found = rows.select("_id", "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), *place)
    out = near.scratch.finish(found)
    return out.withColumnRenamed("_id", id_col).withColumnsRenamed({"_file": "file", "_row": "row"})


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
