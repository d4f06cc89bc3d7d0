"""Approximate nearest neighbours by collision counting with query-centred windows.

Every hash function is one projection; the projections are random orthonormal bases, whose
counts vary less than those of independent directions.  The vectors lie in blocks; a block
keeps its vectors sorted by each projection.  Around a query's own projection a window
opens in each sorted array; at each level it is widened by virtual rehashing (the same
arrays, a larger radius), and a vector collides once for each projection whose window
reaches it.  A distance is computed only for vectors whose collisions have passed the
threshold.  The threshold is high: at a high one, near and far vectors differ most in
their collisions.  The windows are wide then, so what they leave out is counted at first.  The search of a block ends when the k-th best distance so far, also in blocks
before, lies within the radius that the windows then stand for, or when as many vectors
were verified as the budget allows.

Queries are a stated set.  They are taken in groups of a bounded size, each of which is
sent to the tasks and meets every block there; the blocks are packed and written once, and
no vector is copied.  A task keeps the k best of each query over all its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Projections, and the share of them that must collide.
PROJECTIONS, SHARE = 128, 0.85
#: Half width of a window at radius 1, in standard deviations of the projection of a unit distance; ratio of radii.
WIDTH, RATIO = 1.5, 1.02
#: Share of a block's vectors that are verified before a search ends in any case, and the fewest such, beside k.
BUDGET, FEWEST = 0.03, 64
#: Where the radius of a search starts: this share of what earlier searches of the block ended at.
START = 0.92
#: Vectors in a block; bytes of queries in a group.
BLOCK_ROWS, GROUP_BYTES = 4096, 16 << 20


def projections(dims: int, count: int = PROJECTIONS, seed: int = 3) -> np.ndarray:
    """Unit directions, as columns: as many random orthonormal bases as it takes."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-count // dims))]
    return np.concatenate(bases, axis=1)[:, :count]


class Index:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, count: int = PROJECTIONS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n = len(ids)
        self.axes = projections(vectors.shape[1], count)
        projected = self.vectors @ self.axes
        # All sorted arrays in one, each lifted above the one before, so that one search serves all.
        self.reach = float(np.abs(projected).max(initial=1.0))
        self.lift = np.arange(count) * (4 * self.reach)
        order = np.argsort(projected, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T).ravel()
        self.sorted = (np.take_along_axis(projected, order, axis=0) + self.lift).T.ravel()
        self.first, self.last = np.arange(count) * n, np.arange(1, count + 1) * n
        spread = float(np.sqrt(self.vectors.var(axis=0).sum()))
        self.start = 0.5 * spread if spread > 0 else 1.0
        #: Vectors whose distance was computed, and searches.
        self.verified = self.searches = 0

    def search(self, query_id: int, query: np.ndarray, k: int, bound: float = np.inf, share: float = SHARE, budget: float = BUDGET) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found to the query but itself, nearest first, ties to the smaller id; those beyond ``bound`` may lack."""
        n, m = len(self.ids), len(self.first)
        need, enough = int(np.ceil(share * m)), k + max(FEWEST, int(budget * n))
        at = query @ self.axes
        # Collisions; all of the first level's, less those that its windows leave out.
        hits = np.full(n, m)
        fresh = np.ones(n, bool)
        fresh[np.searchsorted(self.ids, query_id, "left") : np.searchsorted(self.ids, query_id, "right")] = False
        least = int(fresh.sum())
        rows, squares, done = [np.zeros(0, np.int64)], [np.zeros(0)], 0
        lo, hi = self.first, self.last
        radius = first_radius = self.start
        self.searches += 1
        while True:
            half = WIDTH * radius / np.sqrt(len(query))
            a, b = self._edge(at - half, "left"), self._edge(at + half, "right")
            if radius == first_radius:
                hits -= self._count(lo, a) + self._count(b, hi)
            else:
                hits += self._count(a, lo) + self._count(hi, b)
            lo, hi = a, b
            new = np.flatnonzero(fresh & (hits >= need))
            if len(new):
                fresh[new] = False
                d = self.vectors[new] - query
                rows.append(new)
                squares.append(np.einsum("ij,ij->i", d, d))
                done += len(new)
            worst = bound
            if done >= k:
                found = np.concatenate(squares)
                worst = min(bound, float(np.sqrt(np.partition(found, k - 1)[k - 1])))
            if worst <= radius or done >= min(enough, least) or (lo == self.first).all() and (hi == self.last).all():
                break
            radius *= RATIO
        self.verified += done
        # The next search starts near the radius at which searches end here.
        self.start += (START * radius - self.start) / min(self.searches, 16)
        return self._best(np.concatenate(rows), query, k)

    def _count(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each vector is in the given strips of the sorted arrays, one a projection."""
        strips = [self.order[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True) if y > x]
        return np.bincount(np.concatenate(strips), minlength=len(self.ids)) if strips else np.zeros(len(self.ids), np.int64)

    def _edge(self, values: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self.sorted, np.clip(values, -1.5 * self.reach, 1.5 * self.reach) + self.lift, side)

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        d = self.vectors[rows] - query
        dist = np.sqrt((d * d).sum(axis=1))
        order = np.lexsort((self.ids[rows], dist))[:k]
        return self.ids[rows][order], dist[order]


def best_of(found: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, dist = np.concatenate([found[0], more[0]]), np.concatenate([found[1], more[1]])
    order = np.lexsort((ids, dist))[:k]
    return ids[order], dist[order]


BLOCK = "ids binary, vectors binary, dims int"


def packed(vectors: DataFrame, scratch: Scratch, block_rows: int) -> DataFrame:
    """The vectors as blocks of one dimension each, written once, some files with few blocks each."""

    def pack(table: pa.Table) -> pa.Table:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        return pa.table({"ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary()), "dims": pa.array([len(flat) // len(ids)], pa.int32())})

    n = max(1, -(-vectors.count() // block_rows))
    # By id and vector: rows of one id, or copies of one vector, are spread.
    part = F.pmod(F.xxhash64("id", "v"), F.lit(n)).alias("part")
    blocks = vectors.groupBy(part, F.size("v").alias("dims")).applyInArrow(pack, BLOCK)
    path = scratch.path("blocks")
    blocks.write.option("maxRecordsPerFile", max(1, n // 4096)).parquet(path)
    return vectors.sparkSession.read.schema(BLOCK).parquet(path)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 10,
    block_rows: int = BLOCK_ROWS,
    group_bytes: int = GROUP_BYTES,
    share: float = SHARE,
    budget: float = BUDGET,
) -> DataFrame:
    """For each query its ``k`` nearest found: query_id, rank (from 1), ``id_col``, score.

    The measure is Euclidean distance in double precision on the original vectors; a query
    is no neighbour of itself (of its id), and ties go to the smaller id.  If there are fewer
    than ``k`` candidates, all are given.  Vectors that are null, empty, zero, or hold a null,
    NaN or infinity take no part, nor do rows with a null id.  Rows repeated with one id and
    vector count once.  Vectors of different dimensions don't meet.  Empty tables give no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        return df.where(fine).dropDuplicates(["id", "v"])

    blocks = packed(clean(vectors), scratch, block_rows)
    asked = scratch.save(clean(queries).withColumn("bytes", F.size("v") * 8 + 16), "queries")
    groups = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // (group_bytes // 2)))
    result = "query_id long, id long, score double"
    for g in range(groups):
        # At most about group_bytes: the hash deals evenly, and half as much is aimed at.
        group = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(groups)) == g).select("id", "v").toArrow()
        ids, lists = group.column("id").to_numpy(), group.column("v").to_pylist()
        sizes = np.array([len(v) for v in lists], np.int64)
        by_dims = {int(d): (ids[sizes == d], np.array([v for v in lists if len(v) == d])) for d in np.unique(sizes)}

        def search(batches: Iterator[pa.RecordBatch], by_dims: dict = by_dims) -> Iterator[pa.RecordBatch]:
            none = (np.zeros(0, np.int64), np.zeros(0))
            best = {d: [none] * len(q[0]) for d, q in by_dims.items()}
            for batch in batches:
                for row in batch.to_pylist():
                    d = row["dims"]
                    if d not in by_dims:
                        continue
                    index = Index(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, d))
                    for i, (query_id, query) in enumerate(zip(*by_dims[d], strict=True)):
                        bound = best[d][i][1][k - 1] if len(best[d][i][1]) == k else np.inf
                        best[d][i] = best_of(best[d][i], index.search(int(query_id), query, k, bound, share, budget), k)
            for d, found in best.items():
                sizes = [len(x[0]) for x in found]
                columns = (np.repeat(by_dims[d][0], sizes), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])

        scratch.append(blocks.mapInArrow(search, result), "found")
    found = scratch.read("found").dropDuplicates(["query_id", "id", "score"])
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "id")))
    return scratch.finish(ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("_id"), "score"), "blocks").withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
