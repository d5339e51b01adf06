"""Approximate nearest neighbours by query-aware, collision-counting hashing.

Each block of vectors keeps one sorted array a projection (Huang, Feng, Zhang, Fang and Ng, "Query-Aware
Locality-Sensitive Hashing", 2015). A query's window on each array is centred on its own projection, as wide as the
radius on each side, and widened by virtual rehashing: radius R, then `growth` * R, and so on, each time reading only
what the window gains. A vector at distance R collides on a projection with a probability of 0.683, so it is verified,
on the original vectors, once it has collided on as many projections as it does but for `misses` deviations. The radius
never grows beyond the k-th verified distance, or the k-th that is known from elsewhere: nothing beyond is sought.

1. Bounds. The queries are first searched in one index of a bounded sample: the k-th distance there is no smaller than
   the true one, and limits the radius in every block.
2. Blocks. Vectors are dealt to blocks by a hash of their id, each block to a task of its own. A block's rows come before
   the queries, so that its index is built once and the queries stream by in batches; vectors are never copied, and a
   block gives at most k rows a query.
3. The nearest of all blocks are ranked.

Cases: vectors that are null, zero or hold null or non-finite components, and rows of null id, take no part; vectors
are compared with those of their own dimension only; ties go to the smaller id; repeated ids are candidates for other
queries, once a row, and a repeated query id is one query, that of the least vector; fewer than k candidates give fewer
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import read_table

#: Of a normal variable's values, the share within one deviation: how often a vector collides at the radius itself.
AT_RADIUS = 0.6827


@dataclass(frozen=True)
class Settings:
    projections: int = 160
    misses: float = 1.2  # deviations by which a vector at the radius may collide less often than it should
    growth: float = 1.2
    levels: int = 5  # radii before the one that the bound gives
    first_levels: int = 15  # radii before the widest, where there is no bound
    block_rows: int = 16_384
    sample_rows: int = 8192
    seed: int = 17

    @property
    def need(self) -> int:
        mean = AT_RADIUS * self.projections
        return max(1, int(np.ceil(mean - self.misses * (mean * (1 - AT_RADIUS)) ** 0.5)))


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((vectors - query) ** 2).sum(axis=1))


class Index:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, s: Settings = Settings()):
        self.ids, self.vectors, self.s, self.verified = ids, vectors, s, 0
        self.lines = np.random.default_rng(s.seed).standard_normal((vectors.shape[1], s.projections))
        with np.errstate(over="ignore", invalid="ignore"):
            values = vectors @ self.lines
        # arrays one after the other, each moved beyond the one before, so that one search finds the ends of all windows
        self.apart = 4 * float(np.abs(values).max(initial=1.0))
        self.sound = bool(np.isfinite(values).all()) and self.apart < 1e100
        if self.sound:
            self.order = np.argsort(values, axis=0, kind="stable").T.copy()
            self.moved = np.arange(s.projections) * self.apart
            self.sorted = (np.take_along_axis(values.T, self.order, axis=1) + self.moved[:, None]).ravel()

    def nearest(self, query: np.ndarray, own: int | None, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest, nearest first; those beyond the bound may be missing."""
        n, s = len(self.ids), self.s
        with np.errstate(over="ignore", invalid="ignore"):
            at = query @ self.lines if self.sound else np.array([np.inf])
        others = self.ids != own
        if others.sum() <= k or not np.isfinite(at).all() or np.abs(at).max() > self.apart / 4:
            rows = np.flatnonzero(others)
            dist = distances(self.vectors[rows], query)
        else:
            rows, dist = self.collided(query, at, others, k, bound)
        self.verified += len(rows)
        if rows.size > k:  # all that tie with the k-th stay until ids decide
            few = dist <= np.partition(dist, k - 1)[k - 1]
            rows, dist = rows[few], dist[few]
        best = np.lexsort((self.ids[rows], dist))[:k]
        return self.ids[rows[best]], dist[best]

    def collided(self, query: np.ndarray, at: np.ndarray, left: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that collide often enough, up to the radius at which k are known, and their distances."""
        n, s = len(self.ids), self.s
        counts, left = np.zeros(n, np.int64), left.copy()
        at = at + self.moved
        base = np.arange(s.projections) * n
        lo = hi = None
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        least = self.apart * 1e-9
        kth = bound if np.isfinite(bound) else self.apart / 4  # no value lies beyond
        radius = max(least, kth / s.growth ** (s.levels if np.isfinite(bound) else s.first_levels))
        while True:
            reach = min(radius, self.apart / 3)
            a, b = (np.clip(x - base, 0, n) for x in (np.searchsorted(self.sorted, at - reach), np.searchsorted(self.sorted, at + reach, side="right")))
            if lo is None:
                lo = hi = a
            gained = []
            for order, a0, lo0, hi0, b0 in zip(self.order, a.tolist(), lo.tolist(), hi.tolist(), b.tolist(), strict=True):
                gained += [order[a0:lo0], order[hi0:b0]]
            counts += np.bincount(np.concatenate(gained), minlength=n)
            lo, hi = a, b
            fresh = np.flatnonzero((counts >= s.need) & left)
            if fresh.size:
                left[fresh] = False
                rows, dist = np.concatenate([rows, fresh]), np.concatenate([dist, distances(self.vectors[fresh], query)])
                if len(rows) >= k:
                    kth = min(kth, float(np.partition(dist, k - 1)[k - 1]))
            if (hi - lo == n).all() or radius >= kth and (len(rows) >= k or radius >= bound):
                return rows, dist
            radius = max(least, min(radius * s.growth, kth)) if radius < kth else radius * s.growth


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """vectors and queries: id, v (array of numbers). Returns query_id, rank, vec_id and score."""

    def taken(df: DataFrame) -> DataFrame:
        df = df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        return df.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    rows, asked = taken(vectors), taken(queries).groupBy("id").agg(F.min_by("v", F.struct("dim", "v")).alias("v")).withColumn("dim", F.size("v"))
    n = rows.count()
    n_blocks = max(1, -(-n // s.block_rows))
    sample: dict[int, tuple[list, list]] = {}
    for r in rows.orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(s.sample_rows).collect():
        own = sample.setdefault(r["dim"], ([], []))
        own[0].append(r["id"])
        own[1].append(r["v"])
    known = {dim: (np.array(ids), np.array(v)) for dim, (ids, v) in sample.items()}

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = {}
        for batch in batches:
            bounds = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                v = np.array(v.as_py())
                if (dim := len(v)) in known and dim not in indexes:
                    indexes[dim] = Index(*known[dim], s)
                dist = indexes[dim].nearest(v, i, k)[1] if dim in indexes else ()
                bounds.append(float(dist[-1]) if len(dist) == k else float("inf"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.float64())], names=[*batch.schema.names, "bound"])

    asked = asked.select("id", "v", "dim").mapInArrow(bounded, "id long, v array<double>, dim int, bound double")
    left = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("asks", F.lit(1))
    right = rows.withColumns({"bound": F.lit(0.0), "b": F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n_blocks)).cast("int"), "asks": F.lit(0)})
    names = ["dim", "b", "asks", "id", "v", "bound"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, ids, parts = None, None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                dim, b, asks = keys[lo].tolist()
                if (dim, b) != now:
                    now, index, ids, parts = (dim, b), None, [], []
                own, v = batch.column(3)[lo:hi].to_numpy(), matrix(batch.column(4)[lo:hi])
                if not asks:
                    ids.append(own)
                    parts.append(v)
                    continue
                if index is None and ids:
                    index, ids, parts = Index(np.concatenate(ids), np.concatenate(parts), s), [], []
                if index is None:  # no row of this dimension is in the block
                    continue
                found = [index.nearest(x, i, k, bound) for x, i, bound in zip(v, own.tolist(), batch.column(5)[lo:hi].to_pylist(), strict=True)]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

    every = right.select(names).unionByName(left.select(names)).repartitionById(n_blocks, "b").sortWithinPartitions("dim", "b", "asks")
    near = every.mapInArrow(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(rows, rows.filter(F.col("id") % 100 == 0))
