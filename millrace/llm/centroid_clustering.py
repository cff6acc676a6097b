"""Centroid clustering in exact integers, with a pivot table that spares distances.

Vectors become integers once. Their distances to a few fixed pivots are stored with
them, also once. In every round the distances of the centroids to the same pivots are
computed, and by the triangle inequality the difference of the two is never more than
the distance between vector and centroid. A vector gets the exact distance to the
centroid with the lowest such bound first, and then only to the centroids whose bound
is not above the best it has. Bounds are doubles, lowered by more than their error, so
none decides a tie or a near tie: those are decided by integers.

A round reads the table, sums the vectors of each centroid in each task, and adds up
these sums; only they (a number for each centroid and component) reach the driver.

Pivots are chosen far apart among the vectors with the smallest hashes, of which at
most ``sample`` go to the driver: they influence how much is spared, never a result.

Defined cases: vectors that are null, have another number of components or hold a null
or non-finite one are left out; repeated rows count each on its own; a null key hashes
as the empty string; vectors with equal hashes are started with in the order of their
components; with fewer vectors than centroids, every vector starts one; an empty table
gives no rows; other columns are not read. A component beyond 2**27 in size after
scaling is an error, since squared distances might not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_columns, written

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3:"
PIVOTS, SAMPLE = 8, 256
LARGEST = 2**27
#: By how much a bound is lowered: more than the rounding of distances up to 2**31.
MARGIN, RELATIVE = 1e-5, 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers to one vector, or row by row, exactly."""
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(vectors, p) for p in pivots], axis=1).astype(np.float64))


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """The first vector, and then each time the one whose nearest chosen one is farthest."""
    chosen = [0]
    nearest = squared(vectors, vectors[0])
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(vectors, vectors[chosen[-1]]))
    return vectors[chosen]


def nearest(vectors: np.ndarray, known: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, the smaller number of equals, and how many exact
    distances it took. ``known`` and ``of_centroids`` are the distances to the pivots."""
    bounds = np.stack([np.abs(known - c).max(axis=1) for c in of_centroids], axis=1) * (1 - RELATIVE) - MARGIN
    best = bounds.argmin(axis=1)
    distance = squared(vectors, centroids[best])
    first, exact = best.copy(), len(vectors)
    for n in range(len(centroids)):
        rows = np.flatnonzero((first != n) & (bounds[:, n] <= np.sqrt(distance.astype(np.float64))))
        further = squared(vectors[rows], centroids[n])
        exact += len(rows)
        better = (further < distance[rows]) | ((further == distance[rows]) & (n < best[rows]))
        best[rows[better]], distance[rows[better]] = n, further[better]
    return best, distance, exact


def fixed_width(column: pa.Array, kind, width: int) -> np.ndarray:
    """A column of binary values of one length as rows of numbers."""
    size = np.dtype(kind).itemsize * width
    column = column.cast(pa.binary(size))
    return np.frombuffer(column.buffers()[1], np.uint8, len(column) * size, column.offset * size).view(kind).reshape(-1, width)


def whole_numbers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    values = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ArithmeticError(f"a component is beyond {LARGEST} after scaling")
    return values.astype(np.int64).reshape(-1, dim)


TABLE = pa.schema([("vec_id", pa.int64()), ("q", pa.binary()), ("known", pa.binary())])
PARTIAL = pa.schema([("cluster", pa.int32()), ("position", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
Batches = Iterator[pa.RecordBatch]


def _pivot_table(pivots: np.ndarray, dim: int, scale: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                vectors = whole_numbers(batch.column(1), dim, scale)
                rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (vectors.astype(np.int32), to_pivots(vectors, pivots))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *rows], schema=TABLE)

    return run


@dataclass
class Centroids:
    """The centroids of a round, and their distances to the pivots."""

    values: np.ndarray
    pivots: np.ndarray

    def assign(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of a batch of the table, their centroids and squared distances."""
        vectors = fixed_width(batch.column("q"), np.int32, self.values.shape[1]).astype(np.int64)
        known = fixed_width(batch.column("known"), np.float64, len(self.pivots))
        return vectors, *nearest(vectors, known, self.values, to_pivots(self.values, self.pivots))[:2]

    def sums(self, batches: Batches) -> Batches:
        """For each centroid and component the sum over the task's vectors, and their number."""
        total, count = np.zeros_like(self.values), np.zeros(len(self.values), np.int64)
        for batch in batches:
            vectors, cluster, _ = self.assign(batch)
            for n in np.unique(cluster):
                total[n] += vectors[cluster == n].sum(axis=0)
                count[n] += (cluster == n).sum()
        k, dim = self.values.shape
        cluster, position = np.repeat(np.arange(k, dtype=np.int32), dim), np.tile(np.arange(dim, dtype=np.int32), k)
        used = np.repeat(count, dim) > 0
        columns = (cluster, position, total.ravel(), np.repeat(count, dim))
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], schema=PARTIAL)

    def rows(self, batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                _, cluster, distance = self.assign(batch)
                columns = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, schema=ASSIGNED)

    def moved(self, table: DataFrame) -> Centroids:
        """Every centroid at the floor of its vectors' mean; those without vectors stay."""
        partial = table.mapInArrow(self.sums, "cluster int, position int, total long, n long")
        sums = partial.groupBy("cluster", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        values = self.values.copy()
        for cluster, position, total, n in sums.collect():  # a row for each centroid and component
            values[cluster, position] = total // n
        return Centroids(values, self.pivots)

    def names(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.values.tolist()]


def usable(embedding: Column, dim: int) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dim) & finite, F.lit(False))


def clustered(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED,
    pivots: int = PIVOTS, sample: int = SAMPLE, key: str = "vec_id", embedding: str = "embedding",
) -> tuple[DataFrame, Centroids]:
    """((vec_id, cluster, distance) of all vectors, the final centroids). The frame is a written table."""
    kept = own_columns(vectors, vec_id=key, embedding=embedding).filter(usable(F.col("embedding"), dim))
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    lowest = kept.select(hashed.alias("hash"), "embedding").orderBy("hash", "embedding").limit(max(sample, centroids)).toArrow()
    first = whole_numbers(lowest.column("embedding").combine_chunks(), dim, scale)
    if not len(first):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), Centroids(first, first)
    found = Centroids(first[:centroids], far_apart(first, pivots))
    table = written(kept.mapInArrow(_pivot_table(found.pivots, dim, scale), "vec_id long, q binary, known binary"), "pivot-table")
    for _ in range(rounds):
        found = found.moved(table)
    return written(table.mapInArrow(found.rows, "vec_id long, cluster int, distance long"), "assigned"), found


def digest(vectors: DataFrame) -> DataFrame:
    rows, centroids = clustered(vectors)
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = dict(map(tuple, sums.collect()))  # a row for each centroid
    total = sum(per_cluster.values())
    spark = vectors.sparkSession
    facts = spark.createDataFrame(
        [(n, per_cluster.get(n, 0), total, name) for n, name in enumerate(centroids.names())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
