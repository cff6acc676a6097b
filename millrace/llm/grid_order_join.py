"""Near-duplicate vectors by an epsilon grid order join.

On unit vectors, a cosine of at least t is a distance of at most
eps = sqrt(2 - 2 t). The vectors are turned to their principal axes, which keeps
distances, and sorted by label and by the cells of a grid of width eps on the
leading axes. The sorted sequence is cut into blocks, each with its bounding box, and
the blocks stand at the bottom of a tree: range partitions above them, intervals of
eight partitions above these, and so on to one root for each label. From the roots
down, intervals are joined with intervals, and a pair goes on to its parts only if the
boxes are not farther apart than eps. So no join has a label for its key, and a pair of
nodes makes at most 64 pairs below the partitions' level. Two blocks are joined in the
same way inside a task, down to intervals of 1,024 vectors. These are screened by a product
in single precision, whose rounding is allowed for; where it leaves a chance, leaves
of 64 vectors are compared in double precision.

A block holds 4 MB of components, so a pair of blocks ships 4 MB to 16,384 squared
comparisons of 64 dimensions. Where boxes prune, the work grows with the vectors and their
neighbours; where they cannot (many dimensions of like width), with the square of a
label's vectors.

Equal vectors of a label are one vector with a count. A pair of blocks emits link
counts and connecting edges, never its pairs. The axes come from the moments of
all vectors, summed in the cluster; they affect the speed only.

Defined cases: vectors that are null, zero, or hold null or non-finite components,
and vectors with a null label, are linked with nothing; vectors of different
length are never linked; rows that repeat a key count like others; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .links import components, spanning_between, spanning_edges
from .shared import Rows, dropped, own_columns, spread, strings, written

THRESHOLD = 0.98
#: Leading principal axes in the sort key.
AXES = 8
LEAF, PARTITION = 64, 32_768
#: Bytes of a block's components, and leaves on a side of a product in single precision.
BLOCK_BYTES, SCREENED = 4 << 20, 16
#: Nodes of the tree of boxes under a node above them.
FAN = 8
#: Slack for rounding when boxes are compared, and the width about the threshold in which a cosine
#: is computed again from the given components.
SLACK, CLOSE = 1e-9, 1e-9


def _units(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _moments(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = _units(np.stack(batch.column(0).to_numpy(zero_copy_only=False)).reshape(-1, dim))
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        i, j = np.divmod(np.arange((dim + 1) ** 2, dtype=np.int32), dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], schema=schema)

    return run


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal axes of the unit vectors of this length, the widest first."""
    sums = vectors.filter(F.col("dim") == dim).select("vector").mapInArrow(_moments(dim), "i int, j int, s double")
    total = np.zeros((dim + 1, dim + 1))
    for row in sums.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (dim + 1) squared rows
        total[row.i, row.j] = row.s
    count = max(total[dim, dim], 1)
    mean = total[dim, :dim] / count
    _, axes = np.linalg.eigh(total[:dim, :dim] / count - np.outer(mean, mean))
    return axes[:, ::-1]


KEYED_COLUMNS = "label string, dim int, cells array<int>, uid long, copies long, vector binary"


def _keyed(axes: np.ndarray, eps: float, stored: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cells", pa.list_(pa.int32())), ("uid", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for label, dim, uid, copies, vector in zip(*(strings(batch.column(c)) for c in range(5)), strict=True):
                raw = np.array(vector, "<f8")
                unit = _units(raw[None, :])
                turned = unit @ axes if dim == len(axes) else unit
                cells = np.floor(turned[0, :AXES] / eps).astype(np.int32)
                yield from out.add((label, dim, cells, uid, copies, raw.astype(stored).tobytes()), 8 * dim + 64)
        yield from out.rest()

    return run


BLOCKS = pa.schema([
    ("label", pa.string()), ("dim", pa.int32()), ("number", pa.int64()), ("lo", pa.list_(pa.float64())),
    ("hi", pa.list_(pa.float64())), ("uids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()),
])
BLOCK_COLUMNS = ("label string, dim int, number long, lo array<double>, hi array<double>, uids binary, "
                 "copies binary, vectors binary")
#: A block's number is that of its partition and its place there, so numbers are in the order of the sequence.
PLACE_BITS = 32


def _turned(raw: np.ndarray, axes: np.ndarray) -> np.ndarray:
    unit = _units(raw)
    return unit @ axes if raw.shape[1] == len(axes) else unit


def _blocks(axes: np.ndarray, stored: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, out = TaskContext.get().partitionId(), 0, Rows(BLOCKS)
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            raw = np.array([np.frombuffer(v, stored) for _, _, v in held])
            turned = _turned(raw.astype("<f8"), axes)
            uids, copies = (np.array([h[k] for h in held], "<i8").tobytes() for k in (0, 1))
            yield from out.add((*key, (part << PLACE_BITS) + block, turned.min(axis=0), turned.max(axis=0), uids, copies, raw.tobytes()), raw.nbytes)

        for batch in batches:
            for label, dim, uid, copies, vector in zip(*(strings(batch.column(c)) for c in ("label", "dim", "uid", "copies", "vector")), strict=True):
                if held and ((label, dim) != key or (len(held) + 1) * len(vector) > max(BLOCK_BYTES, LEAF * len(vector))):
                    yield from close()
                    held, block = [], block + 1
                key = (label, dim)
                held.append((uid, copies, vector))
        if held:
            yield from close()
        yield from out.rest()

    return run


BOX_COLUMNS = "label string, dim int, number long, lo array<double>, hi array<double>"


def _hull(rows: pd.DataFrame) -> pd.DataFrame:
    """The box about the boxes of a node's parts."""
    lo, hi = np.stack(rows.lo.to_list()).min(axis=0), np.stack(rows.hi.to_list()).max(axis=0)
    return pd.DataFrame([(rows.label.iloc[0], rows.dim.iloc[0], rows.up.iloc[0], lo, hi)], columns=["label", "dim", "number", "lo", "hi"])


def box_tree(blocks: DataFrame, parts: int) -> list[DataFrame]:
    """Boxes (label, dim, number, lo, hi, up) by level: blocks, range partitions, intervals of FAN of them
    and so on; the last level has one node for each label. ``up`` is the number of the node above."""
    boxes = blocks.select("label", "dim", "number", "lo", "hi").withColumn("up", F.shiftright("number", PLACE_BITS))
    levels = [written(boxes, "boxes")]
    while True:
        above = levels[-1].groupBy("label", "dim", "up").applyInPandas(_hull, BOX_COLUMNS)
        levels.append(written(above.withColumn("up", F.floor(F.col("number") / FAN)), "boxes"))
        if parts <= 1:
            return levels
        parts = -(-parts // FAN)


def _near(eps: float) -> Column:
    gap = "greatest(0D, a.lo[i] - b.hi[i], b.lo[i] - a.hi[i])"
    distance = f"aggregate(sequence(0, size(a.lo) - 1), 0D, (s, i) -> s + {gap} * {gap})"
    return F.expr(f"{distance} <= {(eps + SLACK) ** 2!r}D")


def block_pairs(blocks: DataFrame, parts: int, eps: float) -> DataFrame:
    """(number_a, number_b): pairs of blocks whose boxes are within eps, each once. ``parts`` is the
    number of range partitions."""
    *below, roots = levels = box_tree(blocks, parts)
    pairs = roots.select("label", "dim", F.col("number").alias("number_a"), F.col("number").alias("number_b"))
    before = []
    for level in reversed(below):
        for side in "ab":
            inner = level.select("label", "dim", F.col("up").alias(f"number_{side}"), F.struct("number", "lo", "hi").alias(side))
            pairs = pairs.join(inner, ["label", "dim", f"number_{side}"])
        pairs = written(pairs.filter(F.expr("a.number <= b.number") & _near(eps)).select(
            "label", "dim", F.col("a.number").alias("number_a"), F.col("b.number").alias("number_b")), "pairs")
        dropped(*before)
        before = [pairs]
    dropped(*levels)
    return pairs.select("number_a", "number_b")


class Sequence:
    """A block in its order, with the boxes of its leaves."""

    def __init__(self, uids: bytes, copies: bytes, vectors: bytes, axes: np.ndarray, stored: str):
        self.uids, self.copies = np.frombuffer(uids, "<i8"), np.frombuffer(copies, "<i8")
        self.raw = np.frombuffer(vectors, stored).astype("<f8").reshape(len(self.uids), -1)
        self.unit = _turned(self.raw, axes)
        self.single = self.unit.astype("<f4")
        starts = np.arange(0, len(self.uids), LEAF)
        self.lo, self.hi = np.minimum.reduceat(self.unit, starts), np.maximum.reduceat(self.unit, starts)

    def rows(self, leaf: int) -> slice:
        return slice(leaf * LEAF, (leaf + 1) * LEAF)


def _screened(a: Sequence, i: int, k: int, b: Sequence, j: int, m: int, threshold: float) -> np.ndarray:
    """Which leaves of two intervals may have a link: a row for each leaf of a, a column for each of b."""
    x, y = a.single[i * LEAF : k * LEAF], b.single[j * LEAF : m * LEAF]
    # Unit vectors: the products of rounded components, and their sum in any order, are off by less than this.
    slack = (x.shape[1] + 4) * 2.0**-23
    most = np.maximum.reduceat(x @ y.T, np.arange(0, len(y), LEAF), axis=1)
    return np.maximum.reduceat(most, np.arange(0, len(x), LEAF), axis=0) >= threshold - slack


def leaf_pairs(a: Sequence, b: Sequence, same: bool, threshold: float, eps: float) -> Iterator[tuple[int, int]]:
    """Leaves that may hold close vectors, by joining halves of the two sequences recursively."""
    waiting = [(0, len(a.lo), 0, len(b.lo))]
    while waiting:
        i, k, j, m = waiting.pop()
        if same and m <= i:
            continue  # the mirror image of another pair
        gap = np.maximum(a.lo[i:k].min(axis=0) - b.hi[j:m].max(axis=0), b.lo[j:m].min(axis=0) - a.hi[i:k].max(axis=0))
        gap = np.maximum(gap, 0)
        if gap @ gap > (eps + SLACK) ** 2:
            continue
        if max(k - i, m - j) <= SCREENED:
            for p, q in np.argwhere(_screened(a, i, k, b, j, m, threshold)).tolist():
                if not same or i + p <= j + q:
                    yield i + p, j + q
        elif k - i >= m - j:
            half = (i + k) // 2
            waiting += [(i, half, j, m), (half, k, j, m)]
        else:
            half = (j + m) // 2
            waiting += [(i, k, j, half), (i, k, half, m)]


def _linked(a: Sequence, x: slice, b: Sequence, y: slice, threshold: float) -> np.ndarray:
    cosine = a.unit[x] @ b.unit[y].T
    for i, j in np.argwhere(np.abs(cosine - threshold) < CLOSE):
        p, q = a.raw[x][i], b.raw[y][j]
        cosine[i, j] = (p @ q) / (math.sqrt(p @ p) * math.sqrt(q @ q))
    return cosine >= threshold


FOUND = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _compared(axes: np.ndarray, threshold: float, eps: float, stored: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(FOUND)
        for batch in batches:
            for same, *sides in zip(*(strings(batch.column(c)) for c in range(7)), strict=True):
                a, b = Sequence(*sides[:3], axes, stored), Sequence(*sides[3:], axes, stored)
                links_a, links_b = np.zeros(len(a.uids), np.int64), np.zeros(len(b.uids), np.int64)
                for i, j in leaf_pairs(a, b, same, threshold, eps):
                    x, y = a.rows(i), b.rows(j)
                    linked = _linked(a, x, b, y, threshold)
                    inside = same and i == j
                    if inside:
                        np.fill_diagonal(linked, False)
                    if not linked.any():
                        continue
                    links_a[x] += linked @ b.copies[y]
                    if not inside:
                        links_b[y] += a.copies[x] @ linked
                    for p, q in spanning_edges(linked) if inside else spanning_between(linked):
                        yield from out.add((a.uids[x][p], b.uids[y][q], 0))
                for side, links in ((a, links_a), (b, links_b)):
                    for p in np.flatnonzero(links).tolist():
                        yield from out.add((side.uids[p], None, links[p]))
        yield from out.rest()

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id). Links are cosines of at least the
    threshold between vectors of the same label; ``component_id`` is the smallest key reached."""
    eps = math.sqrt(2 - 2 * threshold)
    # Floats travel as floats; all arithmetic is in doubles.
    element = getattr(vectors.schema[vector].dataType, "elementType", None)
    stored = "<f4" if isinstance(element, FloatType) else "<f8"
    rows = own_columns(vectors, vec_id=key, vector=vector, label=label).select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector")
    )
    sound = F.coalesce(
        F.col("label").isNotNull() & F.exists("vector", lambda x: x != 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False),
    )
    rows = rows.withColumn("vector", F.when(sound, F.col("vector")))
    rows = rows.withColumn("label", F.when(F.col("vector").isNotNull(), F.col("label")))
    distinct = rows.filter("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("uid"), "label", "vector", F.size("vector").alias("dim"), "first_id", "copies"), "vectors")

    usual = distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    axes = principal_axes(distinct, usual[0].dim) if usual else np.eye(1)
    keyed = written(distinct.select("label", "dim", "uid", "copies", "vector").mapInArrow(_keyed(axes, eps, stored), KEYED_COLUMNS), "keyed")
    order = ["label", "dim", "cells", "uid"]
    parts = spread(keyed.count(), PARTITION, 4)
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = written(ordered.mapInArrow(_blocks(axes, stored), BLOCK_COLUMNS), "blocks")

    pairs = block_pairs(blocks, parts, eps)
    sides = [blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("number", "uids", "copies", "vectors")]) for s in "ab"]
    both = pairs.join(sides[0], "number_a").join(sides[1], "number_b").select(
        (F.col("number_a") == F.col("number_b")).alias("same"), *[f"{c}_{s}" for s in "ab" for c in ("uids", "copies", "vectors")]
    )
    found = written(both.mapInArrow(_compared(axes, threshold, eps, stored), "uid long, other long, links long"), "found")
    groups = components(found.filter("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    linked = distinct.select("uid", "label", "vector", "first_id", "copies").join(
        groups.withColumnRenamed("node", "uid"), "uid", "left"
    ).join(links, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "component").select(
        "label", "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return rows.join(linked, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )


def digest(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
