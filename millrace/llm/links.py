"""Groups of linked things: connected components as joins, and spanning edges inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


#: Cells of a matrix of links that are labelled at a time: the labels never take eight times what the links do.
CELLS = 1 << 18


def lowest_linked(linked: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """Of each row the lowest label of the columns it is linked to, or ``most`` where there is none."""
    lowest, step = np.full(len(linked), most, label.dtype), max(1, CELLS // max(1, len(label)))
    for at in range(0, len(linked), step):
        lowest[at:at + step] = np.where(linked[at:at + step], label[None, :], most).min(axis=1, initial=most)
    return lowest


def spanning_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the same groups as a symmetric boolean matrix of links does, at most one
    per row: every member with its group's first."""
    n = len(linked)
    label = np.arange(n)
    while True:
        lowest = np.minimum(label, lowest_linked(linked, label, n))
        lowest = lowest[lowest]
        if (lowest == label).all():
            break
        label = lowest
    return [(int(a), int(b)) for a, b in zip(np.arange(n), label, strict=True) if a != b]


def spanning_between(linked: np.ndarray) -> list[tuple[int, int]]:
    """The same for links between two sides: pairs (row, column), fewer than rows and columns."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part = linked[np.ix_(rows, columns)]
    group = np.arange(len(rows))
    while True:
        of_column = lowest_linked(part.T, group, len(rows))
        lowest = lowest_linked(part, of_column, len(rows))
        if (lowest == group).all():
            break
        group = lowest
    anchor = {}  # a column of each group
    edges = []
    for c, g in enumerate(of_column.tolist()):
        anchor.setdefault(g, c)
        edges.append((int(rows[g]), int(columns[c])))
    edges += [(int(rows[r]), int(columns[anchor[g]])) for r, g in enumerate(group.tolist()) if r != g]
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b): the smallest node that can be reached.

    Every node is merged into its smallest neighbour and pointers are followed twice; then the
    merged graph, which has far fewer edges, is treated likewise, until none are left. Only tables
    are kept between the rounds, and nothing goes to the driver but whether edges are left."""
    edges = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    merged = None
    while not edges.isEmpty():
        lowest = edges.groupBy("a").agg(F.min("b").alias("into"))
        nodes = lowest.unionByName(edges.select(F.col("b").alias("a"), F.col("b").alias("into"))).groupBy("a").agg(
            F.min("into").alias("into")
        )
        first = into = written(nodes, "pointers")
        for _ in range(2):
            up = into.select(F.col("a").alias("into"), F.col("into").alias("up"))
            into = into.join(up, "into").select("a", F.col("up").alias("into"))
        into, before = written(into, "pointers"), [first, edges]
        if merged is None:
            merged = into.select(F.col("a").alias("node"), F.col("into").alias("component"))
        else:
            up = into.select(F.col("a").alias("component"), F.col("into").alias("up"))
            before.append(merged)
            merged = merged.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        merged = written(merged, "merged")
        of_a, of_b = into.select("a", F.col("into").alias("x")), into.select(F.col("a").alias("b"), F.col("into").alias("y"))
        edges = written(
            edges.join(of_a, "a").join(of_b, "b").filter("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
            "edges",
        )
        dropped(*before, into)
    if merged is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return merged
