"""Connected components of an edge table by rounds of local union-find; no vertex is ever hot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.storage import Scratch

#: Edges that one task may finish alone (two longs each).
ONE_TASK = 1 << 20
_STAR = pa.schema([("v", pa.int64()), ("root", pa.int64())])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vertices of the edges a-b and the smallest vertex of each one's component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            return names, names[root]


def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a forest of stars: each vertex but the roots, and its root."""
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy())
        b.append(x.column(1).to_numpy())
        if sum(map(len, a)) > 4 * ONE_TASK:  # a forest is no larger than its vertices
            v, r = roots(np.concatenate(a), np.concatenate(b))
            a, b = [v[v != r]], [r[v != r]]
    if a:
        v, r = roots(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(v[v != r]), pa.array(r[v != r])], schema=_STAR)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, root) for each vertex that is not the smallest of its component; edges has two long columns.

    Each round makes a forest of every partition's edges, so that a vertex has one row a partition at most; then
    each vertex takes the smallest of its roots. What ties roots to each other (two of them at one vertex, or a root
    that has a root elsewhere) are the edges of the next round, far fewer. What is left when ONE_TASK rows suffice is
    finished in one task. Labels are then followed from round to round. No edges: no rows.
    """
    rounds: list[DataFrame] = []
    left, parts = edges, 0
    while True:
        forest = scratch.keep(left.mapInArrow(star, "v long, root long"), f"{name}-forest{len(rounds)}")
        n = forest.count()
        if n <= ONE_TASK:
            rounds.append(scratch.keep(forest.coalesce(1).mapInArrow(star, "v long, root long"), f"{name}-label{len(rounds)}"))
            break
        by = forest.groupBy("v").agg(F.min("root").alias("low"))
        rounds.append(scratch.keep(by.select("v", F.col("low").alias("root")), f"{name}-label{len(rounds)}"))
        own = forest.join(by, "v").filter("root > low").select("low", "root")
        both = by.join(forest.select(F.col("root").alias("v")).distinct(), "v", "left_semi").select("low", F.col("v").alias("root"))
        # Fewer partitions each round, so that the rounds end.
        parts = max(1, min(n // ONE_TASK, parts // 2 if parts else n))
        left = own.unionByName(both).distinct().repartition(parts)
    scratch.drop(*(f"{name}-forest{i}" for i in range(len(rounds))))
    out = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("v").alias("root"), F.col("root").alias("up"))
        known = out.join(up, "root", "left").select("v", F.coalesce("up", "root").alias("root"))
        out = known.unionByName(later.join(out.select("v"), "v", "left_anti"))
    return out
