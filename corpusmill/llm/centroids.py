"""Centroid clustering by annulus search: centroids sorted by norm, a bound for each vector, exact comparison within it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K
from corpusmill.plans.storage import Scratch

#: Vectors that are compared at once.
STEP = 1 << 14
_MASK = (1 << 32) - 1


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices; raises where one is no 64-bit integer."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    most = sum(max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b))
    if most * most * a.shape[1] < 1 << 63:
        gap = a - b
        return np.einsum("ij,ij->i", gap, gap)
    out = ((a.astype(object) - b.astype(object)) ** 2).sum(axis=1)
    if max(out) >= 1 << 63:
        raise OverflowError("a squared distance is no 64-bit integer")
    return out.astype(np.int64)


class Annuli:
    """Centroids by norm. A vector's nearest one has a norm that differs from the vector's by their distance at most."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64).reshape(len(centroids), -1)
        norms = self._norms(self.centroids)
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.number], self.centroids[self.number]
        self.compared = 0

    @staticmethod
    def _norms(rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid (ties: the smaller number) and the squared distance to it.

        The centroid of the nearest norm gives an upper bound u. Those with norms from |x| - u to |x| + u, ends
        included, stand side by side and are found by binary search; only they are compared, exactly. The bound is
        widened by more than floating point can err, so that a centroid on the edge is compared too.
        """
        norm = self._norms(vectors)
        at = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
        guess = np.where(norm - self.norms[at - 1] <= self.norms[np.minimum(at, len(self.norms) - 1)] - norm, at - 1, np.minimum(at, len(self.norms) - 1))
        best, number = squared(vectors, self.sorted[guess]), self.number[guess]
        bound = np.sqrt(best.astype(np.float64))
        bound += 1e-9 * (norm + bound + self.norms[-1]) + 1e-6
        low, high = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        self.compared += len(vectors) + int((high - low).sum())
        own = np.arange(len(vectors))
        for step in range(int((high - low).max(initial=0))):
            own = own[low[own] + step < high[own]]
            at = low[own] + step
            gap, name = squared(vectors[own], self.sorted[at]), self.number[at]
            better = (gap < best[own]) | ((gap == best[own]) & (name < number[own]))
            best[own[better]], number[own[better]] = gap[better], name[better]
        return number, best


def _steps(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            part = batch.slice(a, STEP)
            yield part, _matrix(part.column(column), dims)


def _sums(centroids: list[list[int]], dims: int):
    """A partition's sums of each cluster's components, as upper and lower 32 bits, and its number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        high, low, n = (np.zeros((len(centroids), *shape), np.int64) for shape in ((dims,), (dims,), ()))
        for _, vectors in _steps(batches, "vector", dims):
            number, _ = annuli.nearest(vectors)
            order = np.argsort(number, kind="stable")
            at, size = K.groups(number[order])
            own, vectors = number[order][at], vectors[order]
            high[own] += np.add.reduceat(vectors >> 32, at)
            low[own] += np.add.reduceat(vectors & _MASK, at)
            n[own] += size
        some = np.flatnonzero(n)
        columns = (np.repeat(some, dims), np.tile(np.arange(dims), len(some)), np.repeat(n[some], dims), high[some].ravel(), low[some].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cluster", "component", "n", "high", "low"])

    return run


def _assigned(centroids: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for part, vectors in _steps(batches, "vector", dims):
            number, gap = annuli.nearest(vectors)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number.astype(np.int32)), pa.array(gap)], names=["vec_id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, *, dims: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vector of floor(scale * x)) of the rows with exactly ``dims`` components, none null or non-finite."""
    x = F.col(embedding).cast("array<double>")
    good = F.col(embedding).isNotNull() & (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v * scale) < F.lit(float(1 << 63)), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is no 64-bit integer")).cast("long"))
    return vectors.filter(good).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, whole).alias("vector"))


def seeds(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``salt:id``, in that order; of a repeated id, smaller vectors first."""
    rows = kept.filter("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("hash"), "vector")
    return [list(r.vector) for r in rows.orderBy("hash", "vector").limit(k).collect()]


def fit(kept: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """Lloyd rounds over (id, vector): every non-empty centroid becomes the exact floor of its vectors' mean.

    Each round is one scan; a task sends one row a cluster and component, and the driver holds the centroids alone.
    Rounds that change nothing end early: those after them would not either.
    """
    for _ in range(rounds):
        dims = len(centroids[0])
        part = kept.mapInArrow(_sums(centroids, dims), "cluster long, component long, n long, high long, low long")
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        found = part.groupBy("cluster", "component").agg(exact("n"), exact("high"), exact("low")).collect()
        moved = [list(c) for c in centroids]
        for r in found:
            moved[r.cluster][r.component] = ((int(r.high) << 32) + int(r.low)) // int(r.n)
        if moved == centroids:
            break
        centroids = moved
    return centroids


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors of ``dims`` components, none null or non-finite, are kept, as integers floor(scale * x). Centroids start
    as the ``k`` kept vectors with the smallest SHA-256 of ``salt:vec_id``. After ``rounds`` rounds vectors are assigned
    once more, to the nearest centroid by squared distance (ties: smaller number). Means are exact whatever the number
    of rows. centroid_sha256 is of the centroid's components, joined by commas.

    Fewer kept vectors than k: that many centroids. No kept vectors: no rows. Null ids are assigned and counted but
    start no centroid; if all ids are null there are no centroids and so no rows. Repeated rows count each time and
    may start several centroids. Components, distances or inertias beyond 64 bits raise an error. Other columns are
    not read. Whole vectors are written once; a round reads them and writes nothing, so that no state of a row has to
    survive from one round to the next. The driver holds k centroids.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "centroids")
    kept = scratch.keep(whole_vectors(vectors, dims=dims, scale=scale, vec_id=vec_id, embedding=embedding), "vectors")
    schema = "vec_id long, cluster int, distance long"
    start = seeds(kept, k, salt)
    if not start:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = fit(kept, start, rounds)
    rows = scratch.keep(kept.mapInArrow(_assigned(centroids, dims), schema), "assigned")
    scratch.drop("vectors")
    inertia = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    if sum(inertia.values()) >= 1 << 63:
        raise OverflowError("the inertia is no 64-bit integer")
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), digest(c)) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
