"""Exact top-k search: tiled matrix products of queries and shards, partial selection, tree merge of top lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a shard and queries in a tile, fewer where SIDE_BYTES of int64 components are fewer; both are held by a
#: task, which multiplies STEP queries at a time: their scores take 32 MB. Each vector is sent to each tile, each query
#: to each shard, so that large ones make few copies (one of a vector for each 327,680 rows at 5% queries). Fewer rows
#: than PARTS full shards are cut into PARTS, of LEAST rows at least, so that many tasks share them.
SHARD, TILE, STEP, SIDE_BYTES, FAN_IN = 65_536, 16_384, 64, 64 << 20, 16
PARTS, LEAST = 64, 8192


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1)


def _high(x: np.ndarray) -> np.ndarray:
    """The largest absolute component of each row."""
    return np.maximum(x.max(axis=1, initial=0).astype(np.float64), -x.min(axis=1, initial=0).astype(np.float64))


def _products(queries: np.ndarray, shard: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, held: dict) -> np.ndarray:
    """Exact integer products, in the narrowest type whose sums stay exact; raises where a score is no int64.

    Pairs of one id do not count. held keeps the shard's rows in that type from one call to the next.
    """
    dim = max(1, queries.shape[1])
    if "high" not in held:
        held["high"] = _high(shard)
    high = [_high(queries), held["high"]]
    most = float(high[0].max(initial=0)) * float(high[1].max(initial=0)) * dim
    if most < 1 << 62:
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        if kind not in held:
            held[kind] = np.ascontiguousarray(shard.astype(kind).T)
        return (queries.astype(kind) @ held[kind]).astype(np.int64)
    # A few rows hold huge components: their products are taken with whole Python integers.
    out = np.empty((len(queries), len(shard)), np.int64)
    bound = float(1 << 62) / dim
    small = [x < np.sqrt(bound) for x in high]
    if all(x.any() for x in small):
        out[np.ix_(small[0], small[1])] = _products(queries[small[0]], shard[small[1]], q_ids[small[0]], ids[small[1]], {})
    for a, b in ((~small[0], np.ones(len(shard), bool)), (small[0], ~small[1])):
        if a.any() and b.any():
            exact = queries[a].astype(object) @ shard[b].astype(object).T
            exact[q_ids[a][:, None] == ids[b]] = 0
            if max(map(abs, exact.ravel().tolist())) >= 1 << 63:
                raise OverflowError("an inner product is no 64-bit integer")
            out[np.ix_(a, b)] = exact.astype(np.int64)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, ties to the smaller id, in order."""
    n = len(scores)
    if n > k:
        least = np.partition(scores, n - k)[n - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        level = level[np.argsort(ids[level], kind="stable")][: k - len(above)]
        at = np.concatenate([above, level])
    else:
        at = np.arange(n)
    return at[np.lexsort((ids[at], -scores[at]))]


_LIST = pa.schema([("tile", pa.int64()), ("part", pa.int64()), ("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])
_LIST_SQL = "tile long, part long, query_id long, ids array<bigint>, scores array<bigint>"


def _score(k: int):
    def score(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        if not left.num_rows or not right.num_rows:
            return _LIST.empty_table()
        q_ids, ids = left["q_id"].to_numpy(), right["id"].to_numpy()
        queries, shard = _matrix(left["q_vector"]), _matrix(right["vector"])
        out: dict[str, list] = {n: [] for n in _LIST.names}
        held: dict = {}
        for i, q in enumerate(q_ids):
            if i % STEP == 0:
                products = _products(queries[i : i + STEP], shard, q_ids[i : i + STEP], ids, held)
            own, names = products[i % STEP], ids
            if (other := names != q).sum() < len(names):
                own, names = own[other], names[other]
            at = best(own, names, k)
            for n, v in zip(_LIST.names, (key[0].as_py(), key[1].as_py(), int(q), names[at], own[at]), strict=True):
                out[n].append(v)
        return pa.table(out, schema=_LIST)

    return score


def _merge(k: int):
    def merge(key: tuple, lists: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in _LIST.names}
        at = lists["query_id"].to_numpy()
        order = np.argsort(at, kind="stable")
        ids, scores = lists["ids"].combine_chunks(), lists["scores"].combine_chunks()
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        for own in np.split(order, cuts):
            names = np.concatenate([ids[int(i)].values.to_numpy() for i in own])
            got = np.concatenate([scores[int(i)].values.to_numpy() for i in own])
            top = best(got, names, k)
            for n, v in zip(_LIST.names, (key[0].as_py(), key[1].as_py(), int(at[own[0]]), names[top], got[top]), strict=True):
                out[n].append(v)
        return pa.table(out, schema=_LIST)

    return merge


def quantised(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, vector of floor(scale * x)); rows without id, vector, components, or with null or non-finite ones go.

    Every finite component takes part; one whose floor is no 64-bit integer raises an error.
    """
    x = F.col(embedding).cast("array<double>")
    good = F.col(embedding).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v * scale) < F.lit(float(1 << 63)), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is no 64-bit integer")).cast("long"))
    return vectors.filter(good & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, whole).alias("vector"))


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank (from 1), vec_id, score.

    Queries (rows of ``vectors`` for which ``is_query`` holds on column id) are cut into tiles and all rows into
    shards; each tile meets each shard once, as one matrix product, and keeps a top list for each query. Lists of a
    tile merge FAN_IN at a time. Fewer rows than k: all of them. Ties: smaller vec_id first. Null ids and vectors
    with null, non-finite or no components take no part. Vectors of different lengths do not meet. Repeated ids: a
    query never meets rows with its own id; a candidate id that repeats counts each time, and the rows of a query id
    that repeats share one list of k, as in the SQL, whatever the number of shards. Scores beyond 64 bits raise an error. Empty table: no rows.
    Other columns are not read. The driver holds one row a distinct length of vectors.
    """
    rows = quantised(vectors, vec_id=vec_id, embedding=embedding, scale=scale).withColumn("dim", F.size("vector"))
    dims = {r.dim: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()}
    own = lambda most, dim: max(1, min(most, SIDE_BYTES // (8 * dim)))
    shards = max([1, *(math.ceil(r.n / own(min(SHARD, max(LEAST, r.n // PARTS)), d)) for d, r in dims.items())])
    tiles = max([1, *(math.ceil(r.q / own(TILE, d)) for d, r in dims.items())])
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    every = rows.withColumn("part", spread(shards, 1)).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    # A cogroup needs columns of its own on each side, so those of the queries get new names.
    asked = rows.filter(is_query).withColumn("tile", spread(tiles, 2)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    asked = asked.select(F.col("tile").alias("q_tile"), F.col("part").alias("q_part"), F.col("dim").alias("q_dim"), F.col("id").alias("q_id"), F.col("vector").alias("q_vector"))
    by = ["tile", "part", "dim"]
    lists = asked.groupBy("q_tile", "q_part", "q_dim").cogroup(every.groupBy(*by)).applyInArrow(_score(k), _LIST_SQL)
    while True:  # once at least: rows of one query id, also of different lengths, meet in a merge alone
        shards = math.ceil(shards / FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("tile", "part").applyInArrow(_merge(k), _LIST_SQL)
        if shards == 1:
            break
    top = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("pos", "hit"))
    return top.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
