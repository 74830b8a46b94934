"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import WORD
from corpusmill.llm import kernels as K
from corpusmill.plans.storage import Scratch

#: Words in a block, and blocks in a shard of the mix. Blocks are larger only where more than MOST_BLOCKS (9 * 10^12
#: words) would be, the reach of the hypergeometric generator.
UNIT, BLOCKS_A_SHARD, MOST_BLOCKS = 1 << 15, 64, 1 << 28
#: Up to so many drawn blocks (a row of some hundred bytes each) are broadcast.
BROADCAST_BLOCKS = 1 << 17
RESULTS = ("mix_size", "mix_source_size", "mix_target", "mix_draws", "mix_taken")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Split ``share`` times all sizes by weight; what exceeds ``most`` times a size goes to the others by weight."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


class Tree:
    """The splitting tree over shards: exact quotas of blocks of every stratum, and each shard's own places.

    A stratum is one pass over one source: ``quotas`` of its blocks are drawn and ``spare`` ones are not. Each node
    draws its left half's quotas from the multivariate hypergeometric distribution, with a generator seeded by the
    node's place, and gives it its share of the spare places; so any shard's part is made alone, from the root down,
    on any executor, and reruns agree. The places of the shards are disjoint and together all of them.
    """

    def __init__(self, quotas: np.ndarray, spare: np.ndarray, shards: int, seed: int):
        self.quotas, self.spare = np.asarray(quotas, np.int64), np.asarray(spare, np.int64)
        self.shards, self.seed = shards, seed
        self.path: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def leaf(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stratum: the first of the shard's places, how many are drawn, and how many behind these are not."""
        lo, hi, node, depth = 0, self.shards, 1, 0
        own, spare, start = self.quotas, self.spare, self.quotas * 0
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.path.get(depth, (0,))[0] != node:
                draw = int(own.sum()) * (mid - lo) // (hi - lo)
                left = np.random.default_rng([self.seed, node]).multivariate_hypergeometric(own, draw, method="marginals") if draw else own * 0
                self.path[depth] = (node, left, spare * (mid - lo) // (hi - lo))
            _, left, rest = self.path[depth]
            if shard < mid:
                own, spare, hi, node = left, rest, mid, 2 * node
            else:
                start, own, spare, lo, node = start + left + rest, own - left, spare - rest, mid, 2 * node + 1
            depth += 1
        return start, own, spare


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """The blocks at places of a keyed permutation of range(n): a Feistel network, walked until it falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, 6, np.uint64)

    def step(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            a, b = b, a ^ (K.mix(b * np.uint64(0x9E3779B97F4A7C15) + k) & mask)
        return a << np.uint64(half) | b

    out = step(places.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = step(out[far])
    return out.astype(np.int64)


_PLACES = pa.schema([("sid", pa.int32()), ("epoch", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("drawn", pa.bool_())])
_PLACES_SQL = "sid int, epoch int, block long, shard long, drawn boolean"


def _places(strata: list[tuple[int, int, int, int]], shards: int, seed: int):
    """Every shard's blocks: those that it draws, and those that it leaves. strata: source, epoch, blocks, quota."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(np.array([q for *_, q in strata]), np.array([b - q for *_, b, q in strata]), shards, seed)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for (sid, epoch, blocks, _), start, own, spare in zip(strata, *(x.tolist() for x in tree.leaf(shard)), strict=True):
                    if n := own + spare:
                        block = permuted(np.arange(start, start + n), blocks, [seed, sid, epoch])
                        yield pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.int32()), pa.array([epoch] * n, pa.int32()), pa.array(block), pa.array([shard] * n, pa.int64()), pa.array(np.arange(n) < own)], schema=_PLACES)

    return run


def _changes(places: DataFrame, need: dict[int, tuple[int, int, int]], unit: int, seed: int) -> list[tuple]:
    """What brings each source from the words drawn to its target: rows (sid, epoch, block, drawn, words or None).

    need: of each source, the words that it lacks (or, below 0, has too many of), the epoch that may change and the
    number of its blocks that may. Spare blocks are added, or drawn ones are dropped, in the order of a hash; the one
    in which the target falls is cut to the words given. A slice of the hashes that should suffice is read, and a
    larger one if it does not: some 8 blocks a source, and what the spread of the words in blocks asks for.
    """
    out, rank = [], F.pmod(F.xxhash64("sid", "block", F.lit(seed + 3)), F.lit(1 << 30))
    grow = 4
    while need:
        rows = [(sid, epoch, min(1 << 30, math.ceil((1 << 30) * grow * (8 + abs(words) / unit) / blocks)), words > 0) for sid, (words, epoch, blocks) in need.items()]
        wanted = places.sparkSession.createDataFrame(rows, "sid int, epoch int, below long, lacks boolean")
        near = places.withColumn("rank", rank).join(F.broadcast(wanted), ["sid", "epoch"]).filter((F.col("rank") < F.col("below")) & (F.col("drawn") != F.col("lacks")))
        found: dict[int, list] = {}
        for r in sorted(near.select("sid", "rank", "block", "words").collect()):
            found.setdefault(r.sid, []).append(r)
        left = {}
        for sid, epoch, below, lacks in rows:
            due, own = abs(need[sid][0]), []
            for r in found.get(sid, []):
                if due <= 0:
                    break
                own.append((sid, epoch, r.block, lacks, None) if r.words <= due else (sid, epoch, r.block, True, due if lacks else r.words - due))
                due -= r.words
            if due <= 0 or below == 1 << 30:
                out += own
            else:
                left[sid] = need[sid]
        need, grow = left, grow * 8
    return out


def _cuts(sized: DataFrame, edges: list[tuple]) -> dict[int, tuple[int, int]]:
    """For each source that stops inside a block: the hash of the document at which it stops, and that one's words."""
    dim = sized.sparkSession.createDataFrame(edges, "sid int, block long, quota long")
    by = sized.join(F.broadcast(dim), ["sid", "block"]).groupBy("sid", "quota", "rank_hash").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    run = Window.partitionBy("sid").orderBy("rank_hash")
    at = by.withColumn("before", F.sum("words").over(run) - F.col("words")).filter("before <= quota and before + words > quota")
    return {r.sid: (r.rank_hash, (r.quota - r.before) // r.n) for r in at.select("sid", "rank_hash", "quota", "before", "n").collect()}


def plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, whole: bool = False, seed: int = 20240501) -> DataFrame:
    """All columns of ``docs`` and those of the mix, RESULTS, which replace columns of these names.

    Sources in code point order, null last, take ``weights`` in turn. A source is cut into blocks of documents by
    hash, of UNIT words. A pass over a source is a stratum: whole passes draw all blocks, the last one as many as the
    target asks for. The tree deals the strata's exact quotas to shards of BLOCKS_A_SHARD blocks, and each shard draws
    its own permuted blocks. Since blocks differ in words, a few blocks of the last pass are then added or dropped,
    and one is cut, where documents go by hash, so that a source's words meet its target. mix_draws lists (epoch,
    shard, words) for each time the document is drawn; mix_taken is the sum of the words. With ``whole`` the document
    at which a source stops is taken as a whole if at least half of it is due, else not at all; otherwise its first
    words count as taken.

    Null or empty text: size 0, drawn as any other document, 0 words. Null source: a source of its own. Null doc_id:
    a key like any other. Repeated rows count each; where the stop falls on rows that repeat, they share what is due.
    Empty table: empty result. The driver holds one row a source and what ``_changes`` reads.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col(doc_id), F.col(text))
    sized = scratch.keep(docs.select(key.alias("key"), F.col(source).alias("source"), n_words.alias("size")), "sized")
    found = sorted(sized.groupBy("source").agg(F.sum("size").alias("words")).collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r.words) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most) if found else []
    unit = max(UNIT, sum(sizes) // MOST_BLOCKS)
    blocks = [max(1, math.ceil(s / unit)) for s in sizes]
    sources = spark.createDataFrame([(i, r.source, sizes[i], float(goal[i]), blocks[i]) for i, r in enumerate(found)], "sid int, mix_source string, mix_source_size long, mix_target double, blocks long")
    placed = [F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")).alias("block"), F.xxhash64("key", F.lit(seed + 1)).alias("rank_hash")]
    sized = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("mix_source"))).select("sid", "size", *placed)

    strata = []  # (source, epoch, blocks, quota)
    for i, size in enumerate(sizes):
        passes = round(goal[i]) // size if size else 0
        strata += [(i, e, blocks[i], blocks[i]) for e in range(passes)]
        if size and (rest := round(goal[i]) - passes * size):
            strata.append((i, passes, blocks[i], rest * blocks[i] // size))
    shards = max(1, math.ceil(sum(q for *_, q in strata) / BLOCKS_A_SHARD))
    words = sized.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    places = spark.range(0, shards, 1, max(1, min(shards, shards // 16))).mapInArrow(_places(strata, shards, seed), _PLACES_SQL)
    places = scratch.keep(places.join(words, ["sid", "block"], "left").withColumn("words", F.coalesce("words", F.lit(0))), "places")
    got = {r.sid: r.words for r in places.filter("drawn").groupBy("sid").agg(F.sum("words").alias("words")).collect()}
    need = {}
    for i, e, b, q in strata:  # the last stratum of a source is the one that may change
        if lacks := round(goal[i]) - got.get(i, 0):
            need[i] = (lacks, e, b - q if lacks > 0 else q)
    changes = _changes(places, need, unit, seed)
    edges = [(i, b, w) for i, _, b, _, w in changes if w is not None]
    cuts = _cuts(sized, edges) if edges else {}
    fixed = spark.createDataFrame([(i, e, b, d, *(cuts[i] if w is not None else (None, 0))) for i, e, b, d, w in changes], "sid int, epoch int, block long, now boolean, cut long, at long")
    final = places.join(F.broadcast(fixed), ["sid", "epoch", "block"], "left").filter(F.coalesce("now", "drawn"))
    final = final.groupBy(F.col("sid").alias("mix_sid"), F.col("block").alias("mix_block")).agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "cut", "at"))).alias("mix_plan"))
    final = scratch.keep(final, "draws")
    scratch.drop("sized", "places")
    if final.count() <= BROADCAST_BLOCKS:  # at most so many rows of a hundred bytes; else the rows are dealt by block
        final = F.broadcast(final)

    # The columns of docs travel as one struct, so that none of their names meets one of these.
    names = [c for c in docs.columns if c not in RESULTS]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"), F.col(source).alias("source"), n_words.alias("mix_size"))
    out = out.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("mix_source")), "left").select("*", *placed)
    out = out.join(final, (F.col("sid") == F.col("mix_sid")) & (F.col("block") == F.col("mix_block")), "left")
    size, own = F.col("mix_size"), F.col("rank_hash")

    def part(d: Column) -> Column:
        at = F.when(2 * d["at"] >= size, size).otherwise(F.lit(0)) if whole else F.least(d["at"], size)
        return F.when(d["cut"].isNull() | (own < d["cut"]), size).when(own == d["cut"], at).otherwise(F.lit(0)).cast("long")

    def drawn(d: Column) -> Column:
        return d["cut"].isNull() | (own < d["cut"]) | ((own == d["cut"]) & (part(d) > 0))

    kind = "array<struct<epoch:int,shard:long,cut:long,at:long>>"
    draws = F.transform(F.filter(F.coalesce(F.col("mix_plan"), F.array().cast(kind)), drawn), lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), part(d).alias("words")))
    out = out.withColumn("mix_draws", draws).withColumn("mix_taken", F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *RESULTS)


def shuffled(planned: DataFrame, *, doc_id: str = "doc_id", seed: int = 20240501) -> DataFrame:
    """A row of a plan for each time it is drawn, shard by shard, shuffled within each shard.

    Adds mix_shard, mix_epoch, mix_words (words taken this time) and mix_place (from 1, in the shard's order). Shards
    hold BLOCKS_A_SHARD blocks (some 12 MB of text), whatever the input.
    """
    more = ("mix_shard", "mix_epoch", "mix_words", "mix_place")
    names = [c for c in planned.columns if c not in (*RESULTS, *more)]
    rows = planned.select(*[F.col(f"`{c}`") for c in names], F.inline(F.transform("mix_draws", lambda d: F.struct(d["shard"].alias("mix_shard"), d["epoch"].alias("mix_epoch"), d["words"].alias("mix_words")))))
    order = [F.xxhash64(F.col(doc_id), "mix_epoch", "mix_words", F.lit(seed + 2)), F.col(doc_id), F.col("mix_epoch")]
    # Dealt and sorted here, not by the window alone, which goes where nobody reads the places.
    rows = rows.repartition("mix_shard").sortWithinPartitions("mix_shard", *order)
    return rows.withColumn("mix_place", F.row_number().over(Window.partitionBy("mix_shard").orderBy(*order)))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", seed: int = 20240501, **options) -> DataFrame:
    """The mixed corpus: what ``shuffled`` gives for the ``plan`` of docs. Options and cases as for ``plan``."""
    return shuffled(plan(docs, doc_id=doc_id, seed=seed, **options), doc_id=doc_id, seed=seed)


def taken(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id and RESULTS of each row, with mix_taken summed over the rows of the mix itself, and mix_places.

    mix_places lists (shard, place) of each time the document stands in the mix. The mix is made without texts. Cases
    as for ``plan``.
    """
    planned = plan(docs, doc_id=doc_id, **options).select(F.col(doc_id).alias("doc_id"), *RESULTS).withColumn("mix_row", F.monotonically_increasing_id())
    planned = Scratch(docs.sparkSession, "mixed").keep(planned, "rows")
    rows = shuffled(planned.select("doc_id", "mix_row", "mix_draws"))
    by = rows.groupBy("mix_row").agg(F.sum("mix_words").alias("mix_taken"), F.sort_array(F.collect_list(F.struct(F.col("mix_shard").alias("shard"), F.col("mix_place").alias("place")))).alias("mix_places"))
    out = planned.drop("mix_taken").join(by, "mix_row", "left")
    return out.select("doc_id", *RESULTS[:-2], "mix_draws", F.coalesce("mix_taken", F.lit(0)).cast("long").alias("mix_taken"), F.coalesce("mix_places", F.array().cast("array<struct<shard:long,place:int>>")).alias("mix_places"))
