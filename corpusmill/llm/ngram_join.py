"""N-gram Jaccard join with multiple-global-order filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K
from corpusmill.llm.components import components
from corpusmill.llm.exchange import NO_ID, SENT, Chunk, Corpus, Gathered, Sorted, sent_table
from corpusmill.plans.skew import join_hot
from corpusmill.plans.storage import Scratch

_DF = 1
#: Shingles that one comparing task holds at most of a side; larger candidate groups are cut into tiles.
TILE = 1 << 17
#: Rounds in which a candidate group too large for one tile is compared with one of its documents.
PIVOTS = 2
_U = np.uint64


class Threshold:
    """Similar: den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Of n tokens in any order, so many first ones meet those of every similar set."""
        return n - (self.num * n + self.den - 1) // self.den + 1

    def similar(self, both, n, m):
        return self.den * both >= self.num * (n + m - both)

    def sizes(self, n, m):
        """Whether sizes alone allow similarity."""
        return self.den * np.minimum(n, m) >= self.num * np.maximum(n, m)


def _shingles(c: Chunk, width: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the documents marked in ``of``, and their documents; short texts are one shingle."""
    rolled = K.rolling(c.hashes, width)
    n = len(rolled)
    at = np.flatnonzero((c.doc[:n] == c.doc[width - 1 : width - 1 + n]) & of[c.doc[:n]])
    hashes, doc = [rolled[at]], [c.doc[at]]
    few = (c.n_words < width) & of
    for size in range(1, width):
        docs = np.flatnonzero(few & (c.n_words == size))
        if len(docs):
            hashes.append(K.rolling(c.hashes, size)[c.first_word[docs]] ^ _U(size * 0x9E3779B97F4A7C15 % (1 << 64)))
            doc.append(docs)
    return np.concatenate(hashes), np.concatenate(doc)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of hash and document, by hash."""
    mark = _U((1 << max(1, int(n_docs).bit_length())) - 1)
    order = np.argsort((hashes & ~mark) | doc.astype(np.uint64))
    h, d = hashes[order], doc[order]
    close = (h[1:] & ~mark == h[:-1] & ~mark) & (h[1:] != h[:-1])
    if close.any():  # hashes that differ in their last bits alone
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], d[new]


class _Sets:
    """The distinct shingles of each document of a chunk that is no copy, by hash, with groups by their first bits."""

    def __init__(self, c: Chunk, width: int, bits: int):
        c.words(K.LOWER)
        self.h, self.d = _distinct(*_shingles(c, width, ~c.copy), c.n)
        self.n = np.bincount(self.d, minlength=c.n)
        self.keys = Sorted(self.h, bits + 32)


def _send(width: int, bits: int):
    def send(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        s = _Sets(Chunk(docs, notes), width, bits).keys
        return sent_table(chunk, [(b, K.bundle(K.pack_ints(s.low(own, bits), rising=True), K.pack_ints(s.size[own]))) for b, own in s.buckets(bits)])

    return send


def _frequencies(parts: list[list[bytes]]) -> list[bytes]:
    """In how many documents each value stands: a bit for two or more, and the numbers of those."""
    g = Gathered([K.unpack_ints(p[0]) for p in parts])
    n = g.sorted([K.unpack_ints(p[1]).astype(np.int64) for p in parts])
    df = np.repeat(np.add.reduceat(n, g.at), g.size)
    return [K.bundle(K.pack_bits(x > 1), K.pack_ints(x[x > 1])) for x in g.deal(df)]


_SET = "doc_id long, n long, shared long, tokens binary, df binary, copy_of long, several boolean"
_SET_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("tokens", pa.binary()), ("df", pa.binary()), ("copy_of", pa.int64()), ("several", pa.bool_())])


def _sets(width: int, bits: int, t: Threshold):
    """Each row's set size, and for those that may be similar to another the tokens that others have too.

    copy_of: the smaller doc_id with the same whole text. several: whether the doc_id stands in several rows.
    """

    def sets(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SET_ARROW.empty_table()
        c = Chunk(docs, notes)
        s = _Sets(c, width, bits)
        by_value = np.ones(len(s.keys.values), np.int64)
        for b, own in s.keys.buckets(bits):
            bit, numbers = K.unbundle(c.notes[_DF][b])
            part = by_value[own]
            part[K.unpack_bits(bit, len(part))] = K.unpack_ints(numbers).astype(np.int64)
        df = s.keys.spread(by_value)
        shared = np.bincount(s.d[df > 1], minlength=c.n)
        open_ = (s.n - shared < t.prefix(s.n)) & (s.n > 0) & ~c.copy & (c.ids != NO_ID)
        keep = open_[s.d] & (df > 1)
        h, d, df = s.h[keep], s.d[keep], df[keep]
        order = np.lexsort((h, df, d))
        h, df = h[order], df[order]
        ends = np.cumsum(np.where(open_, shared, 0))
        n = s.n + np.bincount(_distinct(*_shingles(c, width, c.copy), c.n)[1], minlength=c.n) if c.copy.any() else s.n
        rows = []
        for i in range(c.n):
            lo, hi = ends[i] - shared[i] if open_[i] else 0, ends[i] if open_[i] else 0
            rows.append((
                None if c.ids[i] == NO_ID else int(c.ids[i]), int(n[i]), int(hi - lo), h[lo:hi].tobytes() if hi > lo else None, K.pack_ints(df[lo:hi]) if hi > lo else None,
                int(c.first[i]) if c.copy[i] else None, bool(c.repeated[i]),
            ))
        return pa.table([pa.array(x, ty) for x, ty in zip(zip(*rows, strict=True), _SET_ARROW.types, strict=True)], schema=_SET_ARROW)

    return sets


def _orders(tokens: np.ndarray, df: np.ndarray, orders: int) -> list[np.ndarray]:
    """Tokens under several global orders, rare ones first in each; the first order is by frequency, then hash."""
    out = [tokens]
    for k in range(1, orders):
        level = np.log2(df).astype(np.int64) if k % 2 else np.sqrt(df).astype(np.int64)
        out.append(tokens[np.lexsort((K.mix(tokens * _U(2 * k + 1)), level))])
    return out


def _prefix_tokens(t: Threshold, order: int):
    """For each prefix token under an order, an edge from each document to the token's first document.

    Rows are (gp, doc_id, n, shared, tokens, df): tokens of different groups never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, docs = [], []
            for gp, doc, n, shared, blob, df in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                take = int(t.prefix(np.int64(n))) - (n - shared)
                own = np.frombuffer(blob, np.uint64)
                if order:
                    own = _orders(own, K.unpack_ints(df).astype(np.float64), order + 1)[order]
                own = own[:take]
                if gp:
                    own = K.mix(own ^ _U(gp * 0x9E3779B97F4A7C15 % (1 << 64)))
                tokens.append(own.view(np.int64))
                docs.append(np.full(len(own), doc))
            if tokens:
                a, b = np.concatenate(tokens), np.concatenate(docs)
                by = np.lexsort((b, a))
                a, b = a[by], b[by]
                at, size = K.groups(a)
                # Equal tokens of a batch are linked here: one row a token, and a row (doc to first doc) for the rest.
                first = np.repeat(b[at], size)
                more = np.unique(np.stack([first[b != first], b[b != first]]), axis=1) if (b != first).any() else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(a[at], np.zeros(more.shape[1], np.int64))), pa.array(np.append(b[at], more[0])), pa.array(np.append(b[at], more[1]))], names=["token", "a", "b"])

    return run


def _token_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, a, b) of a partition as links between documents: a-b, and the first documents of equal tokens."""
    rows = [np.stack([b.column(i).to_numpy() for i in range(3)]) for b in batches]
    if not rows:
        return
    token, a, b = np.concatenate(rows, axis=1)
    order = np.lexsort((a, token))
    token, a, b = token[order], a[order], b[order]
    at, size = K.groups(token)
    first = np.repeat(a[at], size)
    joined = token != 0
    x, y = np.append(first[joined], a), np.append(a[joined], b)
    if (x != y).any():
        yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], names=["v", "root"])


class _Group:
    """Documents of a tile: sets, sizes, prefixes under every order, and a union-find over them."""

    def __init__(self, docs: list, n: list, shared: list, tokens: list, df: list, t: Threshold, orders: int):
        self.t, self.ids, self.n = t, np.array(docs, np.int64), np.array(n, np.int64)
        by_df = [np.frombuffer(x, np.uint64) for x in tokens]
        self.sets = [np.sort(x) for x in by_df]
        take = t.prefix(self.n) - (self.n - np.array(shared, np.int64))
        prefixes = [_orders(x, K.unpack_ints(f).astype(np.float64), orders) for x, f in zip(by_df, df, strict=True)]
        self.index, self.prefix = [], []
        for k in range(orders):
            own = [p[k][:m] for p, m in zip(prefixes, take, strict=True)]
            flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            order = np.argsort(flat, kind="stable")
            self.index.append((flat[order], of[order]))
            self.prefix.append(own)
        self.root = np.arange(len(docs))

    def roots(self, of: np.ndarray) -> np.ndarray:
        """The roots of documents; paths get shorter as they are read."""
        up = self.root[of]
        while not np.array_equal(up, further := self.root[up]):
            up = further
        self.root[of] = up
        return up

    def candidates(self, i: int, left: np.ndarray) -> np.ndarray:
        """Documents that share a prefix token with i under every order, with sizes that allow it, not joined yet.

        Pairs of two left documents are met once, from the smaller place.
        """
        found = None
        for (flat, of), own in zip(self.index, self.prefix, strict=True):
            lo, hi = np.searchsorted(flat, own[i]), np.searchsorted(flat, own[i], "right")
            met = np.concatenate([of[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            if found is None:
                met = np.unique(met)
                met = met[(met > i) | ~left[met]]
                met = met[self.t.sizes(self.n[met], self.n[i])]
                found = met[self.roots(met) != self.roots(np.array([i]))[0]]
            else:
                found = found[np.isin(found, met)]
            if not len(found):
                break
        return found

    def overlap(self, i: int, j: int) -> int:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        return int((b[at] == a).sum())

    def link(self, left: np.ndarray) -> tuple[list, list]:
        """Edges that join all similar pairs of a left document and any other; joined ones are not compared again."""
        edges: tuple[list, list] = ([], [])
        for i in np.flatnonzero(left).tolist():
            for j in self.candidates(i, left).tolist():
                a, b = self.roots(np.array([i, j])).tolist()
                if a != b and self.t.similar(self.overlap(i, j), self.n[i], self.n[j]):
                    self.root[max(a, b)] = min(a, b)
                    edges[0].append(self.ids[i])
                    edges[1].append(self.ids[j])
        return edges


_EDGE = "v long, root long"


def _compare(t: Threshold, orders: int):
    """Edges of all candidate groups (or tiles of large ones) of a partition: rows are gp, ti, tj, side, and a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key = np.stack([table[c].to_numpy() for c in ("gp", "ti", "tj")])
        order = np.lexsort(key)
        key = key[:, order]
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        out: tuple[list, list] = ([], [])
        for own in np.split(order, cuts):
            if len(own) < 2:
                continue
            rows = table.take(pa.array(own))
            side = rows["side"].to_numpy()
            g = _Group(*(rows[c].to_pylist() for c in ("doc_id", "n", "shared", "tokens", "df")), t, orders)
            # Sides: 0 meets every row of the tile; 1 meets 0 alone.
            edges = g.link(side == 0)
            out[0].extend(edges[0])
            out[1].extend(edges[1])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["v", "root"])

    return run


_SET_COLUMNS = ["doc_id", "n", "shared", "tokens", "df"]


def _tiles(sets: DataFrame, weights: DataFrame, done: DataFrame, tile: int) -> DataFrame:
    """Large groups cut into blocks of documents; a tile is two blocks. Documents joined to a pivot meet the others alone."""
    big = sets.join(weights.filter(F.col("weight") > tile).select("gp", "weight"), "gp").join(done, "doc_id", "left")
    closed = F.col("met").isNotNull()
    blocks = F.ceil(F.col("weight") / tile).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    big = big.withColumn("closed", closed).withColumn("blocks", blocks).withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # An open document of block i goes to tiles (i, j) and (j, i), j >= 0; a closed one of block j to tiles (k, blocks + j).
    left = F.transform(every, lambda j: F.struct(F.least(F.col("own"), j).alias("ti"), F.greatest(F.col("own"), j).alias("tj"), F.lit(0).alias("side")))
    across = F.transform(every, lambda j: F.struct(F.col("own").alias("ti"), (F.col("blocks") + j).alias("tj"), F.lit(0).alias("side")))
    shut = F.transform(every, lambda i: F.struct(i.alias("ti"), (F.col("blocks") + F.col("own")).alias("tj"), F.lit(1).alias("side")))
    at = F.explode(F.when(F.col("closed"), shut).otherwise(F.concat(left, across)))
    return big.withColumn("at", at).select("gp", F.col("at.ti").alias("ti"), F.col("at.tj").alias("tj"), F.col("at.side").alias("side"), *_SET_COLUMNS)


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100, orders: int = 3, tile: int = TILE) -> DataFrame:
    """The components that documents form by links of similar shingle sets: doc_id, n_shingles, component_id, copy_of.

    Words lose the case of A-Z. A set holds the distinct runs of ``width`` words (with fewer words, the whole
    sequence as one). Documents link when den * intersection >= num * union.

    1. Documents whose whole text a smaller id has (copy_of) stand for nothing but that id.
    2. In how many documents each shingle stands is found by an exchange of packed hashes. A set can only be similar
       to another if a token of its prefix, rare tokens first, stands in a second document; others are done.
    3. Documents that share a prefix token under the first global order form candidate groups; a group of more than
       ``tile`` shingles is parted again under each of the other orders, since candidates meet under all of them.
    4. In a group, two documents are candidates if they share prefix tokens under each of the global orders, and if
       their sizes allow it; candidates that are not joined yet are verified on their whole sets.
    A group that is still too large is first compared with one of its documents, PIVOTS times, and then cut into
    tiles that meet pairwise, but for documents already joined to the first pivot, which only meet the others. No
    pair of documents of one component need be compared twice, and no candidate is left out.

    Shingles are compared by 64-bit hashes, pair by pair of sets. Null, empty and wordless texts: 0 shingles, linked
    with nothing. Null doc_id: linked with nothing, component null. Rows with the same doc_id are one vertex, with
    the links of all their texts, and each row returns with its own n_shingles. Empty table: empty result. Other
    columns are not read.
    """
    t = Threshold(num, den)
    corpus = Corpus(docs, "ngram", doc_id=doc_id, text=text, carry=[])
    keep, bits = corpus.scratch.keep, corpus.bits(corpus.bytes // 6)
    sent = corpus.each_chunk(_send(width, bits), corpus.notes, SENT)
    notes = corpus.notes.unionByName(corpus.answers(sent, _frequencies, _DF))
    every = keep(corpus.each_chunk(_sets(width, bits, t), notes, _SET), "sets")

    sets = keep(_grouped(every.filter("shared > 0").select(F.lit(0).cast("long").alias("gp"), *_SET_COLUMNS), t, 0, corpus.scratch), "candidates")
    weights = keep(sets.groupBy("gp").agg(F.sum("shared").alias("weight")), "weights")
    small = sets.join(weights.filter(F.col("weight") <= tile).select("gp"), "gp")
    edges = [_compared(small, t, orders)]
    big = sets.join(weights.filter(F.col("weight") > tile).select("gp"), "gp")
    for k in range(1, orders):
        if weights.filter(F.col("weight") > tile).isEmpty():
            break
        big = keep(_grouped(big.select("gp", *_SET_COLUMNS), t, k, corpus.scratch), f"parted{k}")
        weights = keep(big.groupBy("gp").agg(F.sum("shared").alias("weight")), f"weights{k}")
        edges.append(_compared(big.join(weights.filter(F.col("weight") <= tile).select("gp"), "gp"), t, orders))
        big = big.join(weights.filter(F.col("weight") > tile).select("gp"), "gp")
    if not weights.filter(F.col("weight") > tile).isEmpty():
        edges.append(_large(big, weights, tile, t, orders, keep))
    # An id that stands in several rows ties the texts of all of them.
    edges.append(every.filter("several AND copy_of IS NOT NULL AND n > 0").select(F.col("doc_id").alias("v"), F.col("copy_of").alias("root")))
    found = components(keep(reduce(DataFrame.unionByName, edges), "edges"), corpus.scratch, "links")
    corpus.scratch.drop("candidates", "weights", "edges")

    base = every.select("doc_id", "n", "copy_of", F.when(F.col("several"), F.col("doc_id")).otherwise(F.coalesce("copy_of", "doc_id")).alias("of"))
    out = join_hot(base, found.select(F.col("v").alias("of"), F.col("root").alias("component_id")), "of", corpus.n, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "of")).otherwise(F.col("doc_id")).alias("component_id"), "copy_of")


def _grouped(sets: DataFrame, t: Threshold, order: int, scratch: Scratch) -> DataFrame:
    """The sets that share a prefix token under an order with another of their group, with the groups that these form."""
    tokens = sets.mapInArrow(_prefix_tokens(t, order), "token long, a long, b long")
    spread = F.when(F.col("token") == 0, F.xxhash64("a", "b")).otherwise(F.col("token"))
    groups = components(tokens.repartition(spread).mapInArrow(_token_links, _EDGE), scratch, f"groups{order}")
    members = groups.select(F.col("v").alias("doc_id"), F.col("root").alias("gp")).unionByName(groups.select(F.col("root").alias("doc_id"), F.col("root").alias("gp")).distinct())
    return sets.drop("gp").join(members, "doc_id").select("gp", *_SET_COLUMNS)


def _compared(sets: DataFrame, t: Threshold, orders: int) -> DataFrame:
    """Edges of groups that one task holds."""
    rows = sets.select("gp", F.lit(0).alias("ti"), F.lit(0).alias("tj"), F.lit(0).alias("side"), *_SET_COLUMNS)
    return rows.repartition("gp").mapInArrow(_compare(t, orders), _EDGE)


def _large(sets: DataFrame, weights: DataFrame, tile: int, t: Threshold, orders: int, keep) -> DataFrame:
    """Edges of the groups that are too large for one task."""
    big, done, edges = sets, None, None
    for k in range(PIVOTS):
        rest = big if done is None else big.join(done.select("doc_id"), "doc_id", "left_anti")
        pivot = rest.groupBy("gp").agg(F.min("doc_id").alias("doc_id"))
        pivot = rest.join(pivot, ["gp", "doc_id"]).dropDuplicates(["gp"])
        blocks = F.ceil(F.col("weight") * 4 / tile).cast("int")
        at = big.join(weights, "gp").withColumn("tj", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("side", F.lit(1))
        to = pivot.join(weights, "gp").withColumn("tj", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))
        rows = at.select("gp", F.lit(0).alias("ti"), "tj", "side", *_SET_COLUMNS).unionByName(to.select("gp", F.lit(0).alias("ti"), "tj", "side", *_SET_COLUMNS))
        got = keep(rows.repartition("gp", "tj").mapInArrow(_compare(t, orders), _EDGE), f"pivot{k}")
        edges = got if edges is None else edges.unionByName(got)
        if k == 0:  # joined to the first pivot, all these are one component
            done = keep(got.select(F.col("root").alias("doc_id")).unionByName(got.select(F.col("v").alias("doc_id"))).distinct().withColumn("met", F.lit(1)), "met")
    rows = _tiles(sets, weights, done, tile)
    return edges.unionByName(keep(rows.repartition("gp", "ti", "tj").mapInArrow(_compare(t, orders), _EDGE), "tiles"))
