"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import kernels as K
from corpusmill.plans.storage import Scratch

#: Bounds of the model: labelled rows that are learnt from, examples in the index and terms in them, examples in a block
#: of it, neighbours that vote.
ROWS, EXAMPLES, POSTINGS, BLOCK, NEIGHBOURS = 30_000, 1536, 1 << 23, 64, 15
#: Terms that one in COMMON examples hold (the DENSE most frequent of them) are rows of a matrix instead of postings;
#: GROUP texts are multiplied with it at once.
COMMON, DENSE, GROUP = 32, 768, 128
#: Once queries have met TRIED postings, bounds must have spared half of them, or else all postings are read without.
TRIED = 1 << 20
#: One in so many labelled rows calibrates the votes and is no example.
FOLDS = 5
#: How much a term's say grows with what its presence tells of the label (its log-likelihood ratio, in nats).
GAIN = 4.0
#: Besides whole words, the first 4, 5 and 6 bytes of longer words are terms: endings vary, stems recur.
_STEMS = (4, 5, 6)
#: Terms are the first 50 bits of hashes; a text's place among at most 16384 fits in the rest.
_DOC_BITS = np.uint64(14)
_SLOTS = 22


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts (words of letters in lower case, and their stems), and each one's text."""
    lower = _FOLD[data]
    at = np.ones(len(lower) + 1, bool)
    if len(lower):
        at[:-1] = lower == 0
        prev = np.append(True, at[:-2] if len(lower) > 1 else np.zeros(0, bool))[: len(lower)]
        begins = offsets[:-1][offsets[:-1] < len(lower)]
        prev[begins] = True
        starts = np.flatnonzero(~at[:-1] & prev)
        nxt = np.append(at[1:-1], True)
        nxt[offsets[1:][np.diff(offsets) > 0] - 1] = True
        ends = np.flatnonzero(~at[:-1] & nxt) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    hashes, docs = [K.span_hashes(data, starts, ends, K.LOWER)], [doc]
    for n in _STEMS:
        long = ends - starts > n
        hashes.append(K.span_hashes(data, starts[long], starts[long] + n, K.LOWER, seed=n))
        docs.append(doc[long])
    return np.concatenate(hashes) >> _DOC_BITS, np.concatenate(docs)


#: A-Z in lower case; bytes that part words (ASCII but letters and digits) are 0.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 0


class Vocabulary:
    """Sorted terms, found by their first bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.start: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.terms)

    def __getstate__(self) -> np.ndarray:
        return self.terms

    def __setstate__(self, terms: np.ndarray) -> None:
        self.__init__(terms)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each term, or -1."""
        if self.start is None:
            self.start = np.searchsorted(self.terms, np.arange((1 << _SLOTS) + 1, dtype=np.uint64) << np.uint64(50 - _SLOTS)).astype(np.int32)
            self.most = int(np.diff(self.start).max())
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(50 - _SLOTS)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        for i in range(self.most):
            own = np.flatnonzero(at + i < end)
            own = own[self.terms[at[own] + i] == h[own]]
            out[own] = at[own] + i
        return out


def _counts(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary | None = None, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs with their numbers, by text; terms as places in a vocabulary, if given.

    rest, one number a text, then gets what _unseen says of its other terms.
    """
    h, d = _terms(data, offsets)
    if vocabulary is not None:
        at = vocabulary.places(h)
        known = np.flatnonzero(at >= 0)
        if rest is not None:
            rest[:] = _unseen(h[at < 0], d[at < 0], len(rest))
        key = np.sort(d[known].astype(np.uint64) << np.uint64(32) | at[known].astype(np.uint64))
        at, size = K.groups(key)
        return (key[at] >> np.uint64(32)).astype(np.int64), (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), size
    key = np.sort(h << _DOC_BITS | d.astype(np.uint64))
    at, size = K.groups(key)
    d, h = (key[at] & np.uint64((1 << 14) - 1)).astype(np.int64), key[at] >> _DOC_BITS
    order = np.argsort(d, kind="stable")
    return d[order], h[order], size[order]


def _unseen(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Of each text, the sum of (1 + log tf) squared over its terms of no example."""
    key = np.sort(h << _DOC_BITS | d.astype(np.uint64))
    at, size = K.groups(key)
    part = 1 + np.log(np.arange(1, int(size.max(initial=1)) + 1))
    return np.bincount((key[at] & np.uint64((1 << 14) - 1)).astype(np.int64), part[size - 1] ** 2, n)


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A column's texts a few MB at a time: first, last, bytes, offsets."""
    data, offsets = K.flatten(column)
    for a, b in K.slices(offsets):
        for x in range(a, b, 1 << 14):
            y = min(b, x + (1 << 14))
            yield x, y, data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, one range after the other, and the lengths of the ranges."""
    n = end - start
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), n


class Index:
    """Examples as TF-IDF unit vectors over all their terms: an inverted index in blocks of BLOCK examples.

    A term's entries are the blocks that hold it, each with the largest weight there and its postings. Weights are
    (1 + log tf) * idf * (1 + GAIN * gain), gain being what the term's presence tells of the label. A text's terms that
    no example has meet none, but make its vector longer: they weigh ``unseen``, the idf of a term of one document.
    """

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, toxic: np.ndarray, prior: float, unseen: float = 0.0):
        self.vocabulary, self.say, self.prior, self.toxic, self.unseen = Vocabulary(vocabulary), weight, prior, toxic, unseen
        self.slope, self.shift = 1.0, 0.0
        if (np.diff(terms) < 0).any():
            order = np.lexsort((rows, terms))
            rows, terms, tf = rows[order], terms[order], tf[order]
        self.rows, self.tf, self.weight = rows.astype(np.int32), tf.astype(np.int32), self._weights(rows, terms, tf, len(toxic))
        at, _ = K.pair_groups(terms, rows // BLOCK)
        self.post = np.append(at, len(rows))
        self.block = (self.rows[at] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.entry = np.searchsorted(terms[at], np.arange(len(vocabulary) + 1))
        self.blocks = max(1, -(-len(toxic) // BLOCK))
        n = np.diff(self.post[self.entry])
        common = np.flatnonzero(n * COMMON >= max(1, len(toxic)))
        common = np.sort(common[np.argsort(-n[common], kind="stable")[:DENSE]])
        self.column = np.full(len(vocabulary), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        at, n = _ranges(self.post[self.entry[common]], self.post[self.entry[common + 1]])
        self.dense[np.repeat(np.arange(len(common)), n), self.rows[at]] = self.weight[at]
        self.places = self.begin = None  # for reading without bounds
        self.read = self.met = 0  # postings that queries with bounds have looked at, and all of their terms

    def __getstate__(self) -> tuple:
        """What the index is made of, packed: a few bytes a posting travel, and each task's process makes the index."""
        counts = np.diff(self.post[self.entry])
        return K.pack_ints(self.vocabulary.terms, rising=True), self.say, K.pack_ints(counts), K.pack_ints(self.rows), K.pack_ints(self.tf), self.toxic, self.prior, self.unseen, self.slope, self.shift

    def __setstate__(self, state: tuple) -> None:
        vocabulary, say, counts, rows, tf, toxic, prior, unseen, slope, shift = state
        terms = np.repeat(np.arange(len(say)), K.unpack_ints(counts).astype(np.int64))
        self.__init__(K.unpack_ints(vocabulary), say, K.unpack_ints(rows).astype(np.int64), terms, K.unpack_ints(tf).astype(np.float64), toxic, prior, unseen)
        self.slope, self.shift = slope, shift

    def _weights(self, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, n: int, rest: np.ndarray | float = 0.0) -> np.ndarray:
        w = (1 + np.log(tf)) * self.say[terms]
        norm = np.sqrt(np.bincount(rows, w * w, n) + rest * self.unseen**2)
        return w / norm[rows]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 (ties: smaller place), exactly.

        scores holds what the common terms give each example, if the terms are but the others. Each block has an upper
        bound: its highest such score and its entries' largest weights. The blocks of the highest bounds are read
        first; of the others only those whose bound reaches the k-th best cosine: other postings are not touched.
        Where bounds have been seen to spare few postings, asking them takes longer than reading all: both are exact.
        """
        if scores is None:
            column = self.column[terms]
            scores = weights[column >= 0] @ self.dense[column[column >= 0]]
            terms, weights = terms[column < 0], weights[column < 0]
        if self.met >= TRIED and 2 * self.read > self.met:
            if self.places is None:
                self.places, self.begin = self.rows.astype(np.intp), self.post[self.entry]
            at, n = _ranges(self.begin[terms], self.begin[terms + 1])
            said = self.weight.take(at)
            said *= np.repeat(weights, n)
            scores = scores + np.bincount(self.places.take(at), said, len(scores))
        else:
            scores = self._bounded(terms, weights, k, scores)
        near = np.flatnonzero(scores >= max(self._least(scores, k) - 1e-9, 1e-15))
        best = near[np.lexsort((near, -np.round(scores[near], 12)))][:k]
        return best, scores[best]

    def _bounded(self, terms: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray) -> np.ndarray:
        """The scores, whole where a block's bound may reach the k best."""
        self.met += int((self.post[self.entry[terms + 1]] - self.post[self.entry[terms]]).sum())
        entry, n = _ranges(self.entry[terms], self.entry[terms + 1])
        say, block = np.repeat(weights, n), self.block[entry]
        bound = scores.reshape(self.blocks, BLOCK).max(axis=1) + np.bincount(block, self.most[entry] * say, self.blocks)
        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[: max(2, -(-2 * k // BLOCK))]] = True
        for wanted in (lambda: first, lambda: ~first & (bound > 0) & (bound >= self._least(scores, k) - 1e-9)):
            own = np.flatnonzero(wanted()[block])
            at, m = _ranges(self.post[entry[own]], self.post[entry[own] + 1])
            self.read += len(at)
            scores = scores + np.bincount(self.rows[at], self.weight[at] * np.repeat(say[own], m), len(scores))
        return scores

    @staticmethod
    def _least(scores: np.ndarray, k: int) -> float:
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else 0.0

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        """The chance of label 1 at a share of votes: logistic in the share's log odds, as fitted on rows apart."""
        p = np.clip(share, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift))) if self.prior else np.zeros(len(p))

    def calibrate(self, share: np.ndarray, label: np.ndarray) -> None:
        """Fit slope (above 0) and shift by Newton steps on the log loss, with targets drawn in from 0 and 1."""
        n1, n0 = float(label.sum()), float((1 - label).sum())
        if not n1 or not n0:
            return
        y = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        p = np.clip(share, 1e-4, 1 - 1e-4)
        x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], axis=1)
        at = np.array([1.0, 0.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-x @ at))
            grad = x.T @ (q - y) + 1e-3 * (at - (1, 0))
            step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), grad)
            at = at - step / max(1.0, float(np.abs(step).max()))
        self.slope, self.shift = max(float(at[0]), 1e-3), float(at[1])

    def shares(self, data: np.ndarray, offsets: np.ndarray, seen: dict, k: int = NEIGHBOURS) -> tuple[np.ndarray, list[list[int]]]:
        """Each text's share of toxic votes, and the places of the examples that voted; seen keeps what equal vectors got."""
        n = len(offsets) - 1
        rest = np.zeros(n)
        d, t, tf = _counts(data, offsets, self.vocabulary, rest)
        out, evidence = np.full(n, self.prior * 0.5), [[] for _ in range(n)]
        if not len(d):
            return out, evidence
        w, column = self._weights(d, t, tf, n, rest), self.column[t]
        cut = np.searchsorted(d, np.arange(n + 1))
        for lo in range(0, n, GROUP):
            hi = min(n, lo + GROUP)
            own = slice(cut[lo], cut[hi])
            common = np.flatnonzero(column[own] >= 0) + cut[lo]
            asked = np.zeros((hi - lo, len(self.dense)))
            asked[d[common] - lo, column[common]] = w[common]
            scores = asked @ self.dense
            for i in range(lo, hi):
                a, b = cut[i], cut[i + 1]
                if a == b:
                    continue
                key = hashlib.blake2b(t[a:b].tobytes() + tf[a:b].tobytes() + rest[i].tobytes(), digest_size=16).digest()
                if key not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    rare = column[a:b] < 0
                    rows, cosine = self.nearest(t[a:b][rare], w[a:b][rare], k, scores[i - lo])
                    # Votes fall with the distance; a small vote of the prior steadies few or far neighbours.
                    vote = cosine / (1.05 - np.minimum(cosine, 1.0))
                    seen[key] = (float((vote @ self.toxic[rows] + 0.05 * self.prior) / (vote.sum() + 0.05)), rows.tolist())
                out[i], evidence[i] = seen[key]
        return out, evidence


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two least hashes of a document's runs of three words, which near copies mostly share."""
    for batch in batches:
        for a, b, data, offsets in _parts(batch.column(1)):
            starts, ends, doc = K.word_spans(data, offsets)
            words = K.span_hashes(data, starts, ends, K.LOWER)
            runs = K.rolling(words, 3)
            own = doc[: len(runs)] == doc[2 : 2 + len(runs)]
            few = np.bincount(doc, minlength=b - a)[doc] < 3
            h, d = np.append(runs[own], words[few]), np.append(doc[: len(runs)][own], doc[few])
            signs = []
            for salt in (1, 2):
                low = np.full(b - a, np.uint64((1 << 64) - 1))
                np.minimum.at(low, d, K.mix(h * np.uint64(2 * salt + 1)))
                signs.append(pa.array(low.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *signs], names=["l_id", "toxic", "sign0", "sign1"])


def _class_counts(vocabulary: Vocabulary, labelled: bool):  # the closure holds at most POSTINGS terms
    """In how many documents of a partition each term stands: (place, toxic, all). Columns: text, and label if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, len(vocabulary)), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) if labelled else np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in _parts(batch.column(0)):
                d, t, _ = _counts(data, offsets, vocabulary)
                both[1] += np.bincount(t, minlength=len(vocabulary))
                if labelled:
                    both[0] += np.bincount(t, label[a:b][d], len(vocabulary)).astype(np.int64)
        at = np.flatnonzero(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], names=["place", "toxic", "n"])

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y, data, offsets in _parts(batch.column(1)):
            d, t, tf = _counts(data, offsets)
            cuts = np.searchsorted(d, np.arange(y - x + 1))
            rows = [(b - a, K.pack_ints(t[a:b], rising=True), K.pack_ints(tf[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), batch.column(2).slice(x, y - x), *columns], names=["doc_id", "toxic", "n", "terms", "tf"])


def _sums(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by place, of at most as many rows as the vocabulary has terms."""
    got = rows.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, size))
    out[:, got["place"].to_numpy(np.int64)] = got[["toxic", "n"]].to_numpy(np.float64).T
    return out[0], out[1]


def gains(toxic: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """Of each term, how much likelier its labels are at the share it has than at the prior, in nats."""
    part = lambda k, rate: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(n, 1) / max(rate, 1e-9)), 0)
    return np.maximum(0, part(toxic, prior) + part(n - toxic, 1 - prior))


def fit(docs: DataFrame, examples: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS, most: int = EXAMPLES, postings: int = POSTINGS) -> tuple[Index, list[int]]:
    """An index of labelled examples, and their doc_ids. ``examples`` has doc_id and label and only what may be learnt.

    At most ``rows`` labelled documents (a documented bound), by hash of the id, are learnt from. One in FOLDS of them
    calibrates; of the others at most ``most`` documents of at most ``postings`` terms together (documented bounds)
    become examples, by hash, toxic and clean alike. All terms of the examples make the space. Their idf is counted
    over all of ``docs``; their gain over the labelled documents that do not calibrate, one of each group of near
    copies. Votes are calibrated on the documents apart.

    Null ids and labels are left out; of an id labelled twice the largest label counts; where an id repeats in docs,
    each of its rows is one. Null texts are empty; texts without terms are no examples. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = examples.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("l_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    picked = scratch.keep(marks.orderBy(F.xxhash64("l_id"), "l_id").limit(rows), "picked")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most ``rows`` ids are broadcast, so that no other text moves.
    known = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(91)), F.lit(FOLDS)) == 0).alias("apart"))
    known = scratch.keep(known, "known")
    learnt = known.filter("NOT apart")

    vectors = scratch.keep(learnt.select("doc_id", "text", "toxic").mapInArrow(_vectors, "doc_id long, toxic int, n long, terms binary, tf binary").filter("n > 0"), "vectors")
    sizes = vectors.select("doc_id", "n").toPandas()
    sizes = sizes.assign(rank=K.mix(sizes["doc_id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sort_values(["rank", "n"])[:most]
    chosen = sizes[sizes["n"].cumsum() <= postings]["doc_id"].unique()
    wanted = docs.sparkSession.createDataFrame([(int(i),) for i in chosen], "doc_id long")
    got = vectors.join(F.broadcast(wanted), "doc_id").collect()
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r.terms)))[: most]
    own = np.repeat(np.arange(len(got)), [r.n for r in got])
    flat = lambda name: np.concatenate([K.unpack_ints(bytes(r[name])) for r in got]) if got else np.zeros(0, np.uint64)
    terms, at = np.unique(flat("terms"), return_inverse=True)

    # Near copies would lend chance words the weight of many documents: one stands for those with equal signatures.
    signed = learnt.select("doc_id", "text", "toxic").mapInArrow(_signed, "l_id long, toxic int, sign0 long, sign1 long")
    once = signed.groupBy("sign0", "sign1").agg(F.min("l_id").alias("s_id")).select("s_id").distinct()
    once = scratch.keep(learnt.join(F.broadcast(once), F.col("doc_id") == F.col("s_id")).select("text", "toxic"), "once")
    totals = once.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).first()
    prior = (totals.toxic or 0) / max(1, totals.n)
    vocabulary = Vocabulary(terms)
    counts = "place long, toxic long, n long"
    toxic, n = _sums(once.mapInArrow(_class_counts(vocabulary, True), counts), len(terms))
    _, df = _sums(texts.select("text").mapInArrow(_class_counts(vocabulary, False), counts), len(terms))
    n_docs = docs.count()
    idf = np.log((1 + n_docs) / np.maximum(df, 1))
    say, tf = idf * (1 + GAIN * gains(toxic, n, prior)), flat("tf").astype(np.float64)
    # Examples whose weightiest term is the same stand in one block, so that blocks differ in their bounds.
    marked = np.array([r.toxic == 1 for r in got], np.float64)
    by = np.lexsort(((1 + np.log(tf)) * say[at], own))
    top = at[by][np.cumsum([r.n for r in got], dtype=np.int64) - 1]
    order = np.lexsort((top, marked))
    place = np.empty(len(got), np.int64)
    place[order] = np.arange(len(got))
    index = Index(terms, say, place[own], at, tf, marked[order], prior, math.log(1 + n_docs))
    if got:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        fold = known.filter("apart").select("text", "toxic").mapInArrow(_voted(shared), "share double, toxic int").toPandas().sort_values(["share", "toxic"])
        shared.destroy()
        index.calibrate(fold["share"].to_numpy(np.float64), fold["toxic"].to_numpy(np.float64))
    scratch.close()
    return index, [got[i].doc_id for i in order.tolist()]


def _voted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _parts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.shares(data, offsets, {})[0]), batch.column(1).slice(a, b - a)], names=["share", "toxic"])

    return run


def score(docs: DataFrame, index: Index, names: list[int], *, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, score and evidence (doc_ids of the examples that voted, nearest first) for each row of docs.

    With ``carry`` all columns of docs (but any named score or evidence) stand before score and evidence. The score is
    the calibrated share of toxic votes among the NEIGHBOURS nearest examples, weighted by cosine over distance.
    Null, empty and other texts without a term of the index: what half the training share gives, no evidence. Whole
    texts of any length are read; no rows meet. Null doc_id stays null, repeated rows return repeated. No labelled
    documents: 0 for all. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((index, np.array(names, np.int64)))  # bounded by POSTINGS and EXAMPLES
    rows = docs.drop("score", "evidence") if carry else docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    at = rows.columns.index(text)
    out = [f for f in rows.schema.fields if carry or f.name == "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = shared.value
        seen: dict = {}
        for batch in batches:
            for a, b, data, offsets in _parts(batch.column(at)):
                got, evidence = model.shares(data, offsets, seen)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(out)]), pa.array(model.calibrated(got)), pa.array([ids[e] for e in evidence], pa.list_(pa.int64()))], names=[*(f.name for f in out), "score", "evidence"])
        K.give_back()

    schema = T.StructType([*out, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", part: int = 2, parts: int = 4):
    """Whether crc32 of the id as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part
