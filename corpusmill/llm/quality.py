"""Quality rules: document statistics, and gradient-boosted trees over them, flattened into node arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K

#: The model is fitted on so many labelled documents at most (a documented bound), by hash of the id.
EXAMPLES = 20_000
#: A text is kept from this score on.
KEEP_FROM = 0.5
REPEAT_WORDS = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_digits", "n_marks", "n_ends", "n_lines", "n_distinct", "n_symbol_words")
#: Features of the model: (name, numerator, denominator, direction). A score never rises with a feature of direction -1.
FEATURES = (
    ("word_length", "word_chars", "n_words", 0),
    ("symbols", "n_symbols", "n_words", -1),
    ("symbol_words", "n_symbol_words", "n_words", -1),
    ("dup_lines", "n_dup_lines", "n_lines", -1),
    ("repeat_words", "n_repeat_words", "n_words", -1),
    ("upper", "n_upper", "n_letters", -1),
    ("digits", "n_digits", "word_chars", 0),
    ("marks", "n_marks", "n_words", -1),
    ("ends", "n_ends", "n_words", 0),
    ("line_words", "n_words", "n_lines", 0),
    ("distinct", "n_distinct", "n_words", 0),
)
_SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK, _END = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_MARK[ord("!")] = True
_END[[ord(c) for c in ".,;:?"]] = True
_DOC = np.uint64(14)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])


def _order(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sorted by (hash, text), and starts and lengths of the runs of equal pairs."""
    key = (hashes >> _DOC << _DOC) | doc.astype(np.uint64)
    order = np.argsort(key)
    if ((key[order][1:] == key[order][:-1]) & (hashes[order][1:] != hashes[order][:-1])).any():  # alike but for the last bits
        order = np.lexsort((hashes, doc))
    at, size = K.pair_groups(hashes[order], doc[order])
    return order, at, size


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics of at most 16384 whole texts."""
    n = len(offsets) - 1
    starts, ends, doc = K.word_spans(data, offsets)
    hashes = K.span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    out = {"n_words": np.diff(first)}
    heads = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
    words = np.bincount(doc, heads[ends] - heads[starts], n) if len(starts) else np.zeros(n)
    out["word_chars"] = words.astype(np.int64)
    symbol = np.append(0, np.cumsum(_SYMBOL[data], dtype=np.int64))
    out["n_symbols"] = np.diff(symbol[offsets])
    out["n_symbol_words"] = np.bincount(doc, symbol[ends] > symbol[starts], n).astype(np.int64) if len(starts) else np.zeros(n, np.int64)
    for name, flags in (("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_ends", _END)):
        out[name] = _per_text(flags[data], offsets)
    # Lines that hold a word; those equal to an earlier one of the same text.
    newline = data == 10
    cut = np.unique(np.concatenate([np.flatnonzero(newline) + 1, offsets[:-1]]))
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data)) if len(cut) else cut
    stop = stop - newline[stop - 1] if len(cut) else stop
    of = np.searchsorted(offsets, cut, "right") - 1
    held = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
    cut, stop, of = cut[held], stop[held], of[held]
    out["n_lines"] = np.bincount(of, minlength=n)
    order, at, size = _order(K.span_hashes(data, cut, stop), of)
    out["n_dup_lines"] = np.bincount(of[order[at]], size - 1, n).astype(np.int64) if len(at) else np.zeros(n, np.int64)
    order, at, size = _order(hashes, doc)
    out["n_distinct"] = np.bincount(doc[order[at]], minlength=n) if len(at) else np.zeros(n, np.int64)
    # Words in windows that a text holds twice or more.
    rolled = K.rolling(hashes, REPEAT_WORDS)
    own = np.flatnonzero(doc[: len(rolled)] == doc[REPEAT_WORDS - 1 : REPEAT_WORDS - 1 + len(rolled)]) if len(rolled) else np.zeros(0, np.int64)
    order, at, size = _order(rolled[own], doc[own])
    again = own[order[np.repeat(size > 1, size)]]
    covered = K.cover(again, again + REPEAT_WORDS, len(starts))
    out["n_repeat_words"] = np.bincount(doc, covered, n).astype(np.int64) if len(starts) else np.zeros(n, np.int64)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[a] / np.maximum(1, stats[b]) for _, a, b, _ in FEATURES], axis=1)


class Trees:
    """Gradient-boosted trees for logistic loss, in flat arrays: feature, threshold, left, right, value."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1) if len(y) else x
        for _ in range(self.trees if len(y) and 0 < y.mean() < 1 else 0):
            p = 1 / (1 + np.exp(-raw))
            self.roots.append(self._grow(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth, signs, -np.inf, np.inf, raw))
        for name, kind in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float), ("roots", np.int64)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def _node(self, feature=-1, threshold=0.0, value=0.0) -> int:
        for xs, v in ((self.feature, feature), (self.threshold, threshold), (self.left, -1), (self.right, -1), (self.value, value)):
            xs.append(v)
        return len(self.feature) - 1

    def _grow(self, binned, cuts, g, h, rows, depth, signs, low, high, raw) -> int:
        best = (1e-6, None)
        G, H = g[rows].sum(), h[rows].sum()
        weight = lambda a, b: np.clip(a / (b + self.ridge), low, high)
        gain_of = lambda a, b: 2 * a * weight(a, b) - (b + self.ridge) * weight(a, b) ** 2
        for f, cut in enumerate(cuts if depth else []):
            if not len(cut):
                continue
            own = binned[rows, f]
            n = np.cumsum(np.bincount(own, minlength=len(cut) + 1))[:-1]
            a, b = (np.cumsum(np.bincount(own, v[rows], len(cut) + 1))[:-1] for v in (g, h))
            gain = gain_of(a, b) + gain_of(G - a, H - b) - gain_of(G, H)
            ok = (n >= self.least) & (len(rows) - n >= self.least)
            if signs[f]:
                ok &= signs[f] * (weight(G - a, H - b) - weight(a, b)) >= 0
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        if best[1] is None:
            value = self.rate * float(weight(G, H))
            raw[rows] += value
            return self._node(value=value)
        f, k = best[1]
        node = self._node(f, float(cuts[f][k]))
        side = binned[rows, f] <= k
        bounds = [(low, high), (low, high)]
        if signs[f]:  # the sides' values stay apart, on the right sides of their middle
            a, b = rows[side], rows[~side]
            middle = float(weight(g[a].sum(), h[a].sum()) + weight(g[b].sum(), h[b].sum())) / 2
            bounds = [(low, middle), (middle, high)] if signs[f] > 0 else [(middle, high), (low, middle)]
        self.left[node] = self._grow(binned, cuts, g, h, rows[side], depth - 1, signs, *bounds[0], raw)
        self.right[node] = self._grow(binned, cuts, g, h, rows[~side], depth - 1, signs, *bounds[1], raw)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            raw += self.value[at]
        return 1 / (1 + np.exp(-raw))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    data, offsets = K.flatten(column)
    for a, b in K.slices(offsets):
        for x in range(a, b, 1 << 14):
            y = min(b, x + (1 << 14))
            yield x, y, statistics(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, stats in _slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *(pa.array(stats[c]) for c in BASE + MORE)], names=["label", *BASE, *MORE])


def fit(docs: DataFrame, examples: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = EXAMPLES) -> Trees:
    """Trees fitted on at most ``most`` labelled rows; without labels of both kinds, a model that keeps all.

    Null ids and null labels are left out; of an id labelled twice the largest label counts. Where ids repeat in
    ``docs``, about ``most`` rows are learnt from, by hash of id and text. Other columns are not read.
    """
    chosen = examples.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("l_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("d_text")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))
    if (n := rows.select("d_id").count()) > most:  # ids repeat
        rows = rows.filter(F.pmod(F.xxhash64("d_id", "d_text"), F.lit(n)) < most)
    rows = rows.select("d_text", "label")
    got = rows.mapInArrow(_measured, ", ".join(["label int", *(f"{c} long" for c in BASE + MORE)])).toPandas()
    got = got.sort_values([*BASE, *MORE, "label"], ignore_index=True)  # reruns agree
    if not len(got):
        return Trees().fit(np.zeros((0, len(FEATURES))), np.zeros(0), [])
    return Trees().fit(features({c: got[c].to_numpy() for c in BASE + MORE}), got["label"].to_numpy().astype(float), [f[3] for f in FEATURES])


def score(docs: DataFrame, model: Trees, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, all statistics, score (of quality 1), base_failed and kept, for each row of docs.

    base_failed: under 20 words, or over 30% of the words in windows of REPEAT_WORDS words that the text repeats.
    kept: base has not failed and the score is KEEP_FROM or more. Null, empty and wordless texts: zeros, base
    failed. Whole texts of any length; no rows meet. Null doc_id stays null, repeated rows return repeated. Empty
    table: empty result. Other columns are not read. Words, lines and windows of one text are told apart by 64-bit
    hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number and depth of the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, stats in _slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(stats[c]) for c in BASE + MORE), pa.array(shared.value.score(features(stats)))], names=["doc_id", *BASE, *MORE, "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in BASE + MORE), "score double"]))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEEP_FROM))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
