"""Phrase collocations from generalised suffix automata of shards, with global counts and subsumption along links.

Texts become shards of word numbers once. Each shard's automaton of bounded depth enumerates its phrases with their
endpos counts; buckets of phrase hashes add the counts up and answer each shard which of its phrases are frequent.
A phrase of d words can only be frequent if both of its parts of d - 1 words are: each pass goes one word deeper,
where the passes before have left something.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K
from corpusmill.llm.exchange import BUCKET_HASHES, MOST_TIMES, ROOT_FROM
from corpusmill.plans.storage import Scratch

#: Bytes of text in a shard; grows with the root of the corpus beyond ROOT_FROM bytes.
SHARD_BYTES = 4 << 20
#: Rows that one task ranks at once, and lists that are merged at once.
RANKED, FAN_IN = 1 << 16, 16
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_SHARD = "shard long, words long, langs array<string>, counts array<long>, data binary"
_NOTE = "n_shard long, n_level int, n_bucket int, n_data binary"
_OUT = "bucket int, s_shard long, s_data binary, lang string, phrase string, words int, f long"
_OUT_ARROW = pa.schema([("bucket", pa.int32()), ("s_shard", pa.int64()), ("s_data", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
_NOTE_ARROW = pa.schema([("n_shard", pa.int64()), ("n_level", pa.int32()), ("n_bucket", pa.int32()), ("n_data", pa.binary())])

#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2


def _shard(texts: pa.Array, langs: list[str]) -> tuple[int, list[str], list[int], bytes]:
    """Number of words, languages and their words, and the packed words of some texts."""
    data, offsets = K.flatten(texts)
    kind = _KIND[data]
    inside, edge = kind == 0, np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # texts begin and end
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])[: len(data)]))
    ends = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True)[: len(data)])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(kind == 2, dtype=np.int32 if len(data) < 1 << 31 else np.int64)[starts] + doc
    del kind, inside, edge
    begins = np.append(True, breaks[1:] != breaks[:-1]) if len(starts) else np.zeros(0, bool)
    names, own = np.unique(np.array(langs, object), return_inverse=True) if langs else (np.zeros(0, object), np.zeros(0, np.int64))
    lang = own[doc]
    name_data = np.frombuffer("".join(names).encode(), np.uint8)
    name_ends = np.cumsum([len(n.encode()) for n in names], dtype=np.int64)
    salt = K.span_hashes(name_data, np.append(0, name_ends[:-1]).astype(np.int64), name_ends, seed=9)
    hashes = K.mix(K.span_hashes(data, starts, ends, K.LOWER) * _ODD + salt[lang])
    known, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    word = K.cover(starts[first], ends[first], len(data))
    order = np.argsort(starts[first])
    # The bytes stand in the order of the text; lengths follow that order, and so do the numbers of the words.
    blob = K.bundle(K.pack_ints(known, rising=True), K.pack_ints(ids), K.pack_bits(begins), K.pack_ints(lang[first]), K.pack_ints(order), K.pack_ints((ends - starts)[first][order]), K.pack_bytes(K.LOWER[data[word]].tobytes()))
    return len(starts), names.tolist(), np.bincount(lang, minlength=len(names)).tolist(), blob


def _shards(size: int):
    """Texts of a task, gathered into shards of about ``size`` bytes; a longer text is one by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            nonlocal made, held
            rows = pa.Table.from_batches(held).combine_chunks()
            n, names, counts, blob = _shard(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["lang"].to_pylist())
            out = pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), pa.array([n]), pa.array([names], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["shard", "words", "langs", "counts", "data"])
            made, held = made + 1, []
            K.give_back()
            return out

        full = 0
        for batch in batches:
            offsets = K.flatten(batch.column(1))[1]
            for a, b in K.slices(offsets, size):
                held.append(batch.slice(a, b - a))
                full += int(offsets[b] - offsets[a])
                if full >= size:
                    yield shard()
                    full = 0
        if held:
            yield shard()

    return run


class Automaton:
    """The suffix automaton of a shard's pieces, of bounded depth, over word numbers.

    Level d has a node for each distinct phrase of d words that the passes so far let live: where it first ends, how
    often it stands here (the size of its endpos), its link (the node of the phrase without its first word) and its
    head (without its last). Nodes are made by sorting places by the phrase that ends there, level by level, which
    is the tree of suffix links; a node and the only node that links to it are one state if they end at the same places.
    """

    def __init__(self, blob: bytes):
        known, ids, begins, lang, order, sizes, text = K.unbundle(blob)
        self.ids = K.unpack_ints(ids).astype(np.int64)
        self.begins = K.unpack_bits(begins, len(self.ids))
        self.lang, self._words = K.unpack_ints(lang).astype(np.int64), (order, sizes, text)
        self.hashes, self.nodes = [K.unpack_ints(known)], [self.ids]
        n = len(self.hashes[0])
        self.counts = [np.bincount(self.ids, minlength=n)]
        first = np.zeros(n, np.int64)
        first[self.ids[::-1]] = np.arange(len(self.ids))[::-1]
        self.first, self.links, self.heads = [first], [np.full(n, -1)], [np.full(n, -1)]
        self.live = np.ones(len(self.ids), bool)

    def deepen(self, frequent: np.ndarray | None) -> None:
        """One more level: phrases whose link and head are frequent (None: all are)."""
        node = self.nodes[-1]
        good = self.live.copy()
        if frequent is not None:
            good[good] = frequent[node[good]]
        live = np.zeros(len(node), bool)
        live[1:] = good[1:] & good[:-1] & ~self.begins[1:]
        at = np.flatnonzero(live)
        key = node[at - 1] * np.int64(max(1, len(self.hashes[0]))) + self.ids[at]
        _, first, own = np.unique(key, return_index=True, return_inverse=True)
        nodes = np.full(len(node), -1)
        nodes[at] = own
        end = at[first]
        self.links.append(node[end])
        self.heads.append(node[end - 1])
        self.hashes.append(K.mix(self.hashes[-1][node[end - 1]] * _ODD + self.hashes[0][self.ids[end]]))
        self.counts.append(np.bincount(own, minlength=len(end)))
        self.nodes.append(nodes)
        self.first.append(end)
        self.live = live

    def states(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each level, the nodes that are their state's longest phrase, and its shortest one's length."""
        out = []
        shortest = np.ones(len(self.counts[0]), np.int64)
        for d in range(len(self.counts)):
            longest = np.ones(len(self.counts[d]), bool)
            if d + 1 < len(self.counts):
                link = self.links[d + 1]
                same = self.counts[d + 1] == self.counts[d][link]
                longest[link[same]] = False
                below = np.where(same, shortest[link], d + 2)
            out.append((np.flatnonzero(longest), shortest[longest]))
            if d + 1 < len(self.counts):
                shortest = below
        return out

    def phrases(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of a level and their counts, as the states give them: those that hold a phrase of that length."""
        own, counts = [], []
        for d, (node, shortest) in enumerate(self.states()):
            node, shortest = node[shortest <= level], shortest[shortest <= level]
            if d + 1 < level:
                continue
            counts.append(self.counts[d][node])
            for up in range(d, level - 1, -1):
                node = self.links[up][node]
            own.append(node)
        node, n = np.concatenate(own), np.concatenate(counts)
        order = np.argsort(node, kind="stable")
        return node[order], n[order]

    def texts(self, level: int, nodes: np.ndarray) -> list[str]:
        order, sizes, text = self._words
        ends = np.cumsum(K.unpack_ints(sizes).astype(np.int64))
        data, by = K.unpack_bytes(text), K.unpack_ints(order).astype(np.int64)
        words = np.empty(len(by), object)
        words[by] = [data[a:b].decode("utf-8", "replace") for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)] if len(by) else []
        end = self.first[level - 1][nodes]
        return [" ".join(w) for w in zip(*(words[self.ids[end - k]] for k in range(level - 1, -1, -1)), strict=True)]


class _Entries:
    """The phrases of some levels of an automaton by hash, as they are sent to buckets and answered."""

    def __init__(self, auto: Automaton, levels: tuple[int, ...], bits: int):
        found = [auto.phrases(d) for d in levels]
        self.level = np.repeat(levels, [len(n) for n, _ in found])
        self.node = np.concatenate([n for n, _ in found])
        hashes = np.concatenate([auto.hashes[d - 1][n] for d, (n, _) in zip(levels, found, strict=True)])
        order = np.argsort(hashes, kind="stable")
        self.level, self.node, self.hashes, self.count = self.level[order], self.node[order], hashes[order], np.concatenate([c for _, c in found])[order]
        of = (self.hashes >> _U(64 - bits)).astype(np.int64)
        at, size = K.groups(of)
        self.bits, self.buckets = bits, [(int(of[a]), slice(int(a), int(a + n))) for a, n in zip(at, size, strict=True)]

    def sent(self) -> list[tuple[int, bytes]]:
        low = _U((1 << (64 - self.bits)) - 1)
        return [(b, K.bundle(K.pack_ints(self.hashes[own] & low, rising=True), K.pack_ints(self.count[own]))) for b, own in self.buckets]

    def answered(self, notes: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which entries are frequent; the places of those that this shard tells of, and their counts in the corpus."""
        frequent = np.zeros(len(self.node), bool)
        told, counts = [], []
        for b, own in self.buckets:
            often, tells, f = K.unbundle(notes[b])
            frequent[own] = K.unpack_bits(often, own.stop - own.start)
            at = np.flatnonzero(frequent[own]) + own.start
            told.append(at[K.unpack_bits(tells, len(at))])
            counts.append(K.unpack_ints(f).astype(np.int64))
        return frequent, np.concatenate(told) if told else np.zeros(0, np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _levels(step: int) -> tuple[int, ...]:
    """The first pass takes words and pairs, each later one phrases of one more word."""
    return (1, 2) if step == 0 else (step + 2,)


def _pass(step: int, last: bool, bits: int):
    """What a shard does in a pass: reads what became of the last pass's phrases, tells of some, sends deeper ones."""

    def run(key: tuple, shard: pa.Table, notes: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if not shard.num_rows:
            return _OUT_ARROW.empty_table()
        number, auto = key[0].as_py(), Automaton(shard["data"][0].as_py())
        names = shard["langs"][0].as_py()
        by: dict[int, dict[int, bytes]] = {}
        for level, bucket, data in zip(notes["n_level"].to_pylist(), notes["n_bucket"].to_pylist(), notes["n_data"], strict=True):
            by.setdefault(level, {})[bucket] = data.as_py()
        auto.deepen(None)
        for done in range(step):
            entries = _Entries(auto, _levels(done), bits)
            frequent, told, f = entries.answered(by.get(done, {}))
            if done == step - 1:
                for d in _levels(done):
                    of = entries.level[told] == d
                    own = entries.node[told[of]]
                    if len(own):
                        langs = auto.lang[auto.ids[auto.first[d - 1][own]]]
                        rows += [(None, None, None, names[x], t, d, n) for x, t, n in zip(langs.tolist(), auto.texts(d, own), f[of].tolist(), strict=True)]
            deepest = _levels(done)[-1]
            keep = np.zeros(len(auto.hashes[-1]), bool)
            keep[entries.node[(entries.level == deepest) & frequent]] = True
            if not (last and done == step - 1):
                auto.deepen(keep)
        if not last:
            rows += [(b, number, data, None, None, None, None) for b, data in _Entries(auto, _levels(step), bits).sent()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_OUT_ARROW)
        K.give_back()
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, _OUT_ARROW.types, strict=True)], schema=_OUT_ARROW)

    return run


def _first_pass(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                auto = Automaton(data.as_py())
                auto.deepen(None)
                sent = _Entries(auto, _levels(0), bits).sent()
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array([number] * len(sent), pa.int64()), pa.array([x for _, x in sent], pa.binary())], names=["bucket", "s_shard", "s_data"])
                K.give_back()

    return run


def _totals(step: int, least: int):
    """A bucket's sums: to each shard which of its phrases are frequent, and to the first that has one, how often it stands."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("s_shard")
        parts = [K.unbundle(x.as_py()) for x in rows["s_data"]]
        values, counts = [K.unpack_ints(p[0]) for p in parts], [K.unpack_ints(p[1]).astype(np.int64) for p in parts]
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        at, size = K.groups(every[order])
        f = np.add.reduceat(np.concatenate(counts)[order], at)
        often, tells, total = np.zeros(len(every), bool), np.zeros(len(every), bool), np.zeros(len(every), np.int64)
        often[order] = np.repeat(f >= least, size)
        tells[order[at]] = f >= least
        total[order] = np.repeat(f, size)
        cuts = np.cumsum([len(v) for v in values])[:-1]
        out = [K.bundle(K.pack_bits(o), K.pack_bits(t[o]), K.pack_ints(n[t])) for o, t, n in zip(np.split(often, cuts), np.split(tells, cuts), np.split(total, cuts), strict=True)]
        K.give_back()
        return pa.table([rows["s_shard"].combine_chunks(), pa.array([step] * len(out), pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(out, pa.binary())], schema=_NOTE_ARROW)

    return run


def frequent_phrases(docs: DataFrame, scratch: Scratch, *, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that stand ``least`` times or more, and (lang, n)."""
    one = F.coalesce(F.col(text), F.lit(""))
    bytes_ = docs.agg(F.sum(F.octet_length(one).cast("long")).alias("bytes")).first().bytes or 0
    times = min(MOST_TIMES, max(1.0, math.sqrt(bytes_ / ROOT_FROM)))
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), one.alias("text"))
    shards = scratch.keep(rows.mapInArrow(_shards(int(SHARD_BYTES * times)), _SHARD), "shards")
    n_words = shards.agg(F.sum("words").alias("n")).first().n or 0
    bits = max(4, math.ceil(math.log2(max(1, n_words / (BUCKET_HASHES * times)))))
    totals = shards.select(F.explode(F.arrays_zip("langs", "counts")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.counts").alias("n"))
    sent = shards.select("shard", "data").mapInArrow(_first_pass(bits), "bucket int, s_shard long, s_data binary")
    notes, found = None, None
    for step in range(1, max(2, longest)):
        answer = scratch.keep(sent.groupBy("bucket").applyInArrow(_totals(step - 1, least), _NOTE), f"notes{step}")
        notes = answer if notes is None else notes.unionByName(answer)
        last = step == max(2, longest) - 1
        out = scratch.keep(shards.groupBy("shard").cogroup(notes.groupBy("n_shard")).applyInArrow(_pass(step, last, bits), _OUT), f"pass{step}")
        own = out.filter("phrase IS NOT NULL").select("lang", "phrase", "words", "f")
        found = own if found is None else found.unionByName(own)
        sent = out.filter("bucket IS NOT NULL").select("bucket", "s_shard", "s_data")
    return found.filter(F.col("words") <= longest), totals


def _part(first, n):
    return F.array_join(F.slice("w", first, n), " ")


def _top(rows: DataFrame, most: int, order: list, n: int) -> DataFrame:
    """The first rows of each language with their rank: ranked in parts, whose lists are merged a few at a time."""
    parts = max(1, math.ceil(n / RANKED))
    while parts > 1:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= most).drop("rank")
        parts = math.ceil(parts / FAN_IN) if parts > FAN_IN else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, covered: int = 80, most: int = 2000) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line ends, and these into words at spaces and
    tabs. A phrase of 2 to ``longest`` words that stands a >= ``least`` times within pieces of its language is a
    candidate. Cut in two, its parts stand l and r times; score = floor(2000000 * a / (l + r)), at the cut that makes
    it lowest (ties: the shortest first part). Candidates within a longer one that stands at least ``covered`` in 100
    times as often go: since a phrase stands as often as anything that holds it, looking one word further along the
    links (left and right) sees all longer ones. n: the words of the language. Order: score, a, phrase by its bytes.

    Counts are exact but for phrases whose 64-bit hashes meet. Every row counts, repeated ones too; equal texts need
    no treatment, since a shard sends each phrase once. Null lang: ``und``; null or empty text: no words. Texts of
    any length are read whole (a text larger than a shard is one shard). Empty table: no rows. Other columns are not
    read. Shards are cut within scan tasks and written once, so that one document or language may hold any share.
    The driver holds three numbers.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    found, totals = frequent_phrases(docs, scratch, text=text, lang=lang, longest=longest, least=least)
    known = found.select("lang", "phrase", "f")
    split = found.filter("words > 1").withColumn("w", F.split("phrase", " "))
    # What each phrase is one word longer than: its link (without the first word) and its head (without the last).
    links = split.filter("words > 2").select("lang", F.explode(F.array_distinct(F.array(_part(2, F.col("words") - 1), _part(1, F.col("words") - 1)))).alias("phrase"), "f")
    longer = links.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = split.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * covered))
    cuts = left.select("lang", "phrase", "w", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # Decimals, since 2000000 * a may pass 64 bits; div is exact.
    cuts = cuts.withColumn("score", F.expr("2000000BD * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = scratch.keep(best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    top = _top(rows, most, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], rows.count())
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
