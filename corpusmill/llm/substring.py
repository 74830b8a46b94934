"""Substring dedup by fixed-block anchors: blocks are indexed, every rolling window probes, hits are extended."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.llm import kernels as K
from corpusmill.llm.exchange import SENT, Chunk, Corpus, Gathered, Sorted, sent_table

_HIT, _LATER = 1, 2


def _probes(c: Chunk, block: int, bits: int) -> tuple[Sorted, np.ndarray, np.ndarray]:
    """All rolling windows of the block length in reference documents, their places, and which are blocks."""
    c.words()
    rolled, own = c.windows(block)
    at = np.flatnonzero(own)
    place = at - c.first_word[c.doc[at]]
    return Sorted(rolled[at], bits + 32), at, place % block == 0


def _send(block: int, bits: int):
    def send(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        c = Chunk(docs, notes)
        s, at, is_block = _probes(c, block, bits)
        if not len(at):
            return sent_table(chunk, [])
        doc = c.doc[at][s.order]
        several = np.minimum.reduceat(doc, s.at) != np.maximum.reduceat(doc, s.at)
        blocks = np.logical_or.reduceat(is_block[s.order], s.at)
        return sent_table(chunk, [(b, K.bundle(K.pack_ints(s.low(own, bits), rising=True), K.pack_bits(several[own]), K.pack_bits(blocks[own]))) for b, own in s.buckets(bits)])

    return send


def _hits(parts: list[list[bytes]]) -> list[bytes]:
    """A probe hits if its words are a block of some document and stand in two documents at least."""
    values = [K.unpack_ints(p[0]) for p in parts]
    g = Gathered(values)
    several = g.sorted([K.unpack_bits(p[1], len(v)) for p, v in zip(parts, values, strict=True)])
    blocks = g.sorted([K.unpack_bits(p[2], len(v)) for p, v in zip(parts, values, strict=True)])
    hit = ((g.size > 1) | np.logical_or.reduceat(several, g.at)) & np.logical_or.reduceat(blocks, g.at)
    return [K.pack_bits(x) for x in g.deal(np.repeat(hit, g.size))]


def _extended(c: Chunk, window: int, block: int, bits: int) -> tuple[Sorted, np.ndarray, np.ndarray]:
    """The windows around hits, their places, and the first document of each distinct one in this chunk."""
    s, at, _ = _probes(c, block, bits)
    hit = np.zeros(len(c.starts) + 1, np.int32)
    if len(at):
        hit[at] = s.spread(s.bits_from(c.notes.get(_HIT, {}), bits))
    sums = np.append(0, np.cumsum(hit))
    rolled, own = c.windows(window)
    n = len(rolled)
    near = own & (sums[window - block + 1 : window - block + 1 + n] > sums[:n])
    where = np.flatnonzero(near)
    w = Sorted(rolled[where], second=K.rolling(c.second_hashes(), window)[where])
    return w, where, np.minimum.reduceat(c.doc[where][w.order], w.at) if len(where) else np.zeros(0, np.int64)


def _extend(window: int, block: int, bits: int):
    def extend(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        c = Chunk(docs, notes)
        w, _, first = _extended(c, window, block, bits)
        ids = c.ids[first]
        return sent_table(chunk, [(b, K.bundle(K.pack_ints(w.low(own, bits), rising=True), K.pack_plain(w.seconds[own]), K.pack_ints(ids[own]))) for b, own in w.buckets(bits)])

    return extend


def _later(parts: list[list[bytes]]) -> list[bytes]:
    """Whether a smaller document than the chunk's first has the window."""
    g = Gathered([K.unpack_ints(p[0]) for p in parts], [K.unpack_plain(p[1]) for p in parts])
    ids = g.sorted([K.unpack_ints(p[2]).view(np.int64) for p in parts])
    least = np.repeat(np.minimum.reduceat(ids, g.at), g.size)
    return [K.pack_bits(x) for x in g.deal(ids > least)]


def _remove(window: int, block: int, bits: int, schema: pa.Schema, whole: bool):
    def remove(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        c = Chunk(docs, notes)
        w, where, first = _extended(c, window, block, bits)
        gone = np.zeros(len(c.starts), bool)
        if len(where):
            later = w.spread(w.bits_from(c.notes.get(_LATER, {}), bits)) | (c.ids[c.doc[where]] > c.ids[w.spread(first)])
            gone = K.cover(where[later], where[later] + window, len(c.starts))
        gone |= (c.copy & (c.n_words >= window))[c.doc]
        removed = np.diff(np.append(0, np.cumsum(gone))[c.first_word])
        # Kept words are copied with the byte behind them, as a space, where another kept word follows.
        kept = np.flatnonzero(~gone)
        follows = np.append(c.doc[kept][1:] == c.doc[kept][:-1], False) if len(kept) else np.zeros(0, bool)
        text = c.data.copy()
        ends = c.ends[kept]
        text[ends[follows]] = 32
        keep = K.cover(c.starts[kept], ends + follows, len(text))
        if whole:
            same = np.repeat(removed == 0, np.diff(c.offsets))
            keep, text = keep | same, np.where(same, c.data, text)
        sums = np.append(0, np.cumsum(keep))[c.offsets]
        out = pa.Array.from_buffers(pa.large_string(), c.n, [None, pa.py_buffer(sums.astype(np.int64)), pa.py_buffer(text[keep])]).cast(pa.string())
        carried = [c.table[f"c_{i}"] for i in range(len(schema) - 4)]
        return pa.table([c.table["d_id"], *carried, pa.array(c.n_words, pa.int64()), pa.array(removed, pa.int64()), out], schema=schema)

    return remove


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13, carry: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller doc_id.

    Returns doc_id, the carried columns (default: all others), n_words, n_removed and kept (the kept words joined by
    one space; with ``whole`` a text that loses nothing is returned as it is). Reference documents are cut into blocks of (window + 1) // 2 words, so that any window holds a
    whole block; the blocks are the index and every rolling window of that length probes it. Hits are extended to
    all windows around them; those that start in a smaller document, with their neighbours, are the maximal exact
    repeats. Documents whose whole text a smaller doc_id has are not indexed: their windows are that document's.

    Blocks probe by 64-bit hashes, which only nominate; windows are equal if two independent 64-bit hashes are (128
    bits: less than one false equality in 10^10 runs over 10^14 windows). Windows are judged on the input. Null or empty text: no
    words, kept empty. Null doc_id: larger than all ids, and of such rows none is smaller than another. Rows with
    the same doc_id, also of different texts, remove nothing from each other. Texts of any length are read whole. Empty table: empty result.
    A carried column named n_words, n_removed or kept is left out.
    """
    block = (window + 1) // 2
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (doc_id, text, "n_words", "n_removed", "kept")]
    corpus = Corpus(docs, "substring", doc_id=doc_id, text=text, carry=carry)
    bits = corpus.bits(corpus.bytes // 6)
    hits = corpus.answers(corpus.each_chunk(_send(block, bits), corpus.notes, SENT), _hits, _HIT)
    notes = corpus.notes.unionByName(corpus.scratch.keep(hits, "hits"))
    later = corpus.answers(corpus.each_chunk(_extend(window, block, bits), notes, SENT), _later, _LATER)
    notes = notes.unionByName(later)
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(f"c_{i}", docs.schema[c].dataType) for i, c in enumerate(corpus.carried)], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    schema = T.StructType(fields)
    out = corpus.each_chunk(_remove(window, block, bits, to_arrow_schema(schema), whole), notes, schema)
    return out.toDF(doc_id, *corpus.carried, "n_words", "n_removed", "kept")


