"""Suffix-array dedup: two-stage suffix sorting and adjacent common prefixes over the places where texts recur."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.llm import kernels as K
from corpusmill.llm.exchange import NOTE, NOTE_ARROW, SENT, Chunk, Corpus, Gathered, Sorted, sent_table

_SHARED, _SPANS, _LATER = 1, 2, 3
#: An anchor at more places than this is hot: its strings are dealt one by one, so that no group holds all its contexts.
HOT = 1 << 12
_U = np.uint64
#: Bytes of distinct contexts that are sorted as one text.
SORT_BYTES = 1 << 18
#: Bytes of the corpus whose recurring places meet in one bucket, at most.
BUCKET_BYTES = 16 << 20
#: More than the bytes whose anchors are found at once.
_PART = 1 << 20


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last of a run of equal letters decides."""
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(-1)))
    at = np.where(step != 0, np.arange(len(text)), len(text))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def suffix_array(text: np.ndarray, most: int) -> np.ndarray:
    """The suffixes of a text of parts in order, by two-stage sorting.

    text: letters of 1 or more, and a 0 behind each part of at most ``most`` letters; zeros rank by place. Suffixes
    smaller than their successors are sorted directly. The others follow in one scan over the buckets of first
    letters, in order: the predecessor of a sorted suffix, if it is larger, takes the next place in its own bucket.
    """
    small = _types(text)
    zero = np.flatnonzero(text == 0)
    direct = np.flatnonzero(small & (text > 0))
    if len(direct):
        padded = np.concatenate([text, np.zeros(most + 1, text.dtype)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, most + 1)[direct]
        ends = zero[np.searchsorted(zero, direct)] - direct
        rows[np.arange(most + 1) >= ends[:, None]] = 0
        direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{most + 1}").ravel(), kind="stable")]
    by_letter = direct[np.argsort(text[direct], kind="stable")]
    first = np.searchsorted(text[by_letter], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    letters = np.unique(text)

    def induce(bucket: np.ndarray, letter: int) -> None:
        before = bucket[bucket > 0] - 1
        before = before[text[before] > letter]
        if not len(before):
            return
        own = text[before]
        order = np.argsort(own, kind="stable")
        before, own = before[order], own[order]
        at, size = K.groups(own)
        for a, n in zip(at.tolist(), size.tolist(), strict=True):
            pending[int(own[a])].append(before[a : a + n])

    for letter in letters.tolist():
        if letter == 0:
            bucket = zero
        else:
            wave = np.concatenate(pending[letter]) if pending[letter] else np.zeros(0, np.int64)
            larger = [wave]
            while len(wave):  # runs of the same letter: each wave induces the next, in the order of the scan
                wave = wave[wave > 0] - 1
                wave = wave[text[wave] == letter]
                larger.append(wave)
            bucket = np.concatenate([*larger, by_letter[first[letter] : first[letter + 1]]])
        out.append(bucket)
        induce(bucket, letter)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many first letters each suffix shares with the one before it in order, at most ``most``."""
    padded = np.concatenate([text, np.zeros(most, text.dtype)])
    views = np.lib.stride_tricks.sliding_window_view(padded, most)
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 15):
        hi = min(len(order), lo + (1 << 15))
        same = views[order[lo:hi]] == views[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(same.all(axis=1), most, same.argmin(axis=1))
    return out


class _Anchors:
    """The anchor of each string of ``width`` bytes: the least hash of ``gram`` bytes in it, the first of equal ones.

    Equal strings have equal anchors at equal places. Strings with one anchor place are a run: lo and hi are its
    first and last start, at the anchor's place, hash its hash.
    """

    def __init__(self, c: Chunk, width: int, gram: int):
        lo, hi, at, hashes = [], [], [], []
        sizes = np.diff(c.offsets)
        docs = np.flatnonzero((sizes >= width) & ~c.copy)
        step = _PART // 2
        # Documents that follow each other are read together; a long one in overlapping parts.
        i = 0
        while i < len(docs):
            j = i + 1
            a = int(c.offsets[docs[i]])
            while j < len(docs) and c.offsets[docs[j] + 1] - a <= step:
                j += 1
            b = int(c.offsets[docs[j - 1] + 1])
            for part in range(a, b, step) if b - a > step else (a,):
                end = min(b, part + step + width - 1)
                if end - part >= width:
                    got = self._runs(c.data[part:end], width, gram)
                    for out, x in zip((lo, hi, at), got[:3], strict=True):
                        out.append(x + part)
                    hashes.append(got[3])
            i = j
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        lo, hi, at, hashes = cat(lo, np.int64), cat(hi, np.int64), cat(at, np.int64), cat(hashes, np.uint64)
        # Runs were cut at parts, and here at the ends of documents: strings lie in one document.
        doc = np.searchsorted(c.offsets, lo, "right") - 1
        over = np.searchsorted(c.offsets, hi + width, "left") - 1 > doc
        if over.any():
            lo, hi, at, hashes = self._cut(c, lo, hi, at, hashes, width, over, doc)
        doc = np.searchsorted(c.offsets, lo, "right") - 1
        own = (hi + width <= c.offsets[doc + 1]) & ~c.copy[doc] & (hi >= lo) if len(lo) else np.zeros(0, bool)
        self.lo, self.hi, self.at, self.hash, self.doc = lo[own], hi[own], at[own], hashes[own], doc[own]

    @staticmethod
    def _cut(c, lo, hi, at, hashes, width, over, doc):
        """Runs over the end of a document become the part before it and the parts in the documents behind."""
        keep = [(lo[~over], hi[~over], at[~over], hashes[~over])]
        while over.any():
            lo, hi, at, hashes, doc = lo[over], hi[over], at[over], hashes[over], doc[over]
            end = c.offsets[doc + 1]
            keep.append((lo, np.minimum(hi, end - width), at, hashes))
            # strings that start behind this document's end
            lo = np.maximum(lo, end)
            more = lo <= hi
            lo, hi, at, hashes = lo[more], hi[more], at[more], hashes[more]
            doc = np.searchsorted(c.offsets, lo, "right") - 1
            over = np.searchsorted(c.offsets, hi + width, "left") - 1 > doc
            keep.append((lo[~over], hi[~over], at[~over], hashes[~over]))
        return tuple(np.concatenate(x) for x in zip(*keep, strict=True))

    @staticmethod
    def _runs(data: np.ndarray, width: int, gram: int):
        h, size, mul = K.LETTERS[data], 1, 0x9E3779B97F4A7C15
        while size < gram:  # gram is a power of two: hashes of 1, 2, 4, ... bytes
            new = h[:-size] * _U(mul)
            new += h[size:]
            h, size, mul = new, 2 * size, mul * mul % (1 << 64)
        h = K.mix(h)
        span = width - gram + 1
        # Least value and its first place in each run of span hashes: places ride in the low bits of the hash.
        bits = _PART.bit_length()
        key = (h & ~_U((1 << bits) - 1)) | np.arange(len(h), dtype=np.uint64)
        low, size = key, 1
        while 2 * size <= span:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        at = (low & _U((1 << bits) - 1)).astype(np.int64)
        first, size = K.groups(at)
        # Least hashes are small numbers; mixed again, they spread over all buckets.
        return first, first + size - 1, at[first], K.mix(h[at[first]] + _U(0x632BE59BD9B4E019))


def _send(width: int, gram: int, bits: int):
    def send(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        s = Sorted(_Anchors(Chunk(docs, notes), width, gram).hash, bits + 32)
        return sent_table(chunk, [(b, K.bundle(K.pack_ints(s.low(own, bits), rising=True), K.pack_ints(s.size[own]))) for b, own in s.buckets(bits)])

    return send


def _shared(hot: int):
    """For each anchor sent, a bit if it stands at two places or more; and, where any is hot, a bit for that."""

    def shared(parts: list[list[bytes]]) -> list[bytes]:
        g = Gathered([K.unpack_ints(p[0]) for p in parts])
        n = np.add.reduceat(g.sorted([K.unpack_ints(p[1]).astype(np.int64) for p in parts]), g.at)
        several, many = g.deal(np.repeat(n > 1, g.size)), g.deal(np.repeat(n > hot, g.size))
        return [K.bundle(K.pack_bits(x), *([K.pack_bits(y)] if y.any() else [])) for x, y in zip(several, many, strict=True)]

    return shared


def _marked(c: Chunk, a: _Anchors, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have an anchor that recurs, and which a hot one."""
    s = Sorted(a.hash, bits + 32)
    out = np.zeros((2, len(s.values)), bool)
    for b, own in s.buckets(bits):
        for row, blob in zip(out, K.unbundle(c.notes[_SHARED][b]), strict=False):
            row[own] = K.unpack_bits(blob, own.stop - own.start)
    return s.spread(out[0]), s.spread(out[1])


def _hot_strings(c: Chunk, a: _Anchors, hot: np.ndarray, width: int) -> tuple[Sorted, np.ndarray, np.ndarray]:
    """The strings of hot runs by two hashes, where they start, and of each distinct one the first by (doc_id, start)."""
    n = (a.hi - a.lo + 1)[hot]
    at = np.repeat(a.lo[hot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    order = np.lexsort((at, c.ids[np.repeat(a.doc[hot], n)]))  # chunks hold documents by id, but equal ids follow by text
    at = at[order]
    h, more = (K.span_hashes(c.data, at, at + width, seed=k) for k in (0, 1))
    s = Sorted(h, second=more)
    first = np.minimum.reduceat(s.order, s.at) if len(at) else at
    return s, at, first


def _place(c: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.searchsorted(c.offsets, at, "right") - 1
    return c.ids[doc], at - c.offsets[doc]


def _send_hot(width: int, gram: int, bits: int):
    def send(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        c = Chunk(docs, notes)
        a = _Anchors(c, width, gram)
        if not len(a.hash) or not (hot := _marked(c, a, bits)[1]).any():
            return sent_table(chunk, [])
        s, at, first = _hot_strings(c, a, hot, width)
        ids, start = _place(c, at[first])
        return sent_table(chunk, [(b, K.bundle(K.pack_ints(s.low(own, bits), rising=True), K.pack_plain(s.seconds[own]), K.pack_ints(ids[own]), K.pack_ints(start[own]))) for b, own in s.buckets(bits)])

    return send


def _later(parts: list[list[bytes]]) -> list[bytes]:
    """Whether a string of a chunk stands earlier in another one."""
    g = Gathered([K.unpack_ints(p[0]) for p in parts], [K.unpack_plain(p[1]) for p in parts])
    ids, start = (g.sorted([K.unpack_ints(p[i]).view(np.int64) for p in parts]) for i in (2, 3))
    group = np.repeat(np.arange(len(g.at)), g.size)
    least = np.lexsort((start, ids, group))[g.at] if len(g.at) else g.at
    least = np.repeat(least, g.size)
    return [K.pack_bits(x) for x in g.deal((ids != ids[least]) | (start != start[least]))]


def _gather(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _contexts(width: int, gram: int, bits: int, near: int):
    """Each run whose anchor recurs, with its bytes: distinct ones once, and all places where they stand."""

    def contexts(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        c = Chunk(docs, notes)
        a = _Anchors(c, width, gram)
        several, hot = _marked(c, a, bits) if len(a.hash) else (np.zeros(0, bool),) * 2
        keep = np.flatnonzero(several & ~hot)
        if not len(keep):
            return sent_table(chunk, [])
        lo, size, anchor, doc = a.lo[keep], a.hi[keep] - a.lo[keep] + width, a.hash[keep], a.doc[keep]
        content, second = (K.span_hashes(c.data, lo, lo + size, seed=n) for n in (0, 1))
        ids, start = c.ids[doc], lo - c.offsets[doc]
        order = np.lexsort((start, ids, second, content, anchor))
        rows = []
        of = (anchor[order] >> _U(64 - near)).astype(np.int64)
        at, n = K.groups(of)
        for b, x, m in zip(of[at].tolist(), at.tolist(), n.tolist(), strict=True):
            own = order[x : x + m]
            new = np.append(True, (anchor[own][1:] != anchor[own][:-1]) | (content[own][1:] != content[own][:-1]) | (second[own][1:] != second[own][:-1]))
            one = own[new]
            rows.append((b, K.bundle(
                K.pack_ints(anchor[one]), K.pack_ints(content[one]), K.pack_ints(size[one]), K.pack_bytes(_gather(c.data, lo[one], size[one]).tobytes()),
                K.pack_bits(new), K.pack_ints(ids[own]), K.pack_ints(start[own]), K.pack_ints(doc[own]), K.pack_plain(second[one]),
            )))
        return sent_table(chunk, rows)

    return contexts


def _later_starts(anchor: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """For each string start of contexts that share an anchor with another: whether an equal string ranks before.

    rank orders the contexts by (doc_id, start). Returns a flag for each start, context after context.
    """
    n = size - width + 1
    out = np.zeros(int(n.sum()), bool)
    at_flag = np.cumsum(n) - n
    first, many = K.groups(anchor)
    cut = np.append(first, len(anchor))
    # Whole anchors are sorted together, about SORT_BYTES at once; an anchor's contexts are never parted.
    held = np.add.reduceat(size + 1, first) if len(first) else np.zeros(0, np.int64)
    held = np.where(many > 1, held, 0)
    batch = np.cumsum(held) // SORT_BYTES
    edges, count = K.groups(batch)
    for e, k in zip(edges.tolist(), count.tolist(), strict=True):
        own = np.concatenate([np.arange(cut[g], cut[g + 1]) for g in range(e, e + k) if many[g] > 1] or [np.zeros(0, np.int64)])
        if not len(own):
            continue
        sizes = size[own]
        behind = np.cumsum(sizes + 1)
        text = np.zeros(int(behind[-1]), np.uint8)
        inside = np.ones(len(text), bool)
        inside[behind - 1] = False
        text[inside] = _gather(data, begin[own], sizes) + 1  # UTF-8 has no 0xFF
        order = suffix_array(text, int(sizes.max()))
        ctx = np.searchsorted(behind, order, "right")
        local = order - (behind[ctx] - sizes[ctx] - 1)
        valid = local <= sizes[ctx] - width
        order, ctx, local = order[valid], ctx[valid], local[valid]
        same = common_prefixes(text, order, width) >= width
        same[:1] = False
        group = np.cumsum(~same) - 1
        # Equal strings have the same start relative to the anchor only by chance, so rank by context, then start.
        key = rank[own][ctx] * _U(1 << 20) + local.astype(np.uint64)
        at, m = K.groups(group)
        least = np.minimum.reduceat(key, at) if len(at) else key
        out[at_flag[own][ctx] + local] = key != np.repeat(least, m)
    return out


def _spans(width: int):
    """What each chunk has to remove: (document place, first start, last start) of runs of later strings."""

    def spans(key: tuple, table: pa.Table) -> pa.Table:
        chunks = table["s_chunk"].to_numpy()
        parts = [K.unbundle(x.as_py()) for x in table["s_data"]]
        got = [[K.unpack_ints(p[i]) for p in parts] for i in (0, 1, 2)]
        anchor, content, size = (np.concatenate(x) for x in got)
        second = np.concatenate([K.unpack_plain(p[8]) for p in parts])
        size = size.astype(np.int64)
        data = np.frombuffer(b"".join(K.unpack_bytes(p[3]) for p in parts), np.uint8)
        begin = np.cumsum(size) - size
        # Occurrences point to their chunk's contexts.
        ids = [K.unpack_ints(p[5]).view(np.int64) for p in parts]
        base = np.cumsum([0, *map(len, got[0])])
        ctx = np.concatenate([np.cumsum(K.unpack_bits(p[4], len(i))) - 1 + b for p, i, b in zip(parts, ids, base, strict=False)])
        chunk = np.repeat(chunks, list(map(len, ids)))
        ids, start, doc = np.concatenate(ids), np.concatenate([K.unpack_ints(p[6]).view(np.int64) for p in parts]), np.concatenate([K.unpack_ints(p[7]).view(np.int64) for p in parts])
        # Equal contexts are one; the occurrence with the smallest (doc_id, start) stands for it.
        order = np.lexsort((start, ids, second[ctx], content[ctx], anchor[ctx]))
        a, k, l = anchor[ctx][order], content[ctx][order], second[ctx][order]
        new = np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1]) | (l[1:] != l[:-1]))
        one = order[new]  # of each distinct context, the first occurrence
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        c_of = ctx[one]
        rank = np.empty(len(one), np.uint64)
        rank[np.lexsort((start[one], ids[one]))] = np.arange(len(one), dtype=np.uint64)
        later = _later_starts(anchor[c_of], size[c_of], begin[c_of], data, rank, width)
        n = size[c_of] - width + 1
        at_flag = np.cumsum(n) - n
        # Flags of first occurrences as runs; every other occurrence is later as a whole, unless it is the same place.
        edge = np.diff(np.concatenate([[0], later.view(np.int8), [0]]))
        inner = np.zeros(len(later) + 1, bool)
        inner[at_flag] = True
        both = inner[1:-1] & later[1:] & later[:-1] if len(later) > 1 else np.zeros(0, bool)
        lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.flatnonzero(both) + 1]))
        hi = np.sort(np.concatenate([np.flatnonzero(edge == -1) - 1, np.flatnonzero(both)]))
        run = np.searchsorted(at_flag, lo, "right") - 1
        first = one[run]
        same_id = ids == ids[one][of]
        rest = np.flatnonzero(~(same_id & (start == start[one][of])))
        out_chunk = np.concatenate([chunk[first], chunk[rest]])
        out_doc = np.concatenate([doc[first], doc[rest]])
        out_lo = np.concatenate([start[first] + lo - at_flag[run], start[rest]])
        out_hi = np.concatenate([start[first] + hi - at_flag[run], start[rest] + n[of[rest]] - 1])
        # Rows with equal doc_id and start as a first occurrence take its runs too.
        twin = np.setdiff1d(np.flatnonzero(same_id & (start == start[one][of])), one)
        begin_run, end_run = np.searchsorted(run, of[twin]), np.searchsorted(run, of[twin], "right")
        many = end_run - begin_run
        t = np.repeat(twin, many)
        mine = np.repeat(begin_run - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        out_chunk, out_doc = np.append(out_chunk, chunk[t]), np.append(out_doc, doc[t])
        out_lo = np.append(out_lo, start[t] + lo[mine] - at_flag[of[t]])
        out_hi = np.append(out_hi, start[t] + hi[mine] - at_flag[of[t]])
        by = np.lexsort((out_lo, out_doc, out_chunk))
        out_chunk, out_doc, out_lo, out_hi = out_chunk[by], out_doc[by], out_lo[by], out_hi[by]
        at, m = K.groups(out_chunk)
        blobs = [K.bundle(K.pack_ints(out_doc[x : x + y]), K.pack_ints(out_lo[x : x + y]), K.pack_ints(out_hi[x : x + y])) for x, y in zip(at.tolist(), m.tolist(), strict=True)]
        return pa.table([pa.array(out_chunk[at], pa.int32()), pa.array([_SPANS] * len(at), pa.int32()), pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array(blobs, pa.binary())], schema=NOTE_ARROW)

    return spans


def _remove(width: int, schema: pa.Schema, gram: int, bits: int, any_hot: bool):
    def remove(chunk: int, docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        c = Chunk(docs, notes)
        got = [[K.unpack_ints(x).view(np.int64) for x in K.unbundle(blob)] for blob in c.notes.get(_SPANS, {}).values()]
        doc, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        whole = np.flatnonzero(c.copy & (np.diff(c.offsets) >= width))
        starts = np.concatenate([c.offsets[doc] + lo, c.offsets[whole]])
        ends = np.concatenate([c.offsets[doc] + hi + width, c.offsets[whole + 1]])
        if any_hot and len((a := _Anchors(c, width, gram)).hash) and (hot := _marked(c, a, bits)[1]).any():
            s, at, first = _hot_strings(c, a, hot, width)
            own, of = _place(c, at), _place(c, at[s.spread(first)])
            again = at[s.spread(s.bits_from(c.notes.get(_LATER, {}), bits)) | (own[0] != of[0]) | (own[1] != of[1])]
            starts, ends = np.append(starts, again), np.append(ends, again + width)
        gone = K.cover(starts, ends, len(c.data))
        removed = np.diff(np.append(0, np.cumsum(gone))[c.offsets])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        at = c.offsets[:-1][c.offsets[:-1] < len(gone)]
        begins[at] = gone[at]
        spans = np.diff(np.append(0, np.cumsum(begins))[c.offsets])
        sums = np.append(0, np.cumsum(~gone))[c.offsets]
        kept = pa.Array.from_buffers(pa.large_binary(), c.n, [None, pa.py_buffer(sums.astype(np.int64)), pa.py_buffer(c.data[~gone])]).cast(pa.binary())
        carried = [c.table[f"c_{i}"] for i in range(len(schema) - 5)]
        return pa.table([c.table["d_id"], *carried, pa.array(np.diff(c.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), kept], schema=schema)

    return remove


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 100, carry: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a string of ``width`` bytes that also starts earlier (smaller doc_id, or before).

    Returns doc_id, the carried columns (default: all others), n_bytes, n_removed, n_spans and kept (binary: a cut
    may part a character). Only strings that recur matter, and equal strings hold equal anchors (the least hash of
    a quarter of their bytes, rounded down to a power of two) at equal places. An exchange of packed anchor hashes
    tells which recur; the bytes around those go to the anchor's bucket, equal stretches once. There the distinct
    stretches are one text, whose suffixes are sorted in two stages, and adjacent common prefixes of ``width`` or
    more make the groups of equal strings; all but the first of a group are later ones. The strings of anchors at more
    than ``hot`` places, such as a passage that a third of all texts hold, never meet as one group: each goes by its
    own two 64-bit hashes, once a chunk.

    Documents whose whole text a smaller doc_id has are removed whole if they have ``width`` bytes. Strings are
    judged on the input, matches never cross documents. Equal stretches are found by two independent 64-bit hashes
    and that of their anchor; the sort compares bytes. Null or empty text: 0 bytes, kept empty. Null doc_id:
    larger than all ids. Rows with the same doc_id: only an earlier start counts. Texts of any length are read
    whole. Empty table: empty result. A carried column named as a result is left out.
    """
    gram = 1 << (max(4, width // 3).bit_length() - 1)
    own = ("n_bytes", "n_removed", "n_spans", "kept")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (doc_id, text, *own)]
    corpus = Corpus(docs, "suffix", doc_id=doc_id, text=text, carry=carry)
    bits = corpus.bits(corpus.bytes // 8)
    shared = corpus.answers(corpus.each_chunk(_send(width, gram, bits), corpus.notes, SENT), _shared(hot), _SHARED)
    notes = corpus.notes.unionByName(corpus.scratch.keep(shared, "shared"))
    near = max(5, int(corpus.bytes // BUCKET_BYTES).bit_length())
    found = corpus.each_chunk(_contexts(width, gram, bits, near), notes, SENT)
    ends = corpus.notes.unionByName(corpus.scratch.keep(found.groupBy("bucket").applyInArrow(_spans(width), NOTE), "spans"))
    # A bundle of two parts tells of hot anchors.
    any_hot = not notes.filter(F.col("n_kind") == _SHARED).filter(F.substring("n_data", 1, 1) == F.lit(bytearray(b"\x02"))).isEmpty()
    if any_hot:
        later = corpus.answers(corpus.each_chunk(_send_hot(width, gram, bits), notes, SENT), _later, _LATER)
        ends = ends.unionByName(notes.filter(F.col("n_kind") == _SHARED)).unionByName(corpus.scratch.keep(later, "later"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"c_{i}", docs.schema[c].dataType) for i, c in enumerate(corpus.carried)], *[T.StructField(c, T.LongType()) for c in own[:3]], T.StructField("kept", T.BinaryType())])
    out = corpus.each_chunk(_remove(width, to_arrow_schema(schema), gram, bits, any_hot), ends, schema)
    return out.toDF(doc_id, *corpus.carried, *own)
