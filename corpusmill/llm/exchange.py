"""Which hashes of a corpus recur, found by exchanging packed sorted hashes instead of rows.

Documents are dealt into chunks of a few MB by doc_id. Each chunk sends its distinct hashes, bucketed by their first
bits, as packed sorted arrays (two to three bytes a hash); each bucket answers each chunk with a bit (or a count) for
every hash sent, in the order sent. The chunk, whose documents Spark keeps in one exchange for all passes, makes the
same hashes again and reads the answers. A key that a third of all rows share is one entry a chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import kernels as K
from corpusmill.plans.skew import join_hot
from corpusmill.plans.storage import Scratch

#: Of a corpus of up to ROOT_FROM bytes; beyond it both grow with the root of its size, so that messages grow in
#: number as the input does, up to MOST_TIMES as much memory a task.
CHUNK_BYTES, BUCKET_HASHES = 4 << 20, 2 << 20
ROOT_FROM, MOST_TIMES = 32 << 30, 16
NOTE = "n_chunk int, n_kind int, n_num long, n_data binary"
SENT = "bucket int, s_chunk int, s_data binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("s_chunk", pa.int32()), ("s_data", pa.binary())])
NOTE_ARROW = pa.schema([("n_chunk", pa.int32()), ("n_kind", pa.int32()), ("n_num", pa.int64()), ("n_data", pa.binary())])
#: Stands for a null doc_id: larger than all.
NO_ID = (1 << 63) - 1
COPY = 0


class Corpus:
    """Documents dealt into chunks, and notes on which of them are later copies of a whole text.

    rows: chunk, d_id, d_text and the carried columns. copies: doc_id, digest (SHA-256 of the text) and first (the
    smallest doc_id with the same text), for all documents with an id and a text that is not empty whose first is
    smaller. An id may stand in several rows with different texts; each of its texts is a copy or not by itself.
    """

    def __init__(self, docs: DataFrame, name: str, *, doc_id: str, text: str, carry: list[str] | None = None):
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession, name)
        one = F.coalesce(F.col(text), F.lit(""))
        d_id = F.col(doc_id).cast("long")
        keys = self.scratch.keep(docs.select(d_id.alias("doc_id"), F.unhex(F.sha2(one, 256)).alias("digest"), F.octet_length(one).alias("size")), "keys")
        all_ = keys.agg(F.sum(F.col("size").cast("long")).alias("bytes"), F.count("*").alias("n")).first()
        self.bytes, self.n = all_.bytes or 0, all_.n
        self.times = min(MOST_TIMES, max(1.0, math.sqrt(self.bytes / ROOT_FROM)))
        self.chunks = max(16, math.ceil(self.bytes / (CHUNK_BYTES * self.times)))
        usable = keys.filter("doc_id IS NOT NULL AND size > 0")
        first = usable.groupBy("digest").agg(F.min("doc_id").alias("first"))
        self.copies = self.scratch.keep(join_hot(usable.drop("size"), first, "digest", self.n).filter("doc_id > first").select("doc_id", "digest", "first").distinct(), "copies")
        self.scratch.drop("keys")
        carry = docs.columns if carry is None else carry
        self.carried = [c for c in carry if c not in (doc_id, text)]
        self.rows = docs.select(self.chunk(F.coalesce(d_id, F.xxhash64(one))).alias("chunk"), d_id.alias("d_id"), one.alias("d_text"), *[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(self.carried)])
        self.notes = self.copies.select(self.chunk(F.col("doc_id")).alias("n_chunk"), F.lit(COPY).alias("n_kind"), F.col("doc_id").alias("n_num"), F.concat(F.col("digest"), F.unhex(F.lpad(F.hex("first"), 16, "0"))).alias("n_data"))

    def chunk(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(77)), F.lit(self.chunks)).cast("int")

    def bits(self, hashes: int) -> int:
        """So many first bits of a hash name its bucket."""
        return max(4, math.ceil(math.log2(max(1, hashes) / (BUCKET_HASHES * self.times))))

    def each_chunk(self, fn: Callable, notes: DataFrame, schema: str | T.StructType) -> DataFrame:
        """fn(chunk number, documents, notes) for each chunk. Notes without documents are left out by fn."""

        def run(key: tuple, docs: pa.Table, own: pa.Table) -> pa.Table:
            out = fn(key[0].as_py(), docs, own)
            K.give_back()
            return out

        return self.rows.groupBy("chunk").cogroup(notes.groupBy("n_chunk")).applyInArrow(run, schema)

    def answers(self, sent: DataFrame, answer: Callable[[list[list[bytes]]], list[bytes]], kind: int) -> DataFrame:
        """Notes of ``kind`` with what ``answer`` gives each chunk for the parts that it has sent to a bucket."""

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            got = answer([K.unbundle(x.as_py()) for x in rows["s_data"]])
            K.give_back()
            n = rows.num_rows
            return pa.table([rows["s_chunk"].combine_chunks(), pa.array([kind] * n, pa.int32()), pa.array([key[0].as_py()] * n, pa.int64()), pa.array(got, pa.binary())], schema=NOTE_ARROW)

        return sent.groupBy("bucket").applyInArrow(run, NOTE)


class Chunk:
    """The documents of a chunk, by doc_id, as bytes, with the copies among them marked."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        # Equal ids are ordered by text, so that each pass sees the documents in the same order.
        self.table = docs.sort_by([("d_id", "ascending"), ("d_text", "ascending")]) if docs.num_rows else docs
        self.n = docs.num_rows
        self.ids = self.table["d_id"].fill_null(NO_ID).to_numpy().astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.data, self.offsets = K.flatten(self.table["d_text"]) if self.n else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.notes: dict[int, dict[int, bytes]] = {}
        copies: dict[int, list[bytes]] = {}
        if notes.num_rows:
            for kind, num, data in zip(notes["n_kind"].to_pylist(), notes["n_num"].to_pylist(), notes["n_data"], strict=True):
                if kind == COPY:
                    copies.setdefault(num, []).append(data.as_py())
                else:
                    self.notes.setdefault(kind, {})[num] = data.as_py()
        self.copy = np.isin(self.ids, np.fromiter(copies, np.int64, len(copies))) & (self.ids != NO_ID)
        at, size = K.groups(self.ids)
        self.repeated = np.repeat(size > 1, size) & (self.ids != NO_ID)
        self.first = self.ids.copy()
        for i in np.flatnonzero(self.copy):
            own = copies[int(self.ids[i])]
            if self.repeated[i]:  # of the rows with this id, those whose text is the copy
                digest = hashlib.sha256(self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()).digest()
                own = [x for x in own if x[:32] == digest]
                self.copy[i] = bool(own)
            if own:
                self.first[i] = int.from_bytes(own[0][32:], "big", signed=True)

    def words(self, fold: np.ndarray | None = None) -> None:
        self.starts, self.ends, self.doc = K.word_spans(self.data, self.offsets)
        self.hashes = K.span_hashes(self.data, self.starts, self.ends, fold)
        self.first_word = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first_word)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of words, and which of them lie in one document that is no copy."""
        rolled = K.rolling(self.hashes, width)
        n = len(rolled)
        own = (self.doc[:n] == self.doc[width - 1 : width - 1 + n]) & ~self.copy[self.doc[:n]] if n else np.zeros(0, bool)
        return rolled, own

    def second_hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words, independent of the first ones: with these, a word has 128 bits."""
        return K.span_hashes(self.data, self.starts, self.ends, fold, seed=1)


class Sorted:
    """Hashes of a chunk, grouped: order (places by hash), values (distinct, by their first bits), groups.

    With second hashes, values are distinct pairs, and seconds has each one's other half.
    """

    def __init__(self, hashes: np.ndarray, keep_bits: int = 64, second: np.ndarray | None = None):
        own = hashes >> np.uint64(64 - keep_bits) if keep_bits < 64 else hashes
        self.order = np.argsort(own) if second is None else np.lexsort((second, own))
        self.sorted = own[self.order]
        self.at, self.size = K.groups(self.sorted) if second is None else K.pair_groups(self.sorted, second[self.order])
        self.values = self.sorted[self.at]
        self.seconds = None if second is None else second[self.order][self.at]
        self.keep_bits = keep_bits

    def buckets(self, bits: int) -> list[tuple[int, slice]]:
        of = (self.values >> np.uint64(self.keep_bits - bits)).astype(np.int64)
        at, size = K.groups(of)
        return [(int(of[a]), slice(int(a), int(a + n))) for a, n in zip(at, size, strict=True)]

    def low(self, own: slice, bits: int) -> np.ndarray:
        """The values of a bucket without its own bits."""
        rest = self.keep_bits - bits
        return self.values[own] & np.uint64((1 << rest) - 1)

    def spread(self, by_value: np.ndarray) -> np.ndarray:
        """For each place, what its value has."""
        out = np.empty(len(self.order), by_value.dtype)
        out[self.order] = np.repeat(by_value, self.size)
        return out

    def bits_from(self, notes: dict[int, bytes], bits: int) -> np.ndarray:
        out = np.zeros(len(self.values), bool)
        for b, own in self.buckets(bits):
            out[own] = K.unpack_bits(notes[b], own.stop - own.start)
        return out


def sent_table(chunk: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())], schema=SENT_ARROW)


class Gathered:
    """Values that chunks have sent to a bucket: equal ones side by side, answers dealt back in the order sent."""

    def __init__(self, arrays: list[np.ndarray], seconds: list[np.ndarray] | None = None):
        self.sizes = [len(a) for a in arrays]
        every = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        if seconds is None:
            self.order = np.argsort(every)
            self.at, self.size = K.groups(every[self.order])
        else:
            second = np.concatenate(seconds) if seconds else every
            self.order = np.lexsort((second, every))
            self.at, self.size = K.pair_groups(every[self.order], second[self.order])

    def sorted(self, arrays: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(arrays)[self.order]

    def deal(self, in_order: np.ndarray) -> list[np.ndarray]:
        out = np.empty(len(self.order), in_order.dtype)
        out[self.order] = in_order
        return np.split(out, np.cumsum(self.sizes)[:-1])
