"""Best-fit packing of tokenised documents by hierarchical residual packing."""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K
from corpusmill.plans.storage import Scratch

#: Items packed by one task at the lowest level; groups that meet at each higher level; bins an end node hands up.
GROUP_ITEMS, FAN_IN = 32_768, 8
#: Texts that are handed to an encoder at once.
BATCH_ROWS = 1000
#: Bins with at most this part of the length left are emitted at once.
NEARLY_FULL = 1 / 256
#: A fixed value: the pattern by which byte-level BPE of this kind parts text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LONG_RUN = re.compile(r"\s{1024}")


class Encoder:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    That library's pre-tokeniser takes most of its time, so the file's own vocabulary is handed to a faster engine
    of the same rules. Texts that hold a string of a special token, which only the library parts from its
    surroundings, or a long run of white space, on which the fast engine overflows its stack, go to the library.
    ``check`` compares the two on a text and raises if they ever differ; a test compares them on every code point.
    """

    def __init__(self, path: str):
        # One text at a time needs no threads, each of which would keep memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Byte-level vocabularies write each byte as a printable character: itself where it is one, else from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        as_byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(as_byte[c] for c in token): n for token, n in self.tokenizer.get_vocab().items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or _LONG_RUN.search(text):
            return np.array(self.slow(text), np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def check(self, text: str) -> None:
        if self.slow(text) != self.encode(text).tolist():
            raise ValueError("the tokenizer file is no byte-level BPE of the known kind")


_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("crcs", pa.list_(pa.int64()))])
_PIECES_SQL = "row long, doc_id long, first long, n_ids long, crcs array<bigint>"


def _tokenise(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, piece = Encoder(path), TaskContext.get().partitionId() << 40
        K.give_back()
        for batch in batches:
            rows: list[tuple] = []
            if batch.num_rows:
                encoder.check((batch.column(1)[0].as_py() or "")[:2000])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                head = len(ids) % most or most
                cuts = [0, *range(head, len(ids) + 1, most)]
                rows.append((piece, doc_id, head, len(ids), [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]))
                piece += len(cuts) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _PIECES.types, strict=True)], schema=_PIECES)

    return run


def best_fit(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Bins of item places: items by falling size, each into the fullest bin that still has room."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # distinct rooms, sorted
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        at = bisect_left(rooms, need)
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, most
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            bins[b].append(i)
        if room := room - need:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins


_NODE = pa.schema([("item", pa.int64()), ("size", pa.int64()), ("grp", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("bin_size", pa.int64()), ("open", pa.bool_())])
_NODE_SQL = "item long, size long, grp long, bin long, offset long, bin_size long, open boolean"


def _pack(most: int, last: bool):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        items, sizes = table["item"].to_numpy(), table["size"].to_numpy()
        order = np.lexsort((items, -sizes))
        items, sizes = items[order], sizes[order]
        bins = best_fit(sizes, most)
        full = np.array([int(sizes[b].sum()) for b in bins])
        small = np.flatnonzero(2 * full <= most)  # one at most: two would have shared a bin
        large = np.flatnonzero((2 * full > most) & (full < most * (1 - NEARLY_FULL)))
        large = large[np.argsort(full[large], kind="stable")][:FAN_IN]  # no more small bins than this meet at the next level
        open_ = np.zeros(len(bins), bool)
        open_[small] = open_[large] = not last
        own = np.concatenate([np.array(b) for b in bins])
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        offset = np.cumsum(sizes[own]) - sizes[own]
        offset -= np.repeat((np.cumsum(full) - full), [len(b) for b in bins])
        first = items[[b[0] for b in bins]]
        cols = (items[own], sizes[own], np.full(len(own), key[0].as_py()), first[of], offset, full[of], open_[of])
        return pa.table(list(cols), schema=_NODE)

    return pack


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within hands so many rows at once to Python; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", most: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of documents packed into sequences of at most ``most`` tokens, as few as the tree of best fits finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its ids and ``end_id``; a
    longer one is cut so that only its first piece may be shorter than ``most``. Full pieces are sequences. The
    others are packed best-fit in groups; bins that are nearly full are emitted, and of the rest each group hands
    up those that can still combine, as items, FAN_IN groups meeting at a node, up to one root. A node gets at most
    FAN_IN * (FAN_IN + 1) items above the lowest level, whatever the input.

    Null or empty text: the end id alone. Null doc_id stays null; repeated rows are packed each. Texts of any
    length are encoded whole. Strings of special tokens get the ids that the file gives them. Empty table: empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    with _batches_of(spark, BATCH_ROWS):
        pieces = scratch.keep(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_tokenise(tokenizer, end_id, most), _PIECES_SQL), "pieces")
    full = F.col("first") == most
    n = pieces.filter(~full).count()
    groups = max(1, math.ceil(n / GROUP_ITEMS))
    items = pieces.filter(~full).select(F.col("row").alias("item"), F.col("first").alias("size"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"))
    levels, level = [], 0
    while True:
        node = scratch.keep(items.groupBy("grp").applyInArrow(_pack(most, groups == 1), _NODE_SQL), f"level{level}")
        levels.append(node)
        if groups == 1:
            break
        groups, level = math.ceil(groups / FAN_IN), level + 1
        items = node.filter("open").groupBy("bin").agg(F.first("bin_size").alias("size"), F.floor(F.first("grp") / FAN_IN).alias("grp")).withColumnRenamed("bin", "item")
    # From the root down, so that all but the lowest of these joins are small.
    place = levels[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for node in reversed(levels[:-1]):
        up = place.select(F.col("item").alias("bin"), F.col("sequence_id").alias("up"), F.col("offset").alias("up_offset"))
        place = node.select("item", "bin", "offset").join(up, "bin", "left").select("item", F.coalesce("up", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("up_offset", F.lit(0))).alias("offset"))
    rows = pieces.join(place, pieces["row"] == place["item"], "left").select("row", "doc_id", "first", "n_ids", "sequence_id", "offset", F.posexplode("crcs").alias("piece", "ids_crc32"))
    head = F.col("piece") == 0
    own = head & F.col("sequence_id").isNotNull()
    return rows.select(
        "doc_id", "piece",
        F.when(head, 0).otherwise(F.col("first") + (F.col("piece") - 1) * most).cast("long").alias("start"),
        F.when(head, F.col("first")).otherwise(F.lit(most)).cast("long").alias("length"), "ids_crc32",
        F.when(own, F.col("sequence_id")).otherwise(F.col("row") + F.col("piece")).alias("sequence_id"),
        F.when(own, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
