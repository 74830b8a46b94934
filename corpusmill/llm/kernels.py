"""Vectorised kernels over the bytes of many texts at once: words, rolling hashes, and packed integer arrays."""

from __future__ import annotations

import ctypes
import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard

#: White space that parts words: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
#: A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random number for each byte.
LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None
#: Spans of more bytes than this are hashed one by one.
_LONG_SPAN = 256


def give_back() -> None:
    """Return freed memory to the system: the process of a task lives on for other ones, of other stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (in place)."""
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def flatten(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and each text's offsets; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.fill_null("").cast(pa.large_binary())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the place of each word's text."""
    n = len(data)
    space = _SPACE[data]
    at = np.empty(n, bool)
    if n:
        at[0], at[1:] = True, space[:-1]
        at[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(~space & at)
    if n:
        at[-1], at[:-1] = True, space[1:]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        at[last] = True
    ends = np.flatnonzero(~space & at) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(counts)), counts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, alike wherever the span stands; other seeds give independent hashes.

    Eight bytes at a time go through a bijection of the state, so that spans of at most eight bytes and equal length
    never meet, and no arithmetic relation between bytes carries over. ``fold`` maps bytes before hashing.
    """
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data if fold is None else fold[data]
    lanes = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
    size = ends - starts
    out = mix((size.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(seed * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    at, left = starts, np.minimum(size, _LONG_SPAN)
    which: np.ndarray | None = None
    while len(at):
        v = lanes[at]
        short = left < 8
        v[short] &= (_U(1) << (left[short].astype(np.uint64) * _U(8))) - _U(1)
        if which is None:
            out = mix(out ^ v)
        else:
            out[which] = mix(out[which] ^ v)
        more = np.flatnonzero(left > 8)
        at, left, which = at[more] + 8, left[more] - 8, more if which is None else which[more]
    for i in np.flatnonzero(size > _LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(held[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _U(0xC2B2AE3D27D4EB4F)
    out ^= out >> _U(32)
    out += b
    out *= _U(0x9FB21C651E98DF25)
    out ^= out >> _U(29)
    return out


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` following items, joined in runs of 1, 2, 4, ... items."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, run, size = None, 0, hashes, 1
    while True:
        if width & size:
            own = run[at : at + n]
            out, at = own.copy() if out is None else _joined(out, own), at + size
        if 2 * size > width:
            return mix(out)
        run, size = _joined(run[:-size], run[size:]), 2 * size


def pack_ints(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as zstd-packed byte planes; rising ones as differences."""
    v = np.ascontiguousarray(values).astype(np.int64, copy=False).view(np.uint64) if values.dtype != np.uint64 else values
    if rising:
        v = np.diff(v, prepend=_U(0))
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(v.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<qb?", len(v), width, rising) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    n, width, rising = struct.unpack_from("<qb?", blob)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[10:], max_output_size=max(1, n * width)), np.uint8).reshape(width, n).T
    v = out.reshape(-1).view("<u8")
    return np.cumsum(v, dtype=np.uint64) if rising else v


def pack_plain(values: np.ndarray) -> bytes:
    """Numbers that no packing shortens, such as hashes in no order."""
    return np.ascontiguousarray(values, "<u8").tobytes()


def unpack_plain(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def pack_bytes(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, struct.unpack_from("<q", blob)[0]))


def pack_bits(bits: np.ndarray) -> bytes:
    return pack_bytes(np.packbits(bits).tobytes())


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpack_bytes(blob), np.uint8), count=n).astype(bool)


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<b{len(parts)}q", len(parts), *map(len, parts)) + b"".join(parts)


def unbundle(blob: bytes) -> list[bytes]:
    n = blob[0]
    sizes = struct.unpack_from(f"<{n}q", blob, 1)
    ends = np.cumsum((1 + 8 * n, *sizes)).tolist()
    return [blob[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def pair_groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal pairs."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    return starts, np.diff(np.append(starts, len(first)))


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span; spans may overlap."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def slices(offsets: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text."""
    out, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, len(offsets) - 1)))
        a = out[-1][1]
    return out
