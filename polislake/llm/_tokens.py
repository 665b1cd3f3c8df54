"""Words, hashes and packed arrays straight from Arrow string buffers, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit and depend on the bytes and a seed alone: the same in
every worker and run. Two seeds give independent hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
U = np.uint64


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps workers, and a later stage needs the room."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the published SplitMix64 constants)."""
    y = x.astype(U, copy=False) >> U(30)
    x = y ^ x.astype(U, copy=False)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, U(27), out=y)
    x *= U(0x94D049BB133111EB)
    x ^= np.right_shift(x, U(31), out=y)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def lower_az(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


class Words:
    """The words of some texts: `start`, `end` in `data`; `first` (texts + 1) offsets into the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        space = SPACE[data]
        word = ~space
        before = np.empty(n, bool)
        before[0], before[1:] = True, space[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = True
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, space[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed, lower)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: The first n bytes of a little-endian 64-bit integer, by n.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def by_eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as integers; zeros after the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """A hash of the bytes of each span: the sum of a bijection of each eight bytes, another one at each place and for each seed.

    Spans that differ in one group of eight bytes never share a hash; others do by chance alone, and not for another seed."""
    if lower:
        data = lower_az(data)
    eight = by_eights(data)
    size = end - start
    key = mix(np.array([seed], U) + U(0xD6E8FEB86659FD93))
    h = mix((eight[start] & FIRST[np.minimum(size, 8)]) + key)
    long = np.flatnonzero(size > 8)
    if len(long):
        head, rest, place, used = _after_eight(size[long])
        values = eight[np.repeat(start[long], rest) + 8 * place] & FIRST[used]
        h[long] += np.add.reduceat(mix(values + mix(place.astype(U) * U(0x9E3779B97F4A7C15) + key)), head)
    return mix(h + size.astype(U) * U(0x9E3779B97F4A7C15))


def _after_eight(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups of eight bytes after the first, of spans longer than one: where each span's begin, how many it has, and each group's place and bytes."""
    rest = (size - 1) // 8
    head = np.cumsum(rest) - rest
    place = np.arange(int(rest.sum())) - np.repeat(head, rest) + 1
    return head, rest, place, np.minimum(np.repeat(size, rest) - 8 * place, 8)


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span of `data` has the bytes of the span of `other` with its number."""
    a, b, size = by_eights(data), by_eights(other), end - start
    same = (size == other_end - other_start) & (((a[start] ^ b[other_start]) & FIRST[np.minimum(size, 8)]) == 0)
    long = np.flatnonzero(same & (size > 8))
    if len(long):
        head, rest, place, used = _after_eight(size[long])
        apart = (a[np.repeat(start[long], rest) + 8 * place] ^ b[np.repeat(other_start[long], rest) + 8 * place]) & FIRST[used]
        same[long] = np.bitwise_or.reduceat(apart, head) == 0
    return same


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions of the array are left out."""
    if len(h) < n:
        return np.zeros(0, U)
    m = len(h) - n + 1
    out = np.zeros(m, U)
    for j, c in enumerate(constants(seed + 101, n)):
        out += h[j : j + m] * c
    return mix(out)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where n words of one text begin, and their texts."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + inside, doc


def portions(column: pa.Array, at_most: int = 2 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of texts of about `at_most` bytes together (a longer text is a run of its own): rows, bytes, offsets."""
    data, offsets = strings(column)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + at_most, "right")) - 1)
        yield slice(a, b), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
    give_back()


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of data side by side, and their offsets."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return data[at], offsets


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one or more dtypes as bytes; integers that fit take fewer bytes."""
    head, body = [], []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a):
            low, high = a.min(), a.max()
            if low >= 0:
                a = a.astype(np.uint8 if high < 1 << 8 else np.uint16 if high < 1 << 16 else np.uint32 if high < 1 << 32 else a.dtype)
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(np.ascontiguousarray(a).tobytes())
    told = ",".join(head).encode()
    return len(told).to_bytes(2, "little") + told + b"".join(body)


def unpack(blob) -> list[np.ndarray]:
    blob = memoryview(blob)
    n = int.from_bytes(blob[:2], "little")
    out, at = [], 2 + n
    for kind, size in (x.split(":") for x in bytes(blob[2:at]).decode().split(",")):
        dtype, size = np.dtype(kind), int(size)
        out.append(np.frombuffer(blob[at : at + size * dtype.itemsize], dtype))
        at += size * dtype.itemsize
    return out


def split_by(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket and each bucket's bounds in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))
