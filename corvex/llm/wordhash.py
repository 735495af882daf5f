"""Vectorised word hashing over whole Arrow batches.

All functions work on the UTF-8 bytes of many documents at once: one byte
buffer plus document offsets, as Arrow lays out a string column.  A word is a
maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` inside one document.
Short words are hashed in blocks of eight bytes, all words at once, each block
mixed into the state before the next; the few long ones go through BLAKE2.  No
step is linear in the bytes, so that no pattern of letters cancels out as it
does in polynomial sums modulo a power of two.
"""

from __future__ import annotations

import ctypes
from hashlib import blake2b
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
P_WORD = 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 24

#: Bytes of text that one numpy pass takes; a single longer document is taken alone.
CHUNK_BYTES = 1 << 20


class _Powers:
    """p**i and p**-i modulo 2**64, grown on demand."""

    def __init__(self, p: int) -> None:
        self.p, self.up, self.down = p, np.ones(1, dtype=U), np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            inverse = pow(self.p, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.p), ("down", inverse)):
                    steps = np.full(size, U(base), dtype=U)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit words (shift, multiply, shift)."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & MASK)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes; seeds give independent functions."""
    size = end - start
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    keep = np.array([MASK >> (64 - 8 * k) if k else 0 for k in range(9)], dtype=U)
    with np.errstate(over="ignore"):
        out = mix(blocks[start] & keep[np.minimum(size, 8)] ^ size.astype(U) * U(P_WORD), 2 * seed + 51)
        left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        for at in range(8, LONG_WORD, 8):
            if not len(left):
                break
            more = blocks[start[left] + at] & keep[np.minimum(size[left] - at, 8)]
            out[left] = mix(out[left] * U(P_WORD) + more, 2 * seed + 52)
            left = left[size[left] > at + 8]
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        key = seed.to_bytes(8, "little")
        raw = [blake2b(data[a:b], digest_size=8, key=key).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(raw), dtype="<u8")
    return out


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes, in order: runs of powers of two are put together from two halves."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    power, size, out, done = hashes, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                out = power if out is None else mix(out[: len(power) - done] * U(P_WORD) + power[done:], size + 300)
                done += size
            if 2 * size > k:
                break
            power = mix(power[:-size] * U(P_WORD) + power[size:], size + 100)
            size *= 2
    return out[:n]


class SortedKeys:
    """Sorted 64-bit keys with values; an index of the top bits leads to each key's neighbourhood."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.int64)
        self.first = np.searchsorted(self.keys >> U(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=U)).astype(np.int32)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each key, or -1; whether it is there)."""
        value, there = np.full(len(asked), -1, dtype=np.int64), np.zeros(len(asked), dtype=bool)
        bucket = (asked >> U(64 - self.BITS)).astype(np.int64)
        at, to = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < to)
        at, to = at[left].astype(np.int64), to[left]
        while len(left):
            same = self.keys[at] == asked[left]
            value[left[same]], there[left[same]] = self.values[at[same]], True
            on = ~same & (at + 1 < to)
            left, at, to = left[on], at[on] + 1, to[on]
        return value, there


class Words:
    """Words of a chunk of documents.

    data: bytes; offsets: of the documents in data (n + 1); start, end: bytes
    of each word; first: index of each document's first word (n + 1); hash:
    64-bit hash of each word.
    """

    __slots__ = ("data", "end", "first", "hash", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        space = np.ones(n + 1, dtype=bool)
        np.take(_SPACE, data, out=space[:n])
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = True
            before[1:] = space[: n - 1]
            inner = offsets[:-1]
            inner = inner[inner < n]
            before[inner] = True
            self.start = np.flatnonzero(~space[:n] & before)
            after = space[1:].copy()
            ends = offsets[1:]
            after[ends[ends > 0] - 1] = True
            self.end = np.flatnonzero(~space[:n] & after) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.hash = hash_slices(data, self.start, self.end)

    def second(self) -> np.ndarray:
        """Hashes of the words by another function of their bytes."""
        return hash_slices(self.data, self.start, self.end, 1)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave the document hold no meaning (see inside())."""
        return combine(self.hash, k)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, last row + 1, bytes, offsets) of about ``size`` bytes; each row falls in exactly one."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


#: What tasks of an operator keep in their worker for its next tasks.
KEPT: dict[tuple[str, str], object] = {}


def forget() -> None:
    """Drops what earlier tasks have kept in this worker."""
    if KEPT:
        KEPT.clear()
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable, keeps: bool = False) -> Callable:
    """run for mapInArrow; at its end the worker, which other stages will use, gives memory back to the system.

    What another operator's tasks have kept there goes before it starts, unless
    run keeps such things itself.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped
