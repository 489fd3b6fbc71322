"""Vectorised text kernels: Arrow string columns to word, shingle and MinHash arrays.

Words are runs of bytes outside ``\\x20\\x09-\\x0D`` after lower-casing A-Z; since every byte of a
multi-byte UTF-8 character is above 0x7F, working on bytes gives the same words as working on
characters.  All hashing is 64 bit and depends on nothing but the bytes, so results are the same
on every executor, partitioning and retry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes that one kernel call works on; numpy temporaries are about 40 times as large.
CHUNK_BYTES = 1 << 20

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)
_SHINGLE = np.uint64(0xD1B54A32D192ED03)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(_LOWER.astype(np.uint64) + np.uint64(1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_MULT, size + 1), _powers(_INV, size + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n+1 of each."""
    if n <= 2 * CHUNK_BYTES:
        return _tables(2 * CHUNK_BYTES)
    return _powers(_MULT, n + 1), _powers(_INV, n + 1)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
            column = column.cast(pa.string())
        width = np.int32
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of whole rows of about ``limit`` bytes; a longer text is a slice of its own."""
    data, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, window: int = CHUNK_BYTES, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word and, for each text, the index of its first word (one entry more than texts).

    Long input is worked on in windows that end at a separator, or at the end of a text, so temporaries are bounded unless a single word is long.
    ``sep`` marks the bytes that separate.
    """
    n = len(data)
    if n <= 2 * window:
        hashes, start, end = _words(data, offsets, sep)
        return hashes, start, end, np.searchsorted(start, offsets)
    found, a = [], 0
    while a < n:
        b = min(n, a + window)
        while b < n:
            # A cut behind a separator, or where a text ends, parts no word.
            gap = np.flatnonzero(sep[data[b : b + 4096]])
            k = int(np.searchsorted(offsets, b))
            ends = [int(offsets[k])] if k < len(offsets) and offsets[k] < b + 4096 else []
            if len(gap):
                ends.append(b + int(gap[0]) + 1)
            if ends:
                b = min(ends)
                break
            b = min(n, b + 4096)
        inner = offsets[(offsets > a) & (offsets < b)] - a
        hashes, start, end = _words(data[a:b], np.concatenate([[0], inner, [b - a]]), sep)
        found.append((hashes, start + a, end + a))
        a = b
    hashes, start, end = map(np.concatenate, zip(*found, strict=True))
    return hashes, start, end, np.searchsorted(start, offsets)


def _words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    pw, inv = powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:n], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * inv[start]), start, end


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its k-word shingle hashes in order, repeats included; the whole sequence as one where there are fewer words; none without words."""
    n = len(hashes)
    if n >= k:
        rolled = hashes[: n - k + 1].copy()
        for j in range(1, k):
            rolled = rolled * _SHINGLE + hashes[j : n - k + 1 + j]
        rolled = mix64(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield rolled[a : b - k + 1]
        elif b > a:
            with np.errstate(over="ignore"):
                x = np.uint64(b - a) * _GOLD
                for w in hashes[a:b]:
                    x = x * _SHINGLE + w
            yield mix64(np.array([x]))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, pick: np.ndarray | None = None, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingle hashes of each sequence of words (none is empty), or of the picked ones, ascending, in one array with its bounds; a shorter sequence is one shingle."""
    first, last = (bounds[:-1], bounds[1:]) if pick is None else (bounds[:-1][pick], bounds[1:][pick])
    size = np.maximum(last - first - k + 1, 1)
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(total[-1]) - np.repeat(total[:-1] - first, size)
    flat = np.zeros(len(at), np.uint64)
    long = np.flatnonzero(np.repeat(last - first >= k, size))
    where = at[long]
    rolled = hashes[where]
    for j in range(1, k):
        rolled = rolled * _SHINGLE + hashes[where + j]
    flat[long] = mix64(rolled)
    for n in range(1, k):
        short = np.flatnonzero(last - first == n)
        x = np.full(len(short), n, np.uint64) * _GOLD
        for j in range(n):
            x = x * _SHINGLE + hashes[first[short] + j]
        flat[total[short]] = mix64(x)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[keep], np.searchsorted(owner[keep], np.arange(len(size) + 1))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def set_digest(ordered: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set given as sorted distinct hashes."""
    if not len(ordered):
        return 0, 0
    place = np.arange(1, len(ordered) + 1, dtype=np.uint64) * _GOLD
    one = mix64(ordered ^ place).sum(dtype=np.uint64)
    two = mix64(ordered + place * _SHINGLE).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


@lru_cache(maxsize=8)
def minhash_family(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    base = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    return base[:k], base[k:] | np.uint64(1)


def minhash(values: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k independent minima of a set of hashes (not empty)."""
    add, mult = minhash_family(k, seed)
    best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 512):
        x = (values[a : a + 512, None] ^ add[None, :]) * mult[None, :]
        x ^= x >> np.uint64(32)
        np.minimum(best, (x * _GOLD).min(axis=0), out=best)
    return best


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0, len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return both, len(a) + len(b) - both
