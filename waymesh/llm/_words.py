"""Words, word windows and lines of many texts at once, as numpy hashes over UTF-8 bytes.

A word is a maximal run of bytes other than space and the controls 9 to 13, which is what the
pattern `[^\\x20\\x09-\\x0D]+` matches. Segments of up to SHORT bytes are hashed by two polynomials
modulo primes near 2^32: two different segments of n bytes collide for n of the 2^32 bases of
each prime at most, whatever the bytes. Longer segments are hashed by BLAKE2. Windows of words
are hashed by a polynomial of the mixed word hashes. Where a batch holds all that is compared,
`word_ids` tells words apart by their bytes instead.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of a segment that polynomials hash.
SHORT = 64
#: The primes below 2^32 that are largest, and a base of each.
PRIMES, BASES = (4294967291, 4294967279), (2654435769, 1779033703)
_SEPARATOR = np.zeros(256, np.bool_)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PIECE = 1 << 20
_POWER: list[tuple[np.ndarray, np.ndarray]] = []


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime p, base^i and base^-i modulo p for i of a piece."""
    if not _POWER:
        _POWER.extend((_series(b, p), _series(pow(b, -1, p), p)) for b, p in zip(BASES, PRIMES))
    return _POWER


def _series(base: int, prime: int, size: int = _PIECE + SHORT + 1) -> np.ndarray:
    out = np.ones(size, np.uint64)
    filled = 1
    while filled < size:
        more = min(filled, size - filled)
        out[filled : filled + more] = out[:more] * U(pow(base, filled, prime)) % U(prime)
        filled += more
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of data[start:end] for each of the sorted, disjoint segments."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    for k in np.flatnonzero(size > SHORT):
        piece = data[starts[k] : ends[k]]
        out[k] = int.from_bytes(hashlib.blake2b((LOWER[piece] if lower else piece).tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= SHORT)
    i, n = 0, len(short)
    while i < n:
        a = int(starts[short[i]])
        j = max(i + 1, int(np.searchsorted(ends[short], a + _PIECE, side="right")))
        own = short[i:j]
        piece = data[a : int(ends[own[-1]])]
        code = (LOWER[piece] if lower else piece).astype(np.uint64) + U(1)
        s, e = starts[own] - a, ends[own] - a
        for (power, inverse), prime, shift in zip(powers(), PRIMES, (0, 32)):
            # at most 2^20 terms under 2^41: no sum passes 64 bits
            total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(code * power[: len(code)], out=total[1:])
            out[own] |= (total[e] - total[s]) % U(prime) * inverse[s] % U(prime) << U(shift)
        i = j
    return mix(out + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def word_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each of the sorted, disjoint, non-empty segments; equal ones, byte by byte, have the same."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    a = int(begin[0])
    edge = np.zeros(int(end[-1]) - a + 1, np.int8)
    edge[begin - a] += 1
    edge[end - a] -= 1
    bytes_ = data[a : int(end[-1])][np.cumsum(edge[:-1], dtype=np.int8).astype(np.bool_)]
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
    return np.asarray(array.dictionary_encode().indices).astype(np.uint64)


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word of each row): rows are the adjacent slices [start, end) of data.

    The last array has one more element than there are rows; starts must be sorted.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    a, b = int(starts[0]), int(ends.max())
    word = ~_SEPARATOR[data[a:b]]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = ends > starts
    s, e = starts[full] - a, ends[full] - a - 1
    first[s] = word[s]
    last[e] = word[e]
    begin = np.flatnonzero(first) + a
    end = np.flatnonzero(last) + a + 1
    return begin, end, np.r_[np.searchsorted(begin, starts), len(begin)]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for every i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * U(1)
    scale = 1
    for j in range(1, size):
        scale = scale * 0xA0761D6478BD642F % (1 << 64) | 1
        total += words[j : j + n] * U(scale)
    return mix(total)
