"""Vectorised text kernels on UTF-8 bytes: words, word hashes, shingles.

All hashes are 64 bits wide and the same in every process.  A word's hash is a polynomial in
random byte values modulo 2**64, taken from one running sum over the bytes, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; bounds the memory of the running sums.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _P)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = _BYTES[LOWER]
_powers = {}


def _power(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        out = np.ones(size, np.uint64)
        out[1:] = base
        _powers[int(base)] = have = np.multiply.accumulate(out)
    return have[:n]


#: Words are runs of bytes other than space and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_binary column and the n + 1 offsets of its values in them."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = SPACED, hashes: bool = True, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, their hashes (A-Z as a-z), and the index of each document's first word.

    Words never span documents.  With ``prefixes``, the hashes are a matrix: the word's, then those of its first so many
    bytes, 0 where it isn't longer.  The last array has one entry for each document and the number of words.
    """
    starts, ends, hs = [], [], []
    at, n = 0, len(data)
    while at < n:
        cut = min(at + BLOCK, n)
        while cut < n and is_word[data[cut]]:
            more = is_word[data[cut : cut + 4096]]
            stop = cut + (len(more) if more.all() else int(np.argmin(more)))
            edge = off[np.searchsorted(off, cut, "left")]  # a document's end is as good
            cut = min(stop, int(edge)) if edge >= cut else stop
            if cut == edge:
                break
        part = data[at:cut]
        mask = is_word[part]
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        lo, hi = np.searchsorted(off, at, "left"), np.searchsorted(off, cut, "left")
        edges = off[lo:hi] - at  # documents that begin in here
        edges = edges[edges < len(part)]
        first[edges[mask[edges]]] = True
        before = edges[edges > 0] - 1
        last[before[mask[before]]] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if hashes and len(s):
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * _power(len(part), _P), out=run[1:])
            h = (run[e] - run[s]) * _power(len(part), _P_INV)[s]
            h = mix(h + (e - s).astype(np.uint64))
            if prefixes:
                back, more = _power(len(part), _P_INV)[s], [h]
                for k in prefixes:
                    stop_at = np.minimum(s + k, e)
                    more.append(np.where(e - s > k, mix((run[stop_at] - run[s]) * back + U(1000 + k)), U(0)))
                h = np.stack(more, axis=1)
            hs.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = cut
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hs) if hs else np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    return starts, ends, h, np.searchsorted(starts, off, "left")


def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; the whole sequence if it has fewer words."""
    w = _weights(k)
    n = len(h) - k + 1
    full = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        full += h[j : j + n] * w[j]
    full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            out.append(mix((h[a:b] * w[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray, salt: int = 0xA5A5A5A5) -> int:
    """A hash of a sorted set, as a signed long; 0 for the empty set only."""
    if not len(s):
        return 0
    x = mix((mix(s + U(salt)) * (_power(len(s), _P) | U(1))).sum(keepdims=True) + U(len(s)))
    return int(x.view(np.int64)[0]) or 1
