"""Vectorised scans over concatenated UTF-8 texts: substring hashes, words, sliding minima.

Everything here works on one flat uint8 buffer holding many texts, by numpy passes over all words or positions at
once; no Python object is made for each, but for spans of more than 512 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix-style)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_WORD = np.dtype("<u8")
#: Bits of a word's first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: Spans of more bytes are hashed one at a time by a cryptographic hash.
_LONG = 512


class Buffer:
    """A flat byte buffer and hashes of its substrings.

    ``hash(start, end)`` runs over a span's eight-byte words, mixing after each; it depends on the bytes, the length
    and the seed only, not on where they stand. Two seeds give two independent hashes.
    """

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        padded = np.concatenate((flat, np.zeros(8, dtype=np.uint8)))
        self._words = np.ndarray((len(flat) + 1,), dtype=_WORD, buffer=padded, strides=(1,))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the ``n`` bytes, eight at most, from each place on that has so many."""
        return mix64((self._words[: max(0, len(self.flat) - n + 1)] & _FIRST[n]) + U64(0x9E3779B97F4A7C15))

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        start, size = np.asarray(start, dtype=np.int64), np.asarray(end - start, dtype=np.int64)
        out = mix64(size.astype(U64) * U64(0xA24BAED4963EE407) + U64((seed * 0x9FB21C651E98DF25 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        out = mix64((out ^ (self._words[start] & _FIRST[np.minimum(size, 8)])) * U64(0x9E3779B97F4A7C15)) if len(start) else out
        rest = np.flatnonzero((size > 8) & (size <= _LONG))
        done = 8
        while len(rest):
            word = self._words[start[rest] + done] & _FIRST[np.minimum(size[rest] - done, 8)]
            out[rest] = mix64((out[rest] ^ word) * U64(0x9E3779B97F4A7C15) + U64(1))
            done += 8
            rest = rest[size[rest] > done]
        for k in np.flatnonzero(size > _LONG):
            digest = hashlib.blake2b(self.flat[start[k] : start[k] + size[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            out[k] = int.from_bytes(digest, "little")
        return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the index of the least of their upper 32 bits (the leftmost of equals).

    Values are packed with their index (fixed widths, so that a choice does not depend on the buffer's length), then block-wise running minima from both sides give each window in
    constant time.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    packed = (values >> U64(32)) << U64(32) | np.arange(len(values), dtype=U64)
    pad = -len(packed) % width
    grid = np.concatenate((packed, np.full(pad, np.iinfo(np.uint64).max, dtype=U64))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (best & U64(0xFFFFFFFF)).astype(np.int64)
