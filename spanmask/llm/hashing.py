"""Vectorised text hashing inside tasks: spans of UTF-8 bytes, words and word shingles of an Arrow batch."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
OTHER_BASE = 0xD6E8FEB86659FD93
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public-domain splitmix64 generator."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}          # of each base, the longest that was asked for


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(1 << 20, 1 << (n - 1).bit_length()), base, U)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(BASE) + U(seed))


def prefix_sums(buf: np.ndarray, seed: int = 1) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, for :func:`span_hash`."""
    s = np.zeros(len(buf) + 1, U)
    np.cumsum(byte_table(seed)[buf] * powers(BASE, len(buf) + 1)[:-1], out=s[1:])
    return s


def value_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """The same sums over given values instead of bytes."""
    s = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values) + 1)[:-1], out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of the bytes start..end; equal bytes give equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums))[start])


LONG_SPAN = 4096
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def span_digest(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of the bytes start..end, mixed eight bytes at a time; unlike :func:`span_hash` it has no linear structure."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = mix(size.astype(U) * U(BASE) + U(seed))
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    pos, left = start[live], size[live]
    while len(live):
        h[live] = mix((h[live] ^ (eight[pos] & _LOW[np.minimum(left, 8)])) * U(OTHER_BASE) + U(BASE))
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return h


def text_parts(texts: pa.Array, max_bytes: int = 2 << 20, max_rows: int = 1 << 15) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of runs of rows of about ``max_bytes``; null is empty, no text is cut."""
    for a in range(0, len(texts), 1024):                 # a batch is not copied as a whole
        some = pc.fill_null(texts.slice(a, 1024).cast(pa.large_string()), "")
        off = np.frombuffer(some.buffers()[1], np.int64, len(some) + 1, some.offset * 8)
        data = some.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            j = min(j, i + max_rows)
            yield a + i, buf[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's first word number (one more at the end)."""
    inside = np.concatenate([~space[buf], [False]])
    before = np.concatenate([[False], inside[:-1]])
    cut = np.zeros(len(inside), bool)
    cut[off] = True                                  # words end where a text ends
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, off: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and each text's first word number."""
    starts, ends, first = word_spans(buf, off)
    return span_hash(prefix_sums(_LOWER[buf], seed), starts, ends), first


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles (all words as one if they are fewer)."""
    starts, ends, first = word_spans(buf, off)
    w = span_digest(_LOWER[buf], starts, ends)
    n = max(0, len(w) - k + 1)
    sums = np.zeros(n, U)
    for j in range(k):
        sums += mix(w[j:j + n] + U(j + 1))
    sums = mix(sums)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(sums[a:b - k + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(mix(w[a + j:a + j + 1] + U(j + 1))[0]) for j in range(b - a)) + 977 * int(b - a) & (1 << 64) - 1], U)))
        else:
            out.append(np.zeros(0, U))
    return out
