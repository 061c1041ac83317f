"""Document features of the classifiers, computed from whole texts with array operations."""
from __future__ import annotations

import numpy as np

from .hashing import U, mix, prefix_sums, span_hash, word_hashes, word_spans

DIM = 1024

#: Character classes: lower-case and non-ASCII letters as a, upper-case as A, digits as 0, the rest as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def _rows(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def term_matrix(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Relative frequencies (square roots) of hashed terms, one row per text.

    Terms: the word's shape (runs of one character class count once), the word
    itself, whether it repeats the word before, and whether the text had it
    already.  A text without words has a row of zeros.
    """
    n = len(off) - 1
    w, first = word_hashes(buf, off)
    row = _rows(first)
    out = np.zeros((n, DIM), np.float32)
    total = np.maximum(np.diff(first), 1).astype(np.float32)

    shape = SHAPE[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = shape[1:] != shape[:-1]
    starts = off[:-1][off[:-1] < len(buf)]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    short, soff = shape[keep], place[off]
    s, e, sfirst = word_spans(short, soff)
    np.add.at(out, (_rows(sfirst), (span_hash(prefix_sums(short, 7), s, e) % U(DIM // 2)).astype(np.int64)), 1)

    np.add.at(out, (row, DIM // 2 + 8 + (mix(w) % U(DIM // 2 - 8)).astype(np.int64)), 0.1)
    if len(w):
        again = np.zeros(len(w), bool)
        again[1:] = (w[1:] == w[:-1]) & (row[1:] == row[:-1])
        np.add.at(out, (row[again], DIM // 2), 4)
        order = np.lexsort((w, row))
        had = np.zeros(len(w), bool)
        had[order[1:]] = (w[order][1:] == w[order][:-1]) & (row[order][1:] == row[order][:-1])
        np.add.at(out, (row[had], DIM // 2 + 1), 1)
        np.add.at(out, (row[~had], DIM // 2 + 2), 1)
    return np.sqrt(out / total[:, None])
