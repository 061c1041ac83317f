"""Slices of long texts, term counts of an Arrow batch and packed string columns, for work inside tasks."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .hashing import text_parts

SLICE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def texts_of(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of runs of rows of about ``max_bytes``; null is empty, no text is cut."""
    for i, buf, off in text_parts(batch.column(column), max_bytes):
        raw, at = buf.tobytes(), off.tolist()
        yield i, [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text in slices of about ``size`` bytes that begin at ASCII white space, so that no word is cut."""
    a = 0
    while len(text) - a > size:
        m = _BLANK.search(text, a + size)
        if not m:
            break
        yield text[a:m.start()]
        a = m.start()
    yield text[a:]


def strings(values: list[bytes]) -> pa.Array:
    """An Arrow string column of UTF-8 byte strings."""
    ends = np.cumsum([0, *map(len, values)])
    if ends[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(values), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(values)))
    return pa.LargeStringArray.from_buffers(len(values), pa.py_buffer(ends), pa.py_buffer(b"".join(values)))


def lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    """An Arrow list column of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), values)
