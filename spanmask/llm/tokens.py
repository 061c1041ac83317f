"""Token ids as Parquet list columns, with row groups and pages sized for selective reads.

Texts are dealt into ranges of doc_id, encoded inside the tasks and written in
doc_id order by Spark's Parquet writer: an int list column, dictionary-encoded
(ids are few and skewed; ``encoding='delta'`` switches to delta packing), rows
of a file in doc_id order, so that the page index lets a reader skip to a range
of documents, and lengths in a column of their own, so that offsets are read
without touching a token.

Cases: null and empty texts have the end id alone; an added token of the
tokenizer (``<|endoftext|>``) that a text holds is its own id, as the library has it; repeated doc_ids keep all
their rows, side by side, in the order of the input; null doc_ids come first; an empty table gives an
empty file set; other columns are ignored.
"""
from __future__ import annotations

import importlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import prefix_sums, span_hash, text_parts

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10
CACHE = 250_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True              # for pieces of text; added tokens are cut out before
    return t


class Cache:
    """Ids of pieces seen lately: two generations of at most ``CACHE`` pieces, as packed 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer, self.new, self.old = _tokenizer(path), {}, {}

    def fill(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for p in pieces:
            if p not in new:
                if p in old:
                    new[p] = old[p]
                else:
                    missing.append(p)
        for i in range(0, len(missing), 20_000):
            part = missing[i:i + 20_000]
            found = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            for p, e in zip(part, found):
                new[p] = array("i", e.ids).tobytes()
        return new


@lru_cache(maxsize=2)
def _cache(path: str) -> Cache:
    return Cache(path)


def _kinds() -> np.ndarray:
    k = np.full(256, PUNCT, np.uint8)
    k[48:58] = DIGIT
    k[65:91] = k[97:123] = LETTER
    k[9:14] = k[28:32] = BREAK
    k[32], k[39], k[128:] = SPACE, QUOTE, WIDE
    return k


PUNCT, DIGIT, LETTER, BREAK, SPACE, QUOTE, WIDE = range(7)
KIND = _kinds()


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places where the byte-level pre-tokenizer cuts whatever else the text holds.

    White space begins a piece after anything but white space; letters and
    marks other than the apostrophe part; a lone line break stands by itself.
    Places beside characters of three or four bytes are left alone.
    """
    k = KIND[buf]
    a, b = k[:-1], k[1:]
    # the last byte of a two-byte character from U+00C0 on, none of which is white space
    two = np.zeros(len(a), bool)
    two[1:] = (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xDF)
    solid = (a <= LETTER) | (a == QUOTE) | ((a == WIDE) & two)
    blank = (b == SPACE) | (b == BREAK)
    cut = solid & blank
    cut |= (a == LETTER) & (b == PUNCT)
    cut |= (a == PUNCT) & (b == LETTER)
    lone = np.zeros(len(a), bool)
    lone[1:] = cut[:-1] & (a[1:] == BREAK)      # a break that begins a piece ...
    cut |= lone & (b <= LETTER)                 # ... and is followed by something else at once
    return cut


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern | None, dict[bytes, bytes]]:
    """Pattern of the tokenizer's added tokens (the longest at a place) and their packed ids."""
    added = _tokenizer(path).get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in added.values()) or _tokenizer(path).normalizer is not None:
        raise ValueError("only added tokens that stand for their literal text are handled")
    ids = {t.content.encode(): array("i", [i]).tobytes() for i, t in added.items()}
    return (re.compile(b"|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None), ids


def encode_texts(buf: np.ndarray, off: np.ndarray, path: str) -> list[bytes]:
    """Packed ids of each whole text; an added token in a text is its own id."""
    pattern, ids = _added(path)
    raw = buf.tobytes()
    if pattern is None or not pattern.search(raw):
        return encode_parts(buf, off, path)
    ends, kind, first = [], [], [0]                 # ends and added ids of the parts, each text's first part
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        for m in pattern.finditer(raw, a, b):
            ends += m.span()
            kind += (None, ids[m[0]])
        ends.append(b)
        kind.append(None)
        first.append(len(ends))
    parts = encode_parts(buf, np.array([0, *ends]), path)
    parts = [p if k is None else k for p, k in zip(parts, kind)]
    return [b"".join(parts[a:b]) for a, b in zip(first[:-1], first[1:])]


def encode_parts(buf: np.ndarray, off: np.ndarray, path: str) -> list[bytes]:
    """Packed ids of each whole text, an added token's characters taken as any others (see :func:`encode_texts`)."""
    here = np.zeros(len(buf) + 1, bool)
    here[off] = True
    if len(buf) > 1:
        here[1:-1] |= cuts(buf)
    at = np.flatnonzero(here)
    first = np.searchsorted(at, off)
    if len(at) < 2:
        return [b""] * (len(off) - 1)
    start, end = at[:-1], at[1:]
    distinct = pa.array(span_hash(prefix_sums(buf), start, end)).dictionary_encode()
    which = distinct.indices.to_numpy()
    rep = np.empty(len(distinct.dictionary), np.int64)
    rep[which[::-1]] = np.arange(len(which) - 1, -1, -1)          # the first place of each
    if len(rep) < len(start):
        # equal hashes must be equal bytes; else every piece stands for itself
        size = end - start
        same = (size == size[rep[which]]).all() and (buf[np.arange(len(buf)) - np.repeat(start - start[rep[which]], size)] == buf).all()
        if not same:
            rep = which = np.arange(len(start))
    raw = buf.tobytes()
    pieces = [raw[x:y] for x, y in zip(start[rep].tolist(), end[rep].tolist())]
    ids = list(map(_cache(path).fill(pieces).__getitem__, pieces))
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.int32)
    base, n = (np.cumsum(n) - n)[which], n[which]
    total = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.repeat(base - total[:-1], n) + np.arange(total[-1])]
    cut = total[first]
    return [out[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _encoder(path: str, end_id: int):
    end = np.int32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, buf, off in text_parts(b.column("text"), 4 << 20):
                packed = [x + end for x in encode_texts(buf, off, path)]
                n = np.array([len(x) // 4 for x in packed], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]).astype(np.int32)),
                                                pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, len(n)) for c in ("part", "pos", "doc_id")), pa.array(n), flat],
                                                 ["part", "pos", "doc_id", "n_tokens", "ids"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, encoding: str = "dictionary") -> None:
    """Write (part, pos, doc_id, n_tokens, ids) in ascending doc_id order; parts are ranges of doc_id in order, pos is the place in a part."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.col("row")                          # many rows with one doc_id can still be split
    dealt = (rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
             .select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "doc_id", "text"))
    (dealt.mapInArrow(_encoder(tokenizer, end_id), "part int, pos long, doc_id long, n_tokens long, ids array<int>")
     .write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2").parquet(path))


def _started(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``rows`` (part, pos, n_tokens, ...) with ``start``, the ids before each in the files; ``lengths`` are read for the parts' sums."""
    sums = lengths.groupBy("part").agg(F.sum("n_tokens").alias("s"))                       # one row per part, not per document
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))
    w = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("upto", F.sum("n_tokens").over(w)).join(before, "part")
            .withColumn("start", F.col("before") + F.col("upto") - F.col("n_tokens")).drop("upto", "before"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """part, pos, doc_id, n_tokens, start from the length columns alone (no token is read)."""
    rows = spark.read.parquet(path).select("part", "pos", "doc_id", "n_tokens")
    return _started(rows, rows)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """part, pos, doc_id, n_tokens, ids of the documents with first <= doc_id <= last (pushed down to pages)."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        off, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4", copy=False)
        crc = pa.array([zlib.crc32(flat[x:y]) for x, y in zip(off[:-1], off[1:])], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "pos", "doc_id")), pa.array(np.diff(off).astype(np.int64)), crc],
                                         ["part", "pos", "doc_id", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files."""
    files = spark.read.parquet(path)
    rows = files.mapInArrow(_digest, "part int, pos long, doc_id long, n_tokens long, ids_crc32 long")
    return _started(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")
