"""SentencePiece encoding as a relational lattice, and decoding.

Texts are cut where no piece of the vocabulary can span: between two characters
that stand side by side in no piece, so before every run of spaces among
others.  Such a segment's best
segmentation does not depend on its neighbours.  Distinct segments are exploded
into substrings of at most the longest piece's length, equi-joined to the piece
table, grouped again by segment, and the edges are folded into the path with
the largest sum of scores (the earliest start on ties).  A character without a
piece of its own falls back to its UTF-8 bytes.  The fold takes the edges of an
Arrow batch of segments in order of their ends; its state is one score and one
back pointer per segment and end, and a walk back from the last ones gives the ids.

The lattice runs once for frequent segments, counted over a bounded sample of
documents (``SAMPLE_DOCS``; it only decides what is kept at hand, at most
``HEAD`` segments, whose size is bounded), and once for all distinct segments
outside them; these reach their texts by a join on a digest of the text (16
bytes of its SHA-256), as ids in order of the segments' first places, which the
text alone decides.  Segments longer than ``LONG`` characters are
solved by the same recurrence inside the task, so that a fold never carries a
text-sized array.  Tables go as soon as nothing reads them.

The vocabulary file is a parameter and bounded (``MAX_PIECES``), so the piece
table may be broadcast.

Cases: null and empty texts have no ids; a literal U+2581 is a space, as in the
vocabulary's own convention, so it decodes to one; of rows that repeat a doc_id
each is encoded by itself; null doc_ids are encoded too; an empty table gives
no rows; other columns are ignored whatever their names.
"""
from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, handing_back, materialize
from .hashing import span_digest, text_parts

SPACE_MARK = "▁"
MAX_PIECES, HEAD, SAMPLE_DOCS, LONG = 1_000_000, 400_000, 20_000, 64
NARROW = 0x250
TASK_SEGMENTS = 25_000
#: An edge is one number: its end, its start and its piece's id, or NO_PIECE for a character without one.
START, END, PLACE, NO_PIECE = 20, 30, (1 << 10) - 1, (1 << 20) - 1


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    return importlib.import_module("public_tokenizers").path(name)


@dataclass
class Cut:
    """Segments of a run of texts; ``rep`` are the places of distinct ones and ``which`` each segment's."""
    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray           # each text's first segment, one more at the end
    h1: np.ndarray
    h2: np.ndarray
    rep: np.ndarray
    which: np.ndarray

    def text(self, i: int) -> str:
        return self.chars[self.start[i]:self.end[i]].tobytes().decode("utf-32-le")


@dataclass
class Head:
    """Ids of frequent segments, found by both hashes."""
    h1: np.ndarray
    h2: np.ndarray
    base: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    def find(self, k: Cut) -> np.ndarray:
        """Entry of each distinct segment, -1 for those not at hand."""
        if not len(self.h1):
            return np.full(len(k.rep), -1)
        at = np.minimum(np.searchsorted(self.h1, k.h1), len(self.h1) - 1)
        return np.where((self.h1[at] == k.h1) & (self.h2[at] == k.h2), at, -1)


def spelling(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters as bytes, the space mark as one blank and others in UTF-8, and the place of each (one more at the end)."""
    c = np.where(c == ord(SPACE_MARK), np.uint32(32), c)
    if not len(c) or c.max() < 128:
        return c.astype(np.uint8), np.arange(len(c) + 1)
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    return np.frombuffer(c.tobytes().decode("utf-32-le").encode(), np.uint8), np.concatenate([[0], np.cumsum(size)])


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of spans of a spelling."""
    return span_digest(raw, start, end, 1), span_digest(raw, start, end, 2)


def same_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span equals, byte by byte, the span at ``other`` of the same arrays."""
    size = end - start
    if (size != size[other]).any():
        return False
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    unlike = np.flatnonzero(start != start[other])
    a, b, left = start[unlike], start[other][unlike], size[unlike]
    while len(a):
        if ((eight[a] ^ eight[b]) << (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))).any():
            return False
        more = left > 8
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
    return True


NO_HEAD = Head(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int32)))


class Vocabulary:
    """Pieces with ids and scores, byte ids, and the pairs of characters that some piece holds."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > MAX_PIECES:
            raise ValueError(f"{path} has {n} pieces; at most {MAX_PIECES} may be broadcast")
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {i: int(sp.get_score(i)) for i in plain}
        self.unknown = min(score.values()) - 10
        self.pieces = {names[i]: (i, score[i]) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [names[i].encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        pairs = sorted({ord(a) << 21 | ord(b) for p in self.pieces for a, b in zip(p, p[1:])})
        self.pairs = np.array(pairs, np.uint64)
        # a table for low characters, the space mark (NARROW) and all others (NARROW + 1, looked up in ``pairs``)
        self.near = np.zeros((NARROW + 2, NARROW + 2), bool)
        self.near[self._low(self.pairs >> np.uint64(21)), self._low(self.pairs & np.uint64(0x1FFFFF))] = True

    @staticmethod
    def _low(c: np.ndarray) -> np.ndarray:
        t = np.minimum(c, NARROW + 1).astype(np.int32)
        t[c == ord(SPACE_MARK)] = NARROW
        return t

    def joined(self, c: np.ndarray) -> np.ndarray:
        """Whether characters i and i + 1 may stand in one piece."""
        t = self._low(c)
        out = self.near.ravel()[t[:-1] * (NARROW + 2) + t[1:]]
        other = t == NARROW + 1
        if other.any():
            wide = np.flatnonzero(other[:-1] | other[1:])
            key = c[:-1][wide].astype(np.uint64) << np.uint64(21) | c[1:][wide]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out[wide] = self.pairs[at] == key
        return out

    def cut(self, buf: np.ndarray, off: np.ndarray) -> Cut:
        """The independent segments of UTF-8 texts, as places in their characters with the space mark put in."""
        chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
        full = np.diff(place) > 0
        c = np.insert(np.where(chars == 32, np.uint32(ord(SPACE_MARK)), chars), place[:-1][full], np.uint32(ord(SPACE_MARK)))
        ends = place + np.concatenate([[0], np.cumsum(full)])
        here = np.zeros(len(c) + 1, bool)
        here[ends] = True
        if len(c) > 1:
            here[1:-1] |= ~self.joined(c)
        at = np.flatnonzero(here)
        start, end = at[:-1], at[1:]
        raw, byte = spelling(c)
        low, high = byte[start], byte[end]
        h1 = span_digest(raw, low, high, 1)
        which, distinct = pd.factorize(h1)
        rep = np.zeros(len(distinct), np.int64)
        rep[which[::-1]] = np.arange(len(start))[::-1]
        if not same_spans(raw, low, high, rep[which]):
            rep = which = np.arange(len(start))
        return Cut(c, start, end, np.searchsorted(at, ends), h1[rep], span_digest(raw, low[rep], high[rep], 2), rep, which)

    def segments(self, texts: list[str | None]) -> list[list[str]]:
        """The same segments as strings, for tests and small inputs."""
        out = []
        for _, buf, off in text_parts(pa.array(texts, pa.string())):
            k = self.cut(buf, off)
            words = [k.text(i) for i in range(len(k.start))]
            out += [words[a:b] for a, b in zip(k.first[:-1], k.first[1:])]
        return out

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")]

    def path_ids(self, segment: str) -> list[int]:
        """The lattice's recurrence for one overlong segment."""
        best: list[tuple] = [(0, 0, None)]
        for e in range(1, len(segment) + 1):
            options = []
            for s in range(max(0, e - self.longest), e):
                hit = self.pieces.get(segment[s:e]) or ((-1, self.unknown) if e - s == 1 else None)
                if hit:
                    options.append((best[s][0] + hit[1], -s, hit[0]))
            best.append(max(options))
        out, e = [], len(segment)
        while e:
            _, back, i = best[e]
            out.append([i] if i >= 0 else self.bytes_of(segment[-back:e]))
            e = -back
        return [i for part in reversed(out) for i in part]

    def spelled(self, segment: str, ids: list[int]) -> list[int]:
        """Ids of a lattice path with its byte fallbacks written out."""
        return [x for i in ids for x in ([i] if i >= 0 else self.bytes_of(segment[-1 - i]))]

    def own(self, segment: str) -> list[int] | None:
        """Ids of segments that need no lattice row: a lone character, or an overlong segment."""
        if len(segment) == 1:
            hit = self.pieces.get(segment)
            return [hit[0]] if hit else self.bytes_of(segment)
        return self.path_ids(segment) if len(segment) > LONG else None


PAIR = "row binary, k int, segment string"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def best_paths(size: np.ndarray, first: np.ndarray, edges: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their number for each segment of ``size`` characters, whose edges (end, start, id) are first[i]..first[i + 1].

    The recurrence runs by ends, for all segments at once; of equal sums the earliest start stays.
    """
    n, longest = len(size), int(size.max(initial=0))
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((edges, owner, edges >> END))                # by end, segment, start
    owner, edges = owner[order], edges[order]
    end, start, code = edges >> END, (edges >> START) & PLACE, edges & NO_PIECE
    sums = np.zeros((n, longest + 1), np.int64)
    taken = np.zeros((n, longest + 1), np.int64)                    # the edge that ends the best path to each place
    upto = np.searchsorted(end, np.arange(longest + 2))
    for e in range(1, longest + 1):
        some = slice(upto[e], upto[e + 1])
        who, total = owner[some], sums[owner[some], start[some] - 1] + score[code[some]]
        group = np.flatnonzero(np.diff(who, prepend=-1))
        most = np.maximum.reduceat(total, group)
        at = np.where(total == np.repeat(most, np.diff(group, append=len(who))), np.arange(len(who)), len(who))
        sums[who[group], e] = most
        taken[who[group], e] = upto[e] + np.minimum.reduceat(at, group)
    rows, ids, live, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(n), size.astype(np.int64)
    while len(live):
        edge = taken[live, place]
        rows.append(live)
        ids.append(np.where(code[edge] == NO_PIECE, -start[edge], code[edge]))
        place = start[edge] - 1
        live, place = live[place > 0], place[place > 0]
    row, flat = np.concatenate(rows[::-1]), np.concatenate(ids[::-1])
    return flat[np.argsort(row, kind="stable")].astype(np.int32), np.bincount(row, minlength=n)


def _folded(score):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, edges = np.asarray(b.column("size")), b.column("edges")
            ids, many = best_paths(size, np.concatenate([[0], np.cumsum(np.asarray(edges.value_lengths()))]), np.asarray(edges.flatten()), score.value)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("segment"), lists], ["segment", "ids"])
    return run


def lattice(segments: DataFrame, path: str) -> DataFrame:
    """Distinct (segment) -> (segment, ids): best paths; id -1 - p stands for the bytes of the character at p."""
    v = vocabulary(path)
    spark = segments.sparkSession
    pieces = F.broadcast(spark.createDataFrame([(p, i) for p, (i, _) in v.pieces.items()], "piece string, id long"))
    score = np.full(NO_PIECE + 1, v.unknown, np.int64)
    for i, s in v.pieces.values():
        score[i] = s
    size = F.length("segment")
    dealt = segments.select("segment").repartition(1 + segments.count() // TASK_SEGMENTS, "segment")    # the grouping below needs no other exchange
    edges = (dealt.select("segment", F.explode(F.sequence(F.lit(1), size)).alias("s"))
             .select("segment", "s", F.explode(F.sequence("s", F.least(F.col("s") + (v.longest - 1), size))).alias("e"))
             .select("segment", "s", "e", F.expr("substring(segment, s, e - s + 1)").alias("piece"))
             .join(pieces, "piece", "left").where("id is not null or s = e")
             .select("segment", F.expr(f"e * {1 << END}L + s * {1 << START}L + coalesce(id, {NO_PIECE}L)").alias("edge")))
    grouped = edges.groupBy("segment").agg(F.collect_list("edge").alias("edges"))                   # at most LONG * longest edges each
    return (grouped.select("segment", size.alias("size"), "edges")
            .mapInArrow(handing_back(_folded(spark.sparkContext.broadcast(score))), "segment string, ids array<int>"))


def _own(k: Cut, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments that a lattice row solves: (text, distinct segment) in order of text and first place, and each such place's pair."""
    size = (k.end - k.start)[k.rep]
    at = np.flatnonzero(((entry < 0) & (size > 1) & (size <= LONG))[k.which])
    text = np.repeat(np.arange(len(k.first) - 1), np.diff(k.first))
    pair, keys = pd.factorize(text[at] * len(k.rep) + k.which[at])
    return keys // max(1, len(k.rep)), keys % max(1, len(k.rep)), at, pair


def _rest(path: str, head):
    """Distinct segments of each text that are neither at hand nor solved in place, numbered by first place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(path), head.value if head else NO_HEAD
        for b in batches:
            for i, buf, off in text_parts(b.column("text"), 1 << 18):
                k = v.cut(buf, off)
                text, which, _, _ = _own(k, known.find(k))
                words = {j: k.text(k.rep[j]) for j in np.unique(which).tolist()}
                number = np.arange(len(text)) - np.searchsorted(text, text)
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(text + i)), pa.array(number.astype(np.int32)),
                                                  pa.array([words[j] for j in which.tolist()], pa.string())], ["row", "k", "segment"])
    return run


def _encoder(path: str, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(path), head.value
        for b in batches:
            for i, buf, off in text_parts(b.column("text"), 1 << 18):
                n = len(off) - 1
                k = v.cut(buf, off)
                entry = known.find(k)
                _, which, at, pair = _own(k, entry)
                sizes, ids = (np.asarray(b.column(c).slice(i, n).flatten()) for c in ("sizes", "ids"))
                if len(sizes) != len(which):
                    raise ValueError("paths and segments of a text do not agree")
                base, size = np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
                base[entry >= 0], size[entry >= 0] = known.base[entry[entry >= 0]], known.size[entry[entry >= 0]]
                extra: list[int] = []

                def put(found: list[int]) -> tuple[int, int]:
                    extra.extend(found)
                    return len(known.ids) + len(ids) + len(extra) - len(found), len(found)  # noqa: B023

                solved = np.zeros(len(entry), bool)
                solved[which] = True
                for j in np.flatnonzero((entry < 0) & ~solved).tolist():
                    base[j], size[j] = put(v.own(k.text(k.rep[j])))
                base, size = base[k.which], size[k.which]
                many = sizes.astype(np.int64)
                start = np.cumsum(many) - many
                own_base = start + len(known.ids)
                for p in np.unique(np.repeat(np.arange(len(many)), many)[ids < 0]).tolist():
                    own_base[p], many[p] = put(v.spelled(k.text(k.rep[which[p]]), ids[start[p]:start[p] + sizes[p]].tolist()))
                base[at], size[at] = own_base[pair], many[pair]
                flat = np.concatenate([known.ids, ids.astype(np.int32), np.array(extra, np.int32)])
                upto = np.concatenate([[0], np.cumsum(size)])
                out = flat[np.repeat(base - upto[:-1], size) + np.arange(upto[-1])]
                lists = pa.ListArray.from_arrays(pa.array(upto[k.first].astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), lists], ["doc_id", "ids"])
    return run


def head_segments(rows: DataFrame, path: str, most: int = HEAD, sample: int = SAMPLE_DOCS) -> Head:
    """Frequent segments of a bounded sample with their ids: at most ``most`` entries of at most LONG characters."""
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.select("row", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    counts = materialize(some.mapInArrow(handing_back(_rest(path, None)), PAIR).groupBy("segment").agg(F.count("*").alias("c")), "counts")
    left, least = most, None
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():   # one row per distinct count of the sample
        if r.n > left or r.c < 2:
            break
        left, least = left - r.n, r.c
    if least is None:
        drop_table(counts)
        return NO_HEAD
    paths = materialize(lattice(counts.where(F.col("c") >= least).select("segment"), path), "head")
    solved = paths.toArrow()                                                       # at most ``most`` rows
    for t in (counts, paths):
        drop_table(t)
    words, lists = solved.column("segment").to_pylist(), solved.column("ids").combine_chunks()
    sizes, ids = np.diff(np.asarray(lists.offsets)), np.asarray(lists.values).copy()
    start = np.cumsum(sizes) - sizes
    plain = np.ones(len(words), bool)
    plain[np.repeat(np.arange(len(words)), sizes)[ids < 0]] = False                # with byte fallback: left to the tail
    raw, byte = spelling(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    h1, h2 = hashes(raw, byte[end - size], byte[end])
    order = np.argsort(h1)
    order = order[plain[order]]
    return Head(h1[order], h2[order], start[order].astype(np.int64), sizes[order].astype(np.int64), ids.astype(np.int32))


def _solved(docs: DataFrame, path: str, id_col: str, text_col: str):
    """Rows with the paths of their own segments, and the frequent ones for all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16))
    head = docs.sparkSession.sparkContext.broadcast(head_segments(rows, path))
    rest = materialize(rows.select("row", "text").mapInArrow(handing_back(_rest(path, head)), PAIR), "rest")
    words = materialize(rest.select("segment").distinct(), "words")
    solved = materialize(lattice(words, path), "solved")
    # a set, so that repeated texts do not add up
    own = (rest.join(solved, "segment").groupBy(F.col("row").alias("r")).agg(F.sort_array(F.collect_set(F.struct("k", "ids"))).alias("own"))
           .select("r", F.transform("own", lambda x: F.size(x.ids)).alias("sizes"), F.flatten("own.ids").alias("ids")))
    own = materialize(own, "own")
    for t in (rest, words, solved):
        drop_table(t)
    return rows.join(own, F.col("row") == F.col("r"), "left").select("doc_id", "text", "sizes", "ids"), head


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row."""
    rows, head = _solved(docs, path, id_col, text_col)
    return rows.mapInArrow(handing_back(_encoder(path, head)), "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests(encode(docs))`` in one Python worker a task instead of two."""
    rows, head = _solved(docs, path, id_col, text_col)
    encoder, digest = _encoder(path, head), _digest(path)
    return rows.mapInArrow(handing_back(lambda batches: digest(encoder(batches))), DIGESTS)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = vocabulary(path).raw
        for b in batches:
            texts = []
            for ids in b.column("ids"):
                t = b"".join(raw[i] for i in ids.values.to_pylist()) if ids.is_valid else b""
                texts.append(t.decode("utf-8", "replace").replace(SPACE_MARK, " ")[1:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, text string")


DIGESTS = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string"


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib
        raw = vocabulary(path).raw
        for b in batches:
            off, flat = np.asarray(b.column("ids").offsets), np.asarray(b.column("ids").values)
            crc, sha = [], []
            for x, y in zip(off[:-1], off[1:]):
                part = flat[x:y]
                crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                text = b"".join(map(raw.__getitem__, part.tolist())).replace(SPACE_MARK.encode(), b" ")[1:]
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])
    return run


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and the SHA-256 of the decoded text."""
    return encoded.mapInArrow(_digest(path), DIGESTS)
