"""Removal of repeated passages with a logarithmic family of suffix arrays.

Suffixes are sampled: every window of ``length`` bytes names the start of its
least ``SEED``-byte hash (leftmost on ties), so equal windows name equal places
inside them.  The windows of a text that name one place form a record; an array
holds, sorted by the hash at the named place, one entry for each distinct
record with its first place in the corpus.

Documents arrive in batches in ascending doc_id.  A batch's records are sorted
and merge-scanned against the arrays of all existing levels in one pass over
rows in order: the first row of equal records is their first place, every later
one is a long match and goes whole, and first rows from the batch are new
entries.  Levels of equal rank are taken up by that same pass, so their merge
costs no other one; there are at most log2(batches) levels, and an entry is
rewritten that often.  Equal records of one task are reduced to the first
before anything is shuffled.

Entries that share the hash at the named place but differ as records overlap in
part.  Only these are opened: equal windows always name equal places, so the
windows of a few entries with one key are compared side by side, and those of a
key with more than ``GROUP`` entries are dealt out by their fingerprints, which
splits a passage that a third of all documents share: first in blocks of
``BLOCK`` windows, cut at the same places relative to the named one.  Equal
windows lie in blocks of equal cores, the bytes that all windows of a block
hold, so only blocks whose core stands in different blocks too are taken window
by window.  Every other place follows from first places.

Equality of records rests on 128 bits of hash, that of windows too.

Cases: null and empty texts have no bytes and nothing is removed; texts shorter
than ``length`` stay whole; rows that repeat a doc_id are documents of their own
in the order of their texts' SHA-256, those that repeat id and text are one
document, whose result each gets; a null doc_id stands before all others; an empty
table gives no rows; other columns are ignored whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import row_numbers
from .common import drop_table, materialize
from .hashing import U, mix, prefix_sums, span_hash, text_parts

SEED, GROUP, BLOCK = 32, 64, 8
ENTRY = "key long, rec long, doc long, pos long, n int"


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Places of the least values in all windows of ``width`` (leftmost on ties)."""
    m = (g & ~U(0xFFFFFFFF)) | np.arange(len(g), dtype=U)
    step = 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    m = np.minimum(m[:len(m) - rest], m[rest:]) if rest else m
    return (m & U(0xFFFFFFFF)).astype(np.int64)


def records(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, windows, key and record hash of each run of windows that name one place."""
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2
    sums = prefix_sums(buf, 3)
    starts = np.arange(len(buf) - SEED + 1)
    g = span_hash(sums, starts, starts + SEED)
    place = _least(g, length - SEED + 1)
    end = np.repeat(off[1:], np.diff(off))[:len(place)]
    whole = starts[:len(place)] + length <= end
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | new[1:]
    n = np.flatnonzero(stop) - first + 1
    rec = span_hash(prefix_sums(buf, 5), first, first + n - 1 + length) ^ mix((n * 1000 + place[first] - first).astype(U))
    return first, n, g[place[first]], rec


def _records(length: int):
    """Records of a batch of texts; ``again`` marks those that an earlier row of the batch equals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i, buf, off in text_parts(b.column("text")):
                first, n, key, rec = records(buf, off, length)
                d = np.searchsorted(off, first, "right") - 1
                parts.append((d + i, first - off[d], n, key, rec))
            row, pos, n, key, rec = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            doc = b.column("doc").take(pa.array(row))
            rank = np.argsort(np.argsort(np.asarray(b.column("doc").fill_null(-(1 << 63))), kind="stable"), kind="stable")[row]
            order = np.lexsort((pos, rank, rec, key))
            same = (key[order][1:] == key[order][:-1]) & (rec[order][1:] == rec[order][:-1])
            # rows that repeat a place are one place
            moved = (rank[order][1:] != rank[order][:-1]) | (pos[order][1:] != pos[order][:-1])
            again = np.zeros(len(row), bool)
            again[order[1:]] = same & moved
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(rec.view(np.int64)), doc, pa.array(pos), pa.array(n.astype(np.int32)), pa.array(again)],
                ["key", "rec", "doc", "pos", "n", "again"])
    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge scan of rows in the order (key, rec, old, doc, pos): first places and later ones.

    ``old`` rows come from levels: 0 from a level that stays, 1 from one that is
    taken up, 2 from the batch.  Out: entries of the new level and, as
    ``match``, places of the batch that an earlier one equals.
    """
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key, rec, old = (b.column(c).to_numpy() for c in ("key", "rec", "old"))
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (rec[1:] != rec[:-1])
        if last == (key[0], rec[0]):
            head[0] = False
        last = (key[-1], rec[-1])
        keep = np.where(head, old > 0, old == 2)
        out = b.append_column("match", pa.array(~head)).filter(pa.array(keep))
        yield out.select(["key", "rec", "doc", "pos", "n", "match"])


def _segments(length: int):
    """Bytes under the opened records: (key, doc, pos, n, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, docs, places, counts, parts = [], [], [], [], []
            for k, (text, runs) in enumerate(zip(b.column("text").to_pylist(), b.column("runs"))):
                raw = text.encode()
                f = runs.values
                for key, pos, n, many in zip(*(f.field(c).to_pylist() for c in ("key", "pos", "n", "many"))):
                    keys.append((key, many))
                    docs.append(k)
                    places.append(pos)
                    counts.append(n)
                    parts.append(raw[pos:pos + n - 1 + length])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int64()), pa.array([m for _, m in keys], pa.bool_()), b.column("doc").take(pa.array(docs, pa.int64())),
                 pa.array(places, pa.int64()), pa.array(counts, pa.int32()), pa.array(parts, pa.binary())], ["key", "many", "doc", "pos", "n", "bytes"])
    return run


def _window_hashes(b: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Row, place and both fingerprints of every window of the batch's segments."""
    n = b.column("n").to_numpy().astype(np.int64)
    size = n + length - 1
    buf = np.frombuffer(b"".join(b.column("bytes").to_pylist()), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + step
    h = [span_hash(prefix_sums(buf, s), start, start + length) for s in (7, 9)]
    return row, b.column("pos").to_numpy()[row] + step, *h


def _side_by_side(length: int):
    """Spans of windows that stand in an earlier segment with the same key; rows come in the order (key, doc, pos)."""
    def solve(b: pa.RecordBatch) -> pa.RecordBatch:
        row, pos, h1, h2 = _window_hashes(b, length)
        order = np.lexsort((pos, row, h2, h1))          # rows of one key ascend by document and place
        again = np.zeros(len(row), bool)
        x = order
        again[x[1:]] = (h1[x][1:] == h1[x][:-1]) & (h2[x][1:] == h2[x][:-1])
        row, pos = row[again], pos[again]
        return pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row)), pa.array(pos), pa.array(pos + length)], ["doc", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None               # the last key may go on in the next batch
        for b in batches:
            if held is not None:
                b = pa.concat_batches([held, b])
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            held = b.slice(cut)
            if cut:
                yield solve(b.slice(0, cut))
        if held is not None:
            yield solve(held)
    return run


PIECE, WINDOW = "doc long, pos long, n int, bytes binary, h1 long, h2 long", "doc long, pos long, n int, h1 long, h2 long"


def _hashes(raw: list[bytes]) -> list[pa.Array]:
    """Both fingerprints of each byte string."""
    end = np.cumsum([len(x) for x in raw]).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    return [pa.array(span_hash(prefix_sums(buf, s), end - [len(x) for x in raw], end).view(np.int64)) for s in (7, 9)] if raw else [pa.array([], pa.int64())] * 2


def _places(raw: list[bytes], key: np.ndarray, length: int) -> list[int]:
    """The place that each segment's windows name: the first with its key's hash."""
    buf = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    at = (np.cumsum(size) - size)[:, None] + np.arange(length - SEED + 1)
    return (span_hash(prefix_sums(buf, 3), at, at + SEED) == key.view(U)[:, None]).argmax(axis=1).tolist()


def _blocks(length: int):
    """Segments cut into blocks of at most ``BLOCK`` windows at places that depend on the named one alone, with two fingerprints of each block and one of its core."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                part = b.slice(i, 5000)
                row, pos, n, raw, core, turn = [], [], [], [], [], []
                texts = part.column("bytes").to_pylist()
                for k, (p, many, text, place) in enumerate(zip(part.column("pos").to_pylist(), part.column("n").to_pylist(), texts,
                                                               _places(texts, part.column("key").to_numpy(), length))):
                    at = 0
                    while at < many:
                        t = (place - at) // BLOCK                # windows from place - t * BLOCK - BLOCK + 1 to place - t * BLOCK
                        last = place - t * BLOCK
                        stop = min(many, last + 1)
                        row.append(k)
                        pos.append(p + at)
                        n.append(stop - at)
                        raw.append(text[at:stop - 1 + length])
                        core.append(text[last:last - BLOCK + 1 + length])
                        turn.append(t)
                        at = stop
                cores = mix(_hashes(core)[0].to_numpy().view(U) + np.array(turn, U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(row, pa.int64())), pa.array(pos, pa.int64()), pa.array(n, pa.int32()),
                                                  pa.array(raw, pa.binary()), *_hashes(raw), pa.array(cores)], ["doc", "pos", "n", "bytes", "h1", "h2", "core"])
    return run


def _windows(length: int):
    """The blocks' windows with two fingerprints of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                part = b.slice(i, 5000)
                row, pos, h1, h2 = _window_hashes(part, length)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(row)), pa.array(pos), pa.array(np.ones(len(row), np.int32)),
                                                  pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc", "pos", "n", "h1", "h2"])
    return run


def _later_and_first(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans (doc, a, b) of pieces that an earlier piece equals, and the pieces that are first of their kind."""
    twice = materialize(pieces.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("c"))
                        .where("c > 1").select("h1", "h2", "first"), "twice")
    is_first = (F.col("first.pos") == F.col("pos")) & F.col("first.doc").eqNullSafe(F.col("doc"))
    spans = pieces.join(twice, ["h1", "h2"]).where(~is_first).select("doc", F.col("pos").alias("a"), (F.col("pos") + F.col("n") - 1 + length).alias("b"))
    return spans, pieces.join(twice, ["h1", "h2"], "left").where(F.col("first").isNull() | is_first).select(*pieces.columns)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and digests of what is left, with the removed runs."""
    for b in batches:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans")):
            raw = (text or "").encode()
            s = np.zeros((0, 2), np.int64) if spans.as_py() is None else np.stack(
                [np.asarray(spans.values.field("a")), np.asarray(spans.values.field("b"))], axis=1)
            s = s[np.argsort(s[:, 0], kind="stable")]
            reach = np.maximum.accumulate(s[:, 1]) if len(s) else s[:, 1]
            new = np.ones(len(s), bool)
            new[1:] = s[1:, 0] > reach[:-1]
            a = s[new, 0]
            e = reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] if len(s) else a
            kept, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), e.tolist()):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            out.append((len(raw), int((e - a).sum()), len(a), kept.hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), e.tolist())]))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
             pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


class SuffixIndex:
    """Levels of sorted suffix arrays; :meth:`add` scans a batch against them and takes it in."""

    def __init__(self, length: int = 100):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []       # (rank, entries in the order key, rec)

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in a batch (doc, text) of documents after all earlier ones; its spans (doc, a, b) that match as whole records."""
        recs = materialize(docs.mapInArrow(_records(self.length), ENTRY + ", again boolean"), "records")
        rank, taken = 0, []
        while self.levels and self.levels[-1][0] == rank:
            taken.append(self.levels.pop()[1])
            rank += 1
        rows = recs.where("not again").drop("again").withColumn("old", F.lit(2))
        for t in taken:
            rows = rows.unionByName(t.withColumn("old", F.lit(1)))
        for _, t in self.levels:                             # only their records are looked at
            rows = rows.unionByName(t.select("key", "rec", *[F.lit(None).cast(k).alias(c) for c, k in (("doc", "long"), ("pos", "long"), ("n", "int"))],
                                             F.lit(0).alias("old")))
        ordered = rows.repartition("key", "rec").sortWithinPartitions("key", "rec", "old", "doc", "pos")
        scanned = materialize(ordered.mapInArrow(_scan, ENTRY + ", match boolean"), "level")
        self.levels.append((rank, scanned.where("not match").drop("match")))
        end = (F.col("pos") + F.col("n") - 1 + self.length).alias("b")
        spans = materialize(recs.where("again").unionByName(scanned.where("match").withColumnRenamed("match", "again"))
                            .select("doc", F.col("pos").alias("a"), end), "spans")
        for t in (recs, *taken):
            drop_table(t)
        docs.sparkSession.sparkContext._jvm.System.gc()      # shuffle files of the batch go with their plans
        return spans

    def opened(self) -> DataFrame:
        """Entries that share a key with another one: (key, doc, pos, n, many)."""
        entries = self.levels[0][1]
        for _, x in self.levels[1:]:
            entries = entries.unionByName(x)
        mixed = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", (F.col("c") > GROUP).alias("many")), "mixed")
        return entries.join(mixed, "key").select("key", "doc", "pos", "n", "many")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, batches: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (runs of bytes).

    ``batches`` is the number of arrivals into which the table is dealt by doc_id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if rows.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return _removed(rows, length, batches)
    keyed = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = [(F.col("doc").isNotNull(), True), (F.col("doc"), True), (F.col("digest"), True)]
    numbers = materialize(row_numbers(keyed.select("doc", "digest").distinct(), order, "no"), "numbers").toDF("d", "g", "no")
    numbered = materialize(keyed.join(numbers, F.col("doc").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select("doc", "no", "text"), "numbered")
    result = _removed(materialize(numbered.groupBy("no").agg(F.min("text").alias("text")), "texts").toDF("doc", "text"), length, batches)
    names = [F.col("doc").alias("doc_id"), *result.columns[1:]]
    return numbered.select("doc", "no").join(result.withColumnRenamed("doc_id", "d"), F.col("no") == F.col("d")).select(*names)


def _removed(rows: DataFrame, length: int, batches: int) -> DataFrame:
    """The same for (doc, text) of distinct ids."""
    cuts = sorted(set(rows.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.001))) if batches > 1 else []
    bounds = [None, *cuts, None]
    index, found = SuffixIndex(length), []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = rows.where(F.octet_length("text") >= length)
        if lo is not None:
            part = part.where(F.col("doc") > int(lo))
        if hi is not None:
            part = part.where((F.col("doc") <= int(hi)) | (F.col("doc").isNull() if lo is None else F.lit(False)))
        found.append(index.add(part))
    todo = index.opened().groupBy("doc").agg(F.collect_list(F.struct("key", "pos", "n", "many")).alias("runs"))
    todo = materialize(todo, "todo").withColumnRenamed("doc", "d")
    for _, level in index.levels:
        drop_table(level)
    rows.sparkSession.sparkContext._jvm.System.gc()
    same = F.col("doc").eqNullSafe(F.col("d"))
    segments = materialize(rows.join(todo, same).select("doc", "text", "runs")
                           .mapInArrow(_segments(length), "key long, many boolean, doc long, pos long, n int, bytes binary"), "segments")
    rows.sparkSession.sparkContext._jvm.System.gc()
    found.append(segments.where("not many").repartition("key").sortWithinPartitions("key", "doc", "pos")
                 .mapInArrow(_side_by_side(length), "doc long, a long, b long"))
    blocks = materialize(segments.where("many").mapInArrow(_blocks(length), PIECE + ", core long"), "blocks")
    later, first = _later_and_first(blocks, length)
    ends = [f(h).alias(f"{k}{h}") for h in ("h1", "h2") for f, k in ((F.min, "lo"), (F.max, "hi"))]
    shared = materialize(blocks.groupBy("core").agg(*ends).where("loh1 != hih1 or loh2 != hih2").select("core"), "cores")
    windows = materialize(first.join(shared, "core", "left_semi").mapInArrow(_windows(length), WINDOW), "windows")
    found += [later, _later_and_first(windows, length)[0]]
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)
    spans = materialize(spans.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("a", "b")).alias("spans")), "found")
    return rows.join(spans, same, "left").select(F.col("doc").alias("doc_id"), "text", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
