"""Texts of any size as rows of bounded size.

A plain text file is read by byte ranges, each by a task of its own.  A first
pass over the ranges gathers what decides the encoding (byte order mark,
validity as UTF-8 and UTF-16, bytes undefined in cp1252), a second decodes
them.  Ranges are cut between characters, and never inside a CR LF.

Parts end at seams: places that no match of a rule can pass, so scanning part
by part finds what scanning the whole text finds.  What stands before the first
seam of a range belongs to the part before it; a range without a seam is all
of that kind.  ``at`` is the part's first character in the whole text.

Cases: an empty file is one empty part; a file that cannot be decoded, or
whose stretch without a seam does not fit a row, is an error row; files of
other formats are one part each, as ``read_documents`` gives them.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package, written
from .files import BYTE_ORDER_MARKS, CP1252_UNDEFINED, documents_from_files, list_folder
from .storage import open_fs

PART_BYTES = 32 << 20
TEXT_EXTENSION = ".txt"
#: Places that no rule's match can pass: behind a separator that no rule takes in; behind a line that ends in a character
#: after which no rule goes on; between two lines if the first has a sign, then no digit, and ends in nothing that a rule
#: carries over (a label, its separator, IVA, IT), while the next one begins with a letter (but not IVA) or a number.
SEAM = (r"""[;|]|[!?,()\[\]"»]\s*\n|(?<!P)\.\s*\n"""
        r"""|[^\w\s][^\d\n]*(?<=[^\s:=\-])(?<!business)(?<!ragione)\n(?:(?![iİı])(?=[^\W\d_])|(?<![at]\n)(?=[\d+]))""")
#: Characters of one stretch without a seam; a row cannot hold more.
MAX_STRETCH = 1 << 29

#: Bytes and files that make up a task's work, unless a part is larger.
TASK_BYTES, TASK_FILES = 4 << 20, 4000

FACTS = "path string, part long, mark string, utf8 boolean, cp1252 boolean, utf16 boolean"
SEGMENTS = "path string, part long, head string, tail string, error string"


def _valid(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _first(raw: bytes, encoding: str) -> int:
    """Bytes at the beginning that belong to the character before (0 if the bytes are not of this encoding)."""
    if encoding.startswith("utf-8"):
        n = 0
        while n < 3 and n < len(raw) and raw[n] & 0xC0 == 0x80:
            n += 1
        return n
    if encoding.startswith("utf-16") and len(raw) > 1:
        return 2 if raw[0 if encoding.endswith("be") else 1] & 0xFC == 0xDC else 0
    return 0


def _range(path: str, start: int, size: int) -> tuple[bytes, bytes, bytes]:
    """(four bytes before, the range, four bytes behind)."""
    system, place = open_fs(path)
    with system.open_input_file(place) as f:
        before = f.read_at(min(4, start), max(0, start - 4))
        raw = f.read_at(size + 4, start)
    return before, raw[:size], raw[size:]


def _segment(raw: bytes, behind: bytes, part: int, encoding: str) -> bytes:
    """The range's own whole characters."""
    return raw[_first(raw, encoding) if part else 0:] + behind[:_first(behind, encoding)]


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (the last value is their size in bytes) as batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r[:-1])
        size += r[-1]
        if size > 8 << 20 or len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], list(kinds))


def _facts(size: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, part in zip(b.column("path").to_pylist(), b.column("part").to_pylist()):
                _, raw, behind = _range(path, part * size, size)
                mark = next((e for m, e in BYTE_ORDER_MARKS.items() if part == 0 and raw.startswith(m)), None)
                if mark == "utf-16":
                    mark = "utf-16-le" if raw[0] == 0xFF else "utf-16-be"
                utf8, utf16 = (_valid(_segment(raw, behind, part, e), e) for e in ("utf-8", "utf-16-le"))
                yield path, part, mark, utf8, CP1252_UNDEFINED.isdisjoint(raw), utf16, 0

    kinds = {"path": pa.string(), "part": pa.int64(), "mark": pa.string(), "utf8": pa.bool_(), "cp1252": pa.bool_(), "utf16": pa.bool_()}
    return lambda batches: _batches(facts(batches), kinds)


def _segments(size: int, seam: str):
    cut = re.compile(seam, re.IGNORECASE)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, part, encoding in zip(*(b.column(c).to_pylist() for c in ("path", "part", "encoding"))):
                before, raw, behind = _range(path, part * size, size)
                try:
                    text = _segment(raw, behind, part, encoding).decode(encoding)
                except UnicodeDecodeError as e:
                    yield path, part, None, None, str(e), 0
                    continue
                if part == 0:
                    text = text.removeprefix("\ufeff") if encoding.startswith("utf") and encoding != "utf-8" else text
                elif text.startswith("\n") and before.decode(encoding, "ignore").endswith("\r"):
                    text = text[1:]
                text = text.replace("\r\n", "\n").replace("\r", "\n")
                m = cut.search(text) if part else None
                head, tail = ("", text) if part == 0 else (text[:m.end()], text[m.end():]) if m else (text, None)
                yield path, part, head, tail, None, len(raw)

    kinds = {"path": pa.string(), "part": pa.int64(), "head": pa.string(), "tail": pa.string(), "error": pa.string()}
    return lambda batches: _batches(segments(batches), kinds)


def text_parts(spark: SparkSession, files: DataFrame, part_bytes: int = PART_BYTES, seam: str = SEAM) -> tuple[DataFrame, DataFrame]:
    """(path, name, length) of text files -> (parts(doc_id, file, part, at, text), errors(file, message))."""
    if part_bytes < 4 or part_bytes % 2:
        raise ValueError("a part has an even number of bytes, four or more")
    ship_package(spark)
    files = written(files.select("path", "name", "length"), "files")
    last = F.greatest(F.floor((F.col("length") - 1) / part_bytes), F.lit(0))
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    # a range's row is small, its work is not: tasks follow the bytes of the files, and small files go together
    work = files.agg(F.sum("length").alias("size"), F.count(F.lit(1)).alias("n")).first()
    tasks = 1 + (work.size or 0) // max(part_bytes, TASK_BYTES) + work.n // TASK_FILES
    ranges = ranges.repartition(tasks)
    facts = ranges.mapInArrow(_facts(part_bytes), FACTS).groupBy("path").agg(
        F.max("mark").alias("mark"), F.every("utf8").alias("utf8"), F.every("cp1252").alias("cp1252"), F.every("utf16").alias("utf16"))
    even = F.col("length") % 2 == 0
    encoding = (F.when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("utf8"), F.lit("utf-8")).when(F.col("cp1252"), F.lit("cp1252"))
                .when(F.col("utf16") & even, F.lit("utf-16-le")).otherwise(F.lit("latin-1")))
    known = written(facts.join(files, "path").select("path", "name", encoding.alias("encoding")), "encodings")
    cut = written(ranges.join(known, "path").repartition(tasks).mapInArrow(_segments(part_bytes, seam), SEGMENTS), "segments")
    bad = cut.where("error is not null").groupBy("path").agg(F.min_by("error", "part").alias("error"))
    # small rows from here on: which part takes a range's head, and where parts begin
    by_part = Window.partitionBy("path").orderBy("part")
    meta = cut.select("path", "part", F.length("head").alias("n_head"), F.length("tail").alias("n_tail")) \
        .withColumn("owner", F.last(F.when(F.col("n_tail").isNotNull(), F.col("part")), ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = meta.select("path", F.explode(F.array(F.struct(F.col("owner").alias("part"), F.col("n_head").alias("n")),
                                                  F.struct(F.col("part"), F.col("n_tail").alias("n")))).alias("x")) \
        .where("x.part is not null and x.n is not null").groupBy("path", "x.part").agg(F.sum("x.n").alias("n"))
    too_long = sizes.where(F.col("n") > MAX_STRETCH).groupBy("path").agg(F.max("n").alias("n"))
    bad = bad.unionByName(too_long.select("path", F.concat(F.col("n").cast("string"), F.lit(" characters without a place to cut")).alias("error"))) \
        .groupBy("path").agg(F.min("error").alias("error"))
    starts = sizes.withColumn("at", F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("path", "part", "at")
    pieces = cut.join(bad, "path", "left_anti").join(meta.select("path", "part", "owner"), ["path", "part"]) \
        .select("path", F.explode(F.array(F.struct(F.col("owner").alias("part"), (2 * F.col("part")).alias("k"), F.col("head").alias("text")),
                                          F.struct(F.col("part"), (2 * F.col("part") + 1).alias("k"), F.col("tail").alias("text")))).alias("x")) \
        .where("x.part is not null and x.text is not null").select("path", "x.*")
    whole = pieces.groupBy("path", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
    parts = whole.join(starts, ["path", "part"]).join(known, "path") \
        .select(F.xxhash64("name").alias("doc_id"), F.col("name").alias("file"), "part", "at", "text")
    errors = bad.join(known, "path").select(F.col("name").alias("file"), F.concat_ws(": ", "name", "error").alias("message"))
    return parts, errors


def read_parts(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES, seam: str = SEAM) -> tuple[DataFrame, DataFrame]:
    """All supported files of ``folder`` -> (parts(doc_id, file, part, at, text), errors(file, message))."""
    files = written(list_folder(spark, folder).where(F.col("status") == "supported"), "listed")     # walked once, read twice
    plain = F.col("ext") == TEXT_EXTENSION
    parts, errors = text_parts(spark, files.where(plain), part_bytes, seam)
    docs, failed = documents_from_files(files.where(~plain).select("path", "name", "ext", "length", F.lit(None).cast("binary").alias("content")))
    zero = F.lit(0).cast("long")
    return (parts.unionByName(docs.select("doc_id", "file", zero.alias("part"), zero.alias("at"), "text")), errors.unionByName(failed))
