"""Folder listing and text ingest.

The folder comes from a Data Source whose partitions are pages of the listing,
with names that Spark's own file sources skip (hidden and empty files);
extension routing is a Column; each page's files are read and parsed once, into
rows that are written to the checkpoint folder and assembled per file by
DataFrame code.  Every failure
becomes an ``error`` row instead of a crash.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import SUPPORTED_EXTENSIONS
from ..functions.text import extension_with_dot, fold
from ..session import ship_package, written
from .listing import listing
from .storage import open_fs

MAX_FILE_BYTES = 1 << 30       # larger files become error rows: a row cannot hold their text


def is_supported(name: Column) -> Column:
    return F.lower(extension_with_dot(name)).isin(SUPPORTED_EXTENSIONS)


def is_unsupported(name: Column) -> Column:
    ext = F.lower(extension_with_dot(name))
    return (ext != "") & ~ext.isin(SUPPORTED_EXTENSIONS)


def classify_names(names: DataFrame, name_col: str = "name") -> DataFrame:
    """A1/A2 on a table of file names: status supported / unsupported / ignored."""
    n = F.col(name_col)
    return names.withColumn("ext", F.lower(extension_with_dot(n))).withColumn(
        "status", F.when(is_supported(n), F.lit("supported")).when(is_unsupported(n), F.lit("unsupported"))
        .otherwise(F.lit("ignored"))).withColumn("sort_key", fold(n))


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, ext, status, sort_key) of the files directly in ``folder``, a page of the listing to a partition."""
    return classify_names(listing(spark, folder))


def collect_files(spark: SparkSession, folder: str) -> DataFrame:
    """A1: supported files, ordered by case-folded name."""
    return list_folder(spark, folder).where(F.col("status") == "supported").orderBy("sort_key", "name")


def collect_unsupported_files(spark: SparkSession, folder: str) -> DataFrame:
    """A2: files with an extension outside the supported set."""
    return list_folder(spark, folder).where(F.col("status") == "unsupported").orderBy("sort_key", "name")


# ---------------------------------------------------------------------------
# decoding (A4) and format dispatch
# ---------------------------------------------------------------------------

BYTE_ORDER_MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
CP1252_UNDEFINED = frozenset(b"\x81\x8d\x8f\x90\x9d")


def _decodes(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def encoding_of(raw: bytes) -> str:
    """A byte order mark decides, then validity as UTF-8; the rest is cp1252 unless it has bytes undefined there."""
    for mark, encoding in BYTE_ORDER_MARKS.items():
        if raw.startswith(mark):
            return encoding
    if _decodes(raw, "utf-8"):
        return "utf-8"
    if CP1252_UNDEFINED.isdisjoint(raw):
        return "cp1252"
    return "utf-16" if _decodes(raw, "utf-16") else "latin-1"


def decode_bytes(raw: bytes) -> str:
    """Text of a file; line ends become \\n as in text-mode reading."""
    return raw.decode(encoding_of(raw)).replace("\r\n", "\n").replace("\r", "\n")


ROWS = ("file string, ext string, kind string, sheet_idx int, sheet string, seq int, cells array<string>, text string, "
        "part struct<section:int,depth:int,tbl:int,row:int,cell:int,up_tbl:int,up_row:int,up_cell:int>, error string")
ROW_TYPES = {"file": pa.string(), "ext": pa.string(), "kind": pa.string(), "sheet_idx": pa.int32(), "sheet": pa.string(), "seq": pa.int32(),
             "cells": pa.list_(pa.string()), "text": pa.string(),
             "part": pa.struct([(c, pa.int32()) for c in ("section", "depth", "tbl", "row", "cell", "up_tbl", "up_row", "up_cell")]), "error": pa.string()}
BATCH_ROWS, BATCH_CHARS = 10_000, 8 << 20


def _file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    from spanmask.sources.formats import read_rows
    for b in batches:
        for path, name, ext, length, content in zip(*(b.column(c) for c in ("path", "name", "ext", "length", "content"))):
            path, name, ext, length, content = path.as_py(), name.as_py(), ext.as_py(), length.as_py(), content.as_py()
            try:
                if length is not None and length > MAX_FILE_BYTES:
                    raise ValueError(f"{length} bytes; at most {MAX_FILE_BYTES} can be read")
                if content is None:
                    system, place = open_fs(path)
                    with system.open_input_stream(place) as f:
                        content = f.read()
                out = [(name, ext, "file", 0, "", 0, [], None, None, None)]
                out += [(name, ext, *row, None) for row in read_rows(content, ext)]
            except Exception as exc:  # noqa: BLE001 - per-file error capture
                out = [(name, ext, "error", 0, "", 0, [], None, None, f"{name}: {exc}")]
            yield from out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the files; small files share a batch, and a batch is closed at a number of rows or characters."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), ROW_TYPES.values())], list(ROW_TYPES))

    for row in _file_rows(batches):
        held.append(row)
        size += len(row[7] or "") + sum(map(len, row[6]))
        if len(held) == BATCH_ROWS or size > BATCH_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A3: supported files of ``folder`` -> (documents(doc_id, file, text), errors(file, message)).

    The files of a page of the listing are read where the page is, so tasks follow bytes.
    """
    files = list_folder(spark, folder).where(F.col("status") == "supported")
    return documents_from_files(files.select("path", "name", "ext", "length", F.lit(None).cast("binary").alias("content")))


def documents_from_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, name, ext, length, content) rows of supported files -> (documents, errors).

    A null ``content`` is read from ``path``.  Each file is parsed once; an
    exception becomes an error row ``"{name}: {message}"`` (A11), and a file
    without any text still is a document.
    """
    from ..operators.tabular import assemble_lines, assemble_parts, assemble_sheets, render_delimited_rows, render_sheet_rows

    ship_package(files.sparkSession)
    if "length" not in files.columns:
        files = files.withColumn("length", F.octet_length("content").cast("long"))
    rows = written(files.select("path", "name", "ext", "length", "content").mapInArrow(_parsed, ROWS), "file_rows")
    texts = rows.where(F.col("kind") == "text").select("file", "text")
    cells = rows.where(F.col("kind") == "cells").select("file", "ext", "sheet_idx", "sheet",
                                                          F.col("seq").alias("row_number"), "cells")
    sheets = assemble_sheets(render_sheet_rows(cells.where(F.col("ext") == ".xlsx")))
    delim = assemble_lines(render_delimited_rows(cells.where(F.col("ext") != ".xlsx")))
    parts = assemble_parts(rows.where(F.col("kind") == "part").select("file", "part.*", "seq", "text"))
    found = texts.unionByName(sheets).unionByName(delim).unionByName(parts)
    docs = rows.where(F.col("kind") == "file").select("file").join(found, "file", "left") \
        .select(F.xxhash64("file").alias("doc_id"), "file", F.coalesce("text", F.lit("")).alias("text"))
    errors = rows.where(F.col("kind") == "error").select("file", F.col("error").alias("message"))
    return docs, errors
