"""Tabular rendering (B1-B7): cell rows -> header-contextualised text lines.

Input is a cells table ``(file, sheet_idx, sheet, row_number, cells)`` as
produced by the XLSX/CSV/TSV ingest (one row per sheet row).  Everything
below is Column/array code; the header of a sheet is found with an
aggregation (``min_by`` with map-side combine) and joined back, so a sheet
with very many rows is never gathered into one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import CONTEXT_HEADER_RE
from ..functions.text import py_strip


def format_cell_value(c: Column, dtype: T.DataType | None = None) -> Column:
    """B1: None -> '', booleans -> YES/NO, anything else -> trimmed string."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit("")).when(c, F.lit("YES")).otherwise(F.lit("NO"))
    return F.when(c.isNull(), F.lit("")).otherwise(py_strip(c.cast("string")))


def trim_cells(cells: Column) -> Column:
    """B2: drop trailing empty cells."""
    last = F.array_max(F.transform(cells, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0))))
    return F.when(F.coalesce(last, F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.slice(cells, 1, F.coalesce(last, F.lit(0))))


def has_content(cells: Column) -> Column:
    return F.exists(cells, lambda x: x != "")


def looks_like_header(cells: Column) -> Column:
    """At least two filled cells, and enough of them contain an ASCII letter."""
    filled = F.filter(cells, lambda x: x != "")
    textish = F.size(F.filter(filled, lambda x: x.rlike("[A-Za-z]")))
    return (F.size(filled) >= 2) & (textish >= F.greatest(F.lit(2), F.floor(F.size(filled) / 2)))


def is_context_header(h: Column) -> Column:
    """B5."""
    return h.rlike(CONTEXT_HEADER_RE)


def render_row(cells: Column, headers: Column, row_number: Column) -> Column:
    """Plain ``' | '`` join without headers; else ``Row n: Header: value | ...``."""
    def part(x, i):
        h = F.when(i < F.size(headers), F.element_at(headers, i + 1)).otherwise(F.lit(""))
        return F.when(x == "", F.lit(None)).when((h != "") & is_context_header(h), F.concat(h, F.lit(": "), x)) \
            .otherwise(x)

    parts = F.filter(F.transform(cells, part), lambda p: p.isNotNull())
    with_headers = F.when(F.size(parts) == 0, F.lit("")).otherwise(
        F.concat(F.lit("Row "), row_number.cast("string"), F.lit(": "), F.array_join(parts, " | ")))
    return F.when(headers.isNull(), F.array_join(cells, " | ")).otherwise(with_headers)


def sheet_headers(rows: DataFrame) -> DataFrame:
    """First qualifying header row of every sheet (``rows`` already trimmed)."""
    h = rows.where(F.col("is_header")).groupBy("file", "sheet_idx").agg(
        F.min_by(F.struct("row_number", "cells"), F.col("row_number")).alias("h"))
    return h.select("file", "sheet_idx", F.col("h.row_number").alias("header_row"), F.col("h.cells").alias("headers"))


def render_sheet_rows(cells: DataFrame) -> DataFrame:
    """XLSX rows: (file, sheet_idx, sheet, row_number, line); dropped rows are absent."""
    rows = cells.select("file", "sheet_idx", "sheet", "row_number", trim_cells(F.col("cells")).alias("cells")) \
        .where(has_content(F.col("cells"))).withColumn("is_header", looks_like_header(F.col("cells")))
    heads = sheet_headers(rows)
    j = rows.join(heads, ["file", "sheet_idx"], "left")
    before = F.col("header_row").isNull() | (F.col("row_number") < F.col("header_row"))
    line = (F.when(F.col("row_number") == F.col("header_row"), F.array_join(F.col("cells"), " | "))
            .when(before, render_row(F.col("cells"), F.lit(None).cast("array<string>"), F.col("row_number")))
            .otherwise(render_row(F.col("cells"), F.col("headers"), F.col("row_number"))))
    return j.select("file", "sheet_idx", "sheet", "row_number", line.alias("line")).where(F.col("line") != "")


def render_delimited_rows(cells: DataFrame) -> DataFrame:
    """CSV/TSV rows: header only from physical row 1 (untrimmed); numbering from the file."""
    first = cells.where(F.col("row_number") == 1).select(
        "file", F.col("cells").alias("headers"), looks_like_header(F.col("cells")).alias("has_header"))
    j = cells.join(first, "file", "left").withColumn("has_header", F.coalesce("has_header", F.lit(False)))
    header_line = j.where(F.col("has_header") & (F.col("row_number") == 1)).select(
        "file", "row_number", F.array_join(F.col("headers"), " | ").alias("line"))
    data = j.where(~(F.col("has_header") & (F.col("row_number") == 1))) \
        .withColumn("cells", trim_cells(F.col("cells"))).where(has_content(F.col("cells")))
    line = render_row(F.col("cells"), F.when(F.col("has_header"), F.col("headers")), F.col("row_number"))
    rendered = data.select("file", "row_number", line.alias("line")).where(F.col("line") != "")
    return header_line.unionByName(rendered)


def assemble_sheets(lines: DataFrame) -> DataFrame:
    """Per file, ``[Sheet: title]`` then the sheet's lines, sheets in workbook order."""
    per_sheet = lines.groupBy("file", "sheet_idx", "sheet").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_number", "line"))),
                                 lambda x: x["line"]), "\n").alias("body"))
    block = F.concat(F.lit("[Sheet: "), F.col("sheet"), F.lit("]\n"), F.col("body"))
    return per_sheet.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_idx", block.alias("b")))),
                                 lambda x: x["b"]), "\n").alias("text"))


def assemble_lines(lines: DataFrame, order: str = "row_number", key: str = "file") -> DataFrame:
    """Ordered ``'\\n'`` join of a document's lines."""
    return lines.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("l")))),
        lambda x: x["l"]), "\n").alias("text"))


def assemble_parts(rows: DataFrame) -> DataFrame:
    """Paragraphs with their places -> one text per file.

    A cell's paragraphs and then its tables are joined by blanks, cells by
    ' | ', rows and parts by line breaks; in a section paragraphs come before
    tables.  Tables are put together from the innermost depth outwards (one
    round for each depth of nesting).
    """
    items = rows.withColumn("kind", F.lit(0))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(*key, F.col(value).alias("v")))), lambda x: x["v"])
    for depth in range(deepest, 0, -1):
        here = items.where(F.col("depth") == depth).withColumn("t", py_strip(F.col("text")))
        cells = here.groupBy("file", "section", "tbl", "row", "cell").agg(
            F.filter(in_order(["kind", "seq"], "t"), lambda x: x != "").alias("ts"),
            *[F.max(c).alias(c) for c in ("up_tbl", "up_row", "up_cell")]).withColumn("c", F.array_join("ts", " "))
        lines = cells.groupBy("file", "section", "tbl", "row").agg(
            in_order(["cell"], "c").alias("cs"), *[F.max(c).alias(c) for c in ("up_tbl", "up_row", "up_cell")]) \
            .where(has_content(F.col("cs"))).withColumn("l", F.array_join("cs", " | "))
        tables = lines.groupBy("file", "section", "tbl").agg(
            py_strip(F.array_join(in_order(["row"], "l"), "\n")).alias("text"), *[F.max(c).alias(c) for c in ("up_tbl", "up_row", "up_cell")])
        inner = tables.select("file", "section", F.lit(depth - 1).alias("depth"), F.col("up_tbl").alias("tbl"), F.col("up_row").alias("row"),
                              F.col("up_cell").alias("cell"), *[F.lit(None).cast("int").alias(c) for c in ("up_tbl", "up_row", "up_cell")],
                              F.col("tbl").alias("seq"), "text", F.lit(1).alias("kind"))
        items = items.where(F.col("depth") < depth).unionByName(inner)
    lines = items.where(py_strip(F.col("text")) != "").select("file", F.struct("section", "kind", "seq").alias("place"), F.col("text").alias("line"))
    return assemble_lines(lines, order="place")


def assemble_pages(pages: DataFrame, key: str = "file", order: str = "page_no", text: str = "text") -> DataFrame:
    """A10: non-empty page texts in page order, each followed by a newline."""
    p = pages.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return p.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))),
        lambda x: F.concat(x["t"], F.lit("\n"))), "").alias("text"))
