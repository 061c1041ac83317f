"""Span representation shared by all operators.

In the scan, a document's spans live *on the document row* as
``array<struct<...>>`` so detection and overlap resolution are one narrow
projection (no shuffle).  Outside the scan a span is one row:
``SPAN_COLUMNS``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import SOURCE_PRIORITY

SPAN_STRUCT = "struct<start:int,end:int,label:string,text:string,score:double,source:string>"
SPAN_ARRAY = f"array<{SPAN_STRUCT}>"

SPAN_COLUMNS = ["doc_id", "file", "label", "text", "start", "end", "score", "will_redact", "code", "source"]


def empty_spans() -> Column:
    return F.array().cast(SPAN_ARRAY)


def make_span(start, end, label, text, score, source) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        label.alias("label"),
        text.alias("text"),
        score.cast("double").alias("score"),
        source.alias("source"),
    )


def source_priority(source: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for name, prio in SOURCE_PRIORITY.items():
        expr = expr.when(source == name, F.lit(prio))
    return expr.otherwise(F.lit(0))


def span_rank(s) -> Column:
    """Rank tuple (source priority, score or 0, length); struct order is lexicographic."""
    return F.struct(
        source_priority(s["source"]).alias("p"),
        F.coalesce(s["score"], F.lit(0.0)).alias("s"),
        (s["end"] - s["start"]).alias("n"),
    )


def overlaps(a, b) -> Column:
    """Half-open overlap: touching intervals do not overlap."""
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def sort_spans(arr: Column) -> Column:
    """Order (start, end, label) — the output order of a document's spans."""
    keyed = F.transform(arr, lambda s: F.struct(s["start"].alias("k1"), s["end"].alias("k2"),
                                                s["label"].alias("k3"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def explode_array(df, array_col, keep, alias: str = "s"):
    """Rows of ``array_col`` (one per element) with the ``keep`` columns.

    ``explode_outer`` + a null filter above the generator: a plain ``explode``
    makes the optimizer infer ``size(array) > 0`` and push it below the
    projections, which would evaluate the whole detection expression twice.
    """
    from pyspark.sql import functions as F
    return df.select(*keep, F.explode_outer(array_col).alias(alias)).where(F.col(alias).isNotNull())
