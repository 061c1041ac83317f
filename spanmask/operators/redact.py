"""Rewriting (K1-K3): merged redaction intervals -> placeholder text.

The intervals of a document are computed on span rows (E5/E6, shuffled by
``doc_id`` without any text), gathered into one sorted array per document and
joined to the document once.  The rewrite itself is a single pass over that
array: every interval contributes "gap before it" + placeholder.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .resolve import island_representatives

def placeholder(code: Column, label: Column) -> Column:
    return F.concat(F.lit("["), F.when(F.coalesce(code, F.lit("")) != "", code).otherwise(F.upper(label)),
                    F.lit("]"))


PIECE = 256


def rewrite(text: Column, ivs: Column) -> Column:
    """Replace each (sorted, disjoint) interval of ``text`` by its placeholder.

    The text is cut once into pieces of PIECE characters; a gap between two
    intervals is put together from the pieces it touches, so no position is
    counted from the start of the text.
    """
    def between(pieces, start, end):
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        part = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(part, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))

    def whole(pieces):
        def piece(x, i):
            prev_end = F.when(i == 0, F.lit(0)).otherwise(F.get(ivs, i - 1)["end"])
            return F.concat(between(pieces, prev_end, x["start"]), x["ph"])

        last_end = F.element_at(ivs, -1)["end"]
        tail = F.array_join(F.slice(pieces, F.floor(last_end / PIECE).cast("int") + 1, F.size(pieces) + 1), "")
        return F.concat(F.array_join(F.transform(ivs, piece), ""), F.substring(tail, last_end % PIECE + 1, F.length(tail)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.coalesce(F.size(ivs), F.lit(0)) <= 0, text).otherwise(bind(cut, whole))


def redaction_intervals(spans: DataFrame) -> DataFrame:
    """Per document: sorted merged intervals with their placeholders (doc_id, ivs, n_redactions)."""
    cand = spans.where(F.col("will_redact") & (F.col("start") >= 0) & (F.col("end") > F.col("start")))
    reps = island_representatives(cand.select("doc_id", "file", "label", "text", "start", "end", "score",
                                              "will_redact", "code", "source"))
    return reps.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end"),
                                             placeholder(F.col("code"), F.col("label")).alias("ph")))).alias("ivs"),
        F.count("*").alias("n_redactions"))


def redact_documents(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, file, redacted_text, n_redactions) for every document.

    Documents without a redaction keep their text; only the span side is
    aggregated, the text side is read once and joined on ``doc_id``.
    """
    ivs = redaction_intervals(spans)
    j = docs.select("doc_id", "file", "text").join(ivs, "doc_id", "left")
    return j.select("doc_id", "file", rewrite(F.col("text"), F.col("ivs")).alias("redacted_text"),
                    F.coalesce(F.col("n_redactions"), F.lit(0)).cast("long").alias("n_redactions"))


def preview(docs: DataFrame, spans: DataFrame, doc_id: int) -> DataFrame:
    """K2: the rewritten text of one document; both sides are filtered before anything else."""
    return redact_documents(docs.where(F.col("doc_id") == doc_id), spans.where(F.col("doc_id") == doc_id))


def highlight_ranges(spans: DataFrame) -> DataFrame:
    """K3: ranges to highlight over the original text, redact vs keep."""
    return spans.select("doc_id", "file", "start", "end",
                        F.when(F.col("will_redact"), F.lit("redact")).otherwise(F.lit("keep")).alias("tag"))
