"""Human review as DataFrame operations.

Decisions are an immutable side table joined onto the spans; codes are
recomputed from scratch afterwards (numbering changes with decisions, as in
the reviewed behaviour).
"""
from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.fixed import (ALL_KNOWN_LABELS, DEFAULT_LABELS, FILTER_ALL, LABEL_DISPLAY, REVIEW_TEXT_CUT,
                               REVIEW_TEXT_MAX, SCORE_HIGH, SCORE_MEDIUM, SOURCE_DISPLAY)
from ..functions.text import fold, map_lookup, py_strip
from ..session import checkpoint
from .anchors import occurrences, row_key
from .registry import assign_codes, entity_registry
from .resolve import dedupe_rows
from .numbering import row_numbers

LABEL_FROM_DISPLAY = {v: k for k, v in LABEL_DISPLAY.items()}


def display_label(label: Column) -> Column:
    return map_lookup(LABEL_DISPLAY, label)


def label_from_display(name: Column) -> Column:
    return map_lookup(LABEL_FROM_DISPLAY, name)


def source_display(source: Column) -> Column:
    return map_lookup(SOURCE_DISPLAY, source)


def score_bucket(score: Column) -> Column:
    return (F.when(score.isNull(), F.lit("-")).when(score >= SCORE_HIGH, F.lit("High"))
            .when(score >= SCORE_MEDIUM, F.lit("Medium")).otherwise(F.lit("Low")))


def review_text(text: Column) -> Column:
    return F.when(F.length(text) <= REVIEW_TEXT_MAX, text).otherwise(
        F.concat(F.substring(text, 1, REVIEW_TEXT_CUT), F.lit("...")))


def review_rows(spans: DataFrame) -> DataFrame:
    """The review table row of every span."""
    return spans.select(
        "doc_id", "start", "end",
        F.when(F.col("will_redact"), F.lit("Yes")).otherwise(F.lit("No")).alias("redact"),
        F.col("code"), F.col("file"), display_label(F.col("label")).alias("type"),
        review_text(F.col("text")).alias("text"), score_bucket(F.col("score")).alias("confidence"),
        source_display(F.col("source")).alias("source_name"))


def review_filter(spans: DataFrame, display_value: str) -> DataFrame:
    """Visible rows for a label filter (display name, or 'All data')."""
    if display_value == FILTER_ALL:
        return spans
    return spans.where(F.col("label") == label_from_display(F.lit(display_value)))


SORT_KEYS = {
    "redact": lambda: F.col("will_redact"),
    "code": lambda: F.col("code"),
    "file": lambda: fold(F.col("file")),
    "type": lambda: fold(display_label(F.col("label"))),
    "text": lambda: fold(F.col("text")),
    "confidence": lambda: F.coalesce(F.col("score"), F.lit(-1.0)),
    "source": lambda: fold(source_display(F.col("source"))),
}


def review_sort(spans: DataFrame, column: str, descending: bool = False, index_col: str = "idx") -> DataFrame:
    """Stable sort on one review column; ties keep the original order in both directions.

    Adds the display position ``pos`` (1-based) with the two-pass global row
    number (no single-task window).
    """
    key = SORT_KEYS[column]()
    return row_numbers(spans, [(key, not descending), (F.col(index_col), True)], "pos")


def review_page(spans: DataFrame, column: str, size: int, after: Optional[Row] = None, descending: bool = False,
                index_col: str = "idx") -> DataFrame:
    """The next ``size`` rows of :func:`review_sort` behind the row ``after`` (null: the first page), in that order.

    Adds the sort key ``page_key``; any row of a page can stand as ``after``.
    Each task keeps its ``size`` first rows behind that place, so a page takes
    no sort and no shuffle of the table, however far it lies.
    """
    keyed = spans.withColumn("page_key", SORT_KEYS[column]())
    if after is not None:
        here, there = F.struct("page_key"), F.struct(F.lit(after["page_key"]).cast(keyed.schema["page_key"].dataType).alias("page_key"))
        further = here < there if descending else here > there          # null keys are the least, as in the sort
        keyed = keyed.where(further | ((here == there) & (F.col(index_col) > F.lit(after[index_col]))))
    key = F.col("page_key")
    return keyed.orderBy(key.desc() if descending else key.asc(), F.col(index_col)).limit(size)


def labels_found(spans: DataFrame) -> DataFrame:
    """Distinct display labels present."""
    return spans.select(display_label(F.col("label")).alias("type")).distinct()


def apply_decisions(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision row (doc_id, label, start, end, will_redact) overrides the flag."""
    d = decisions.select("doc_id", "label", "start", "end", F.col("will_redact").alias("_decided"))
    return spans.join(d, ["doc_id", "label", "start", "end"], "left") \
        .withColumn("will_redact", F.coalesce(F.col("_decided"), F.col("will_redact"))).drop("_decided")


def bulk_decision(spans: DataFrame, display_value: str, value: bool) -> DataFrame:
    """O2: set every visible (label-filtered) span."""
    if display_value == FILTER_ALL:
        return spans.withColumn("will_redact", F.lit(value))
    hit = F.col("label") == label_from_display(F.lit(display_value))
    return spans.withColumn("will_redact", F.when(hit, F.lit(value)).otherwise(F.col("will_redact")))


def rebuild_codes(spans: DataFrame, method: str = "two_pass") -> DataFrame:
    """O3: clear codes, number the redacted spans again, attach the new codes."""
    spans = checkpoint(spans)                    # read by the registry and by the codes
    reg = entity_registry(spans, redacted_only=True, method=method)
    return assign_codes(spans.drop("code"), reg, redacted_only=True)


def typed_terms(terms: DataFrame) -> DataFrame:
    """(term, label) without outer white space, blanks and repeats."""
    return terms.select(py_strip(F.col("term")).alias("term"), "label").where(F.length("term") > 0).distinct()


def manual_term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every non-overlapping, case-sensitive occurrence of each term in every document.

    Terms are found by their rarest grams (``anchors``).  Of one term's
    occurrences those are kept that repeated search from the end of the last
    one finds: runs of overlapping occurrences are cut out by a window and
    folded one by one.
    """
    rows = docs.select("doc_id", "file", "text", row_key("doc_id", "file", "text").alias("key"))
    hits = occurrences(rows, typed_terms(terms))
    w = Window.partitionBy("key", "term").orderBy("start")
    fresh = F.coalesce(F.col("start") >= F.lag("start").over(w) + F.length("term"), F.lit(True))
    runs = hits.withColumn("_run", F.max(F.when(fresh, F.col("start"))).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("key", "term", "_run").agg(F.sort_array(F.collect_list("start")).alias("starts"))

    def step(acc, s):
        take = s >= acc["upto"]
        return F.struct(F.when(take, s + F.length("term")).otherwise(acc["upto"]).alias("upto"),
                        F.when(take, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"))

    none = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("kept"))
    kept = F.when(F.size("starts") == 1, F.col("starts")).otherwise(F.aggregate("starts", none, step, lambda a: a["kept"]))
    return runs.select("key", "term", F.explode(kept).alias("start")).join(typed_terms(terms), "term") \
        .join(rows.select("key", "doc_id", "file").distinct(), "key") \
        .select("doc_id", "file", "label", F.col("term").alias("text"), "start", (F.col("start") + F.length("term")).alias("end"))


def manual_add(spans: DataFrame, docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add manual spans not already present (F6), de-duplicate (E3), renumber (O3).

    Returns (new spans, per-term count of added occurrences, 0 for terms not found).
    """
    spans = checkpoint(spans)                    # read by the anti-join, the registry and the codes
    found = manual_term_spans(docs, terms)
    fresh = checkpoint(found.join(spans.select("doc_id", "start", "end", "label"), ["doc_id", "start", "end", "label"],
                                  "left_anti"))
    added = fresh.select("doc_id", "file", "label", "text", "start", "end", F.lit(None).cast("double").alias("score"),
                         F.lit(True).alias("will_redact"), F.lit("").alias("code"), F.lit("manual").alias("source"))
    counts = typed_terms(terms).select("term").distinct() \
        .join(fresh.groupBy(F.col("text").alias("term")).agg(F.count("*").alias("n")), "term", "left") \
        .select("term", F.coalesce("n", F.lit(0)).alias("added"))
    merged = dedupe_rows(spans.select(*added.columns).unionByName(added))
    return rebuild_codes(merged), counts


def label_presets() -> dict[str, list[str]]:
    """The two label presets."""
    return {"recommended": list(DEFAULT_LABELS), "all": list(ALL_KNOWN_LABELS)}


def summary(spans: DataFrame, n_files: Optional[Column] = None) -> DataFrame:
    """Totals — spans, redacted, kept."""
    return spans.agg(F.count("*").alias("total_spans"),
                     F.count_if(F.col("will_redact")).alias("redacted_spans"),
                     F.count_if(~F.col("will_redact")).alias("kept_spans"))


def redactions_by_label(spans: DataFrame) -> DataFrame:
    """G2."""
    return spans.where(F.col("will_redact")).groupBy("label").agg(F.count("*").alias("n"))


def first_span(spans: DataFrame) -> DataFrame:
    """Preview anchor per document."""
    return spans.groupBy("doc_id").agg(F.min("start").alias("first_start"))


def kept_vs_redacted(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complementary partitions."""
    return spans.where(F.col("will_redact")), spans.where(~F.col("will_redact"))


def selected(labels: Optional[Iterable[str]]) -> list[str]:
    return list(labels) if labels is not None else list(DEFAULT_LABELS)
