"""Overlap resolution and de-duplication.

Per document (array form, used inside the scan projection):

* ``greedy_regex``  E1 — among rule matches, earliest start wins, then label
  priority, then length; once sorted by start only the furthest accepted end
  matters, so the fold carries one integer.
* ``priority_insert`` E2 — context then rule spans are inserted into the model
  spans: a candidate enters if it out-ranks every span it overlaps (those are
  removed), else it is dropped.
* ``dedupe_array`` E3 — exact duplicates (label, offsets, normalised text) keep
  the best rank.

Across documents (row form): ``dedupe_rows`` (E3 as an aggregation),
``islands`` (E5, gaps-and-islands with a running max end) and
``island_representatives`` (E6).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import REGEX_LABEL_PRIORITY
from ..functions.memo import memo_columns
from ..functions.text import normalize_entity
from .spans import SPAN_ARRAY, overlaps, sort_spans, source_priority, span_rank


def _regex_label_priority(label: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for name, prio in REGEX_LABEL_PRIORITY.items():
        expr = expr.when(label == name, F.lit(prio))
    return expr.otherwise(F.lit(0))


def greedy_regex(cands: Column) -> Column:
    """Non-overlapping subset of rule matches, returned in (start, end, label) order."""
    keyed = F.transform(cands, lambda s, i: F.struct(
        s["start"].alias("k1"), (-_regex_label_priority(s["label"])).alias("k2"),
        (s["start"] - s["end"]).alias("k3"), i.alias("k4"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    init = F.struct(F.lit(0).alias("last_end"), F.array().cast(SPAN_ARRAY).alias("out"))

    def step(acc, s):
        take = s["start"] >= acc["last_end"]
        return F.struct(
            F.when(take, F.greatest(acc["last_end"], s["end"])).otherwise(acc["last_end"]).alias("last_end"),
            F.when(take, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    return sort_spans(F.aggregate(ordered, init, step, lambda a: a["out"]))


def priority_insert(accepted: Column, candidates: Column) -> Column:
    """Fold ``candidates`` (in order) into ``accepted`` by rank replacement."""
    def step(acc, c):
        wins = F.forall(acc, lambda o: ~overlaps(o, c) | (span_rank(c) > span_rank(o)))
        return F.when(wins, F.concat(F.filter(acc, lambda o: ~overlaps(o, c)), F.array(c))).otherwise(acc)

    return F.aggregate(candidates, accepted, step)


def dedupe_keys(spans: Column) -> Column:
    """E3 step 1: attach (index, rank, key); materialise before ``dedupe_keyed``."""
    return F.transform(spans, lambda s, i: F.struct(
        s.alias("s"), i.alias("i"), span_rank(s).alias("r"),
        F.struct(s["label"], s["start"], s["end"], normalize_entity(s["label"], s["text"])).alias("key")))


def dedupe_keyed(keyed: Column) -> Column:
    """E3 step 2: keep the best rank per key (first on ties); drop invalid bounds; sort."""
    kept = F.filter(keyed, lambda x: ~F.exists(keyed, lambda y: (y["key"] == x["key"]) & (
        (y["r"] > x["r"]) | ((y["r"] == x["r"]) & (y["i"] < x["i"])))))
    valid = F.filter(F.transform(kept, lambda x: x["s"]), lambda s: (s["start"] >= 0) & (s["end"] > s["start"]))
    return sort_spans(valid)


def dedupe_array(spans: Column) -> Column:
    """Single-expression E3 (small inputs, tests)."""
    return dedupe_keyed(dedupe_keys(spans))


def resolve_document(model: Column, context: Column, regex: Column) -> Column:
    """Single-expression resolution: model, then context, then E1-filtered rules."""
    return dedupe_array(priority_insert(model, F.concat(context, greedy_regex(regex))))


def resolve_df(df: DataFrame, keep: list[str], model: str = "m", context: str = "c", regex: str = "r",
               out: str = "spans") -> DataFrame:
    """Staged resolution: each array is a column before a lambda reads it twice."""
    k = [F.col(c) for c in keep]
    g, merged, keyed, final = memo_columns(("resolve", model, context, regex), lambda: (
        greedy_regex(F.col(regex)), priority_insert(F.col(model), F.concat(F.col(context), F.col("_g"))),
        dedupe_keys(F.col("_merged")), dedupe_keyed(F.col("_keyed"))))
    d = df.select(*k, F.col(model), F.col(context), g.alias("_g"))
    d = d.select(*k, merged.alias("_merged"))
    d = d.select(*k, keyed.alias("_keyed"))
    return d.select(*k, final.alias(out))


# ---------------------------------------------------------------------------
# row form
# ---------------------------------------------------------------------------

def with_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", span_rank(F.struct("start", "end", "score", "source")))


def dedupe_rows(spans: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """E3 over span rows: one row per (doc, label, start, end, normalised text), best rank.

    An aggregation with map-side partial aggregation, so a hot key is
    combined before the shuffle.
    """
    cols = [c for c in spans.columns]
    keyed = spans.withColumn("_norm", normalize_entity(F.col("label"), F.col("text")))
    best = keyed.groupBy(doc_key, "label", "start", "end", "_norm").agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]),
                 span_rank(F.struct("start", "end", "score", "source"))).alias("_b"))
    return best.select("_b.*").where((F.col("start") >= 0) & (F.col("end") > F.col("start")))


PAIR_CHUNK = 256   # characters of a position bucket


def overlapping_pairs(spans: DataFrame) -> DataFrame:
    """overlapping spans (doc_id, start, end, label, rule_idx) of a document, each pair once.

    A span is listed in every position bucket it touches, the join is on
    (document, bucket), and a pair counts in the bucket where its overlap starts.
    """
    lists = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / PAIR_CHUNK).cast("int"),
                                                        F.floor((F.greatest("end", F.col("start") + 1) - 1) / PAIR_CHUNK).cast("int"))))
    a, b = lists.alias("a"), lists.alias("b")
    lo = F.greatest("a.start", "b.start")
    cond = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a._b") == F.col("b._b")) & (lo < F.least("a.end", "b.end")) & \
        (F.floor(lo / PAIR_CHUNK) == F.col("a._b")) & \
        (F.struct("a.start", "a.end", "a.rule_idx") < F.struct("b.start", "b.end", "b.rule_idx"))
    return a.join(b, cond).select("a.doc_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in ("start", "end", "label")])


def islands(spans: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """E5: ``island`` = start offset of the island's first span.

    A new island starts where ``start >= max(end of every earlier span)``
    (touching intervals stay apart).  One shuffle of span rows (never text) by
    document and one sort serve both running maxima; a document's spans are
    bounded by its text, which is one row already.
    """
    w = Window.partitionBy(doc_key).orderBy("start", "end")
    before = Window.unboundedPreceding
    prev = F.coalesce(F.max("end").over(w.rowsBetween(before, -1)), F.lit(-1))
    s = spans.withColumn("_new", F.col("start") >= prev)
    first = F.max(F.when(F.col("_new"), F.col("start"))).over(w.rowsBetween(before, 0))
    return s.withColumn("island", first.cast("int")).drop("_new")


def island_representatives(spans: DataFrame, text_df: DataFrame | None = None,
                           doc_key: str = "doc_id") -> DataFrame:
    """One span per island — min start, max end, label/code/score of the best rank.

    Ties on rank keep the first member in (start, end) order.  A single span
    whose bounds equal the island passes through unchanged; otherwise the
    result's source is ``merged`` and its text is the original text of the
    island (needs ``text_df(doc_id, text)``; without it the text is left null).
    """
    isl = islands(spans, doc_key)
    r = span_rank(F.struct("start", "end", "score", "source"))
    # best rank first; ties keep the first member in (start, end, label) order
    order = F.struct((-r["p"]).alias("p"), (-r["s"]).alias("s"), (-r["n"]).alias("n"), F.col("start").alias("a"),
                     F.col("end").alias("b"), F.col("label").alias("l"), F.col("text").alias("c"))
    member = F.struct(*[F.col(c) for c in spans.columns if c != doc_key])
    g = isl.groupBy(doc_key, "island").agg(
        F.min("start").alias("i_start"), F.max("end").alias("i_end"), F.count("*").alias("n"),
        F.min_by(member, order).alias("best"))
    rep = g.select(doc_key, "island", "i_start", "i_end", "n", "best.*")
    single = (F.col("n") == 1) & (F.col("start") == F.col("i_start")) & (F.col("end") == F.col("i_end"))
    if text_df is not None:
        rep = rep.join(text_df.select(doc_key, F.col("text").alias("_doc_text")), doc_key, "left")
        merged_text = F.substring("_doc_text", F.col("i_start") + 1, F.col("i_end") - F.col("i_start"))
    else:
        merged_text = F.lit(None).cast("string")
    out = rep.select(
        *[F.col(c) for c in spans.columns if c not in ("start", "end", "text", "source", "will_redact")],
        F.when(single, F.col("text")).otherwise(merged_text).alias("text"),
        F.col("i_start").cast("int").alias("start"), F.col("i_end").cast("int").alias("end"),
        F.lit(True).alias("will_redact"),
        F.when(single, F.col("source")).otherwise(F.lit("merged")).alias("source"),
    )
    return out.select(*spans.columns)


__all__ = ["greedy_regex", "priority_insert", "dedupe_array", "resolve_document", "dedupe_rows",
           "islands", "island_representatives", "with_rank", "source_priority"]
