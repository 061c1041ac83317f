"""Scan job (D13): documents -> resolved spans.

One narrow projection per document row turns rules, context fields and model
findings into candidate rows; these alone are shuffled by document and
resolved island by island (E1, E2, E3).  The text never leaves its partition;
only the optional findings table is joined (on ``doc_id``).
"""
from __future__ import annotations

from typing import Iterable, Optional, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CONTEXT_ORG_RE, DEFAULT_LABELS
from ..functions.matches import regex_matches_df
from ..functions.memo import memo_columns
from ..functions.text import normalize_entity, normalize_free_text
from ..operators.detect import (CONTEXT_GUARD, DEFAULT_RULES, RegexRule, context_candidates_from, model_spans,
                                no_findings, rule_candidates_from)
from ..operators.resolve import islands, resolve_df
from ..operators.spans import empty_spans, explode_array


def redact_flag(spans: DataFrame, labels: Iterable[str], exclusions: Union[Iterable[str], DataFrame] = ()) -> DataFrame:
    """C2 + C3: ``will_redact`` of spans: the label is selected and the text is not an exception.

    Exceptions are strings or a table whose first column holds them, of any
    length.  They meet the spans by two equi-joins, on the folded text and on
    the entity's normal form: Spark sends a small table to the tasks and
    splits a hot entity otherwise.  Blank and null exceptions except nothing.
    """
    flag = F.col("label").isin(list(labels))
    if not isinstance(exclusions, DataFrame):
        terms = sorted({t for t in exclusions or [] if t and t.strip()})
        if not terms:
            return spans.withColumn("will_redact", flag)
        exclusions = spans.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    key = normalize_free_text(F.col(exclusions.columns[0]))
    keys = exclusions.select(key.alias("_key")).where(F.length("_key") > 0).distinct()
    keyed = spans.withColumns({"_free": normalize_free_text(F.col("text")), "_entity": normalize_entity(F.col("label"), F.col("text"))})
    for form, found in (("_free", "_x1"), ("_entity", "_x2")):
        keyed = keyed.join(keys.select(F.col("_key").alias(form), F.lit(True).alias(found)), form, "left")
    return keyed.withColumn("will_redact", flag & F.col("_x1").isNull() & F.col("_x2").isNull()).select(*spans.columns, "will_redact")


def findings_per_doc(findings: DataFrame) -> DataFrame:
    """(doc_id, findings array in model order); ``seq`` orders, else (start, end, label)."""
    f = findings
    if "seq" not in f.columns:
        f = f.withColumn("seq", F.lit(0))
    item = F.struct(F.col("seq").cast("int").alias("k0"), F.col("start").cast("int").alias("k1"),
                    F.col("end").cast("int").alias("k2"), F.col("label").alias("k3"),
                    F.struct(F.col("label"), F.col("start").cast("int").alias("start"),
                             F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"),
                             F.col("seq").cast("int").alias("seq")).alias("f"))
    return f.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("findings"))


def _tag(col: str, kind: int) -> Column:
    return F.transform(col, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), x.alias("s")))


def resolved_rows(docs: DataFrame, findings: Optional[DataFrame] = None, min_score: Optional[float] = None,
                  rules: list[RegexRule] = DEFAULT_RULES, use_context: bool = True) -> DataFrame:
    """(doc_id, file, s): one row per resolved span."""
    inline = findings is None and "findings" in docs.columns      # attached by a model next to the text
    d = docs.select(*["doc_id", "file", "text"] + (["findings"] if inline else []))
    if findings is not None:
        d = d.join(findings_per_doc(findings), "doc_id", "left")
    cand = candidate_arrays(d, findings is not None or inline, min_score, rules, use_context)
    rows = explode_array(cand, F.concat(_tag("m", 0), _tag("c", 1), _tag("r", 2)), ["doc_id", "file"], "e") \
        .select("doc_id", "file", F.col("e.kind").alias("kind"), F.col("e.ord").alias("ord"), F.col("e.s").alias("s"))
    return resolve_rows(rows)


def candidate_arrays(d: DataFrame, with_findings: bool, min_score, rules, use_context) -> DataFrame:
    """(doc_id, file, m, c, r): model, context and rule candidate arrays of each document."""
    specs = [(rule.pattern, rule.group, rule.guard, f"_rx{i}") for i, rule in enumerate(rules)]
    if use_context:
        specs.append((CONTEXT_ORG_RE, 2, CONTEXT_GUARD, "_ctx"))
    d = regex_matches_df(d, "text", specs)

    def build():
        mcol = (model_spans(F.col("text"), F.coalesce(F.col("findings"), no_findings()), min_score)
                if with_findings else empty_spans())
        rx = [rule_candidates_from(F.col(f"_rx{i}"), rule) for i, rule in enumerate(rules)]
        return (mcol.alias("m"),
                (context_candidates_from(F.col("_ctx")) if use_context else empty_spans()).alias("c"),
                (F.concat(*rx) if len(rx) > 1 else rx[0]).alias("r"))

    cols = memo_columns(("candidates", tuple(rules), use_context, with_findings, min_score), build)
    return d.select("doc_id", "file", *cols)


def resolve_rows(rows: DataFrame) -> DataFrame:
    """Candidate rows (doc_id, file, kind, ord, s) resolved per island.

    E1, E2 and E3 only ever compare overlapping spans and spans of different
    islands never overlap, so folding each island separately equals folding
    the whole document.  The cost grows with the number of
    candidates, and within an island with its few members.
    """
    r = rows.select("doc_id", "file", "kind", "ord", "s", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    g = islands(r).groupBy("doc_id", "file", "island").agg(
        F.array_sort(F.collect_list(F.struct("kind", "ord", "s"))).alias("items"))

    def part(k):
        return F.transform(F.filter("items", lambda x: x["kind"] == k), lambda x: x["s"])

    per_island = g.select("doc_id", "file", "island", part(0).alias("m"), part(1).alias("c"), part(2).alias("r"))
    res = resolve_df(per_island, ["doc_id", "file"])
    return explode_array(res, F.col("spans"), ["doc_id", "file"])


def scan(docs: DataFrame, labels: Iterable[str] = DEFAULT_LABELS, exclusions: Union[Iterable[str], DataFrame] = (),
         findings: Optional[DataFrame] = None, min_score: Optional[float] = None,
         rules: list[RegexRule] = DEFAULT_RULES, use_context: bool = True) -> DataFrame:
    """Span rows: doc_id, file, label, text, start, end, score, will_redact, code, source."""
    s = resolved_rows(docs, findings, min_score, rules, use_context).select("doc_id", "file", "s.*")
    return redact_flag(s, labels, exclusions).select(
        "doc_id", "file", "label", "text", "start", "end", "score", "will_redact", F.lit("").alias("code"), "source")
