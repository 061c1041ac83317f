"""Publish job (save): spans -> registry -> codes -> rewritten texts + reserved outputs.

Shuffles: the registry aggregation (span rows by entity, partial-aggregated),
the code lookup (broadcast when proven small, else salted shuffle join),
the island windows (span rows by document, no text) and one join of the
documents with their interval arrays by ``doc_id``.
"""
from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.redact import redact_documents
from ..operators.registry import assign_codes, entity_registry
from ..session import checkpoint
from .scan import scan
from ..sinks.text_files import unique_names, write_text_files
from ..sinks.writers import output_name, run_log_rows, safe_dir, write_outputs, write_reserved


def publish(docs: DataFrame, spans: DataFrame, method: str = "two_pass") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (texts(doc_id, file, redacted_text, n_redactions), registry, coded spans)."""
    spans = checkpoint(spans)          # reused by registry, codes and index: computed once
    registry = entity_registry(spans, redacted_only=True, method=method)
    # coded spans feed the island windows (self-joins), the index and the log: computed once
    coded = checkpoint(assign_codes(spans.drop("code"), registry, redacted_only=True))
    texts = redact_documents(docs, coded)
    return texts, registry, coded


def save_outputs(out_dir: str, docs: DataFrame, spans: DataFrame, errors: Optional[DataFrame] = None,
                 include_kept: bool = False) -> None:
    texts, registry, coded = publish(docs, spans)
    errs = errors if errors is not None else docs.sparkSession.createDataFrame([], "file string, message string")
    write_outputs(out_dir, texts, registry, coded, run_log_rows(docs.select("file"), coded, errs), include_kept)


def save_files(out_dir: str, docs: DataFrame, spans: DataFrame, errors: Optional[DataFrame] = None,
               include_kept: bool = False) -> DataFrame:
    """N1-N4 with one ``{stem}_{ext}_anonymized.txt`` per document in the safe folder.

    Files of one name are numbered by (file, doc_id) from the second on; what
    could not be written is an error of the run log.  Returns (file, message) of all errors.
    """
    texts, registry, coded = publish(docs, spans)
    named = unique_names(texts.withColumn("out_name", output_name(F.col("file"))))
    report = write_text_files(named.select("out_name", F.col("redacted_text").alias("text")), safe_dir(out_dir))
    return _save_rest(out_dir, docs, registry, coded, report, errors, include_kept)


def _by_part(parts: DataFrame) -> DataFrame:
    """Parts as documents of their own, for jobs that work on one text after the other."""
    return parts.select(F.struct("doc_id", "part", "at").alias("doc_id"), "file", "text")


def scan_parts(parts: DataFrame, **options) -> DataFrame:
    """``scan`` of a text in parts (``sources.parts``): spans with their places in the whole text, and part, at."""
    s = scan(_by_part(parts), **options)
    place = {c: (F.col(c) + F.col("doc_id.at")).alias(c) for c in ("start", "end")}
    return s.select("doc_id.doc_id", "file", *[place.get(c, F.col(c)) for c in s.columns if c not in ("doc_id", "file")], "doc_id.part", "doc_id.at")


def save_parts(out_dir: str, parts: DataFrame, spans: DataFrame, errors: Optional[DataFrame] = None, include_kept: bool = False) -> DataFrame:
    """``save_files`` for texts in parts: one file per document, whatever its size."""
    spans = checkpoint(spans)
    registry = entity_registry(spans, redacted_only=True)
    coded = checkpoint(assign_codes(spans.drop("code"), registry, redacted_only=True))
    local = coded.withColumns({"doc_id": F.struct("doc_id", "part", "at"), "start": (F.col("start") - F.col("at")).cast("int"),
                               "end": (F.col("end") - F.col("at")).cast("int")})
    texts = redact_documents(_by_part(parts), local)
    docs = parts.where("part = 0").select("doc_id", "file")
    named = unique_names(docs.withColumn("out_name", output_name(F.col("file")))).select(F.col("doc_id").alias("_doc"), F.col("file").alias("_file"), "out_name")
    rows = texts.join(named, (F.col("doc_id.doc_id") == F.col("_doc")) & (F.col("file") == F.col("_file")))
    report = write_text_files(rows.select("out_name", F.col("doc_id.part").alias("part"), F.col("redacted_text").alias("text")), safe_dir(out_dir))
    return _save_rest(out_dir, docs, registry, coded.drop("part", "at"), report, errors, include_kept)


def _save_rest(out_dir: str, docs: DataFrame, registry: DataFrame, coded: DataFrame, report: DataFrame, errors: Optional[DataFrame], include_kept: bool) -> DataFrame:
    errs = report.where("error is not null").select(F.col("out_name").alias("file"), F.concat_ws(": ", "out_name", "error").alias("message"))
    if errors is not None:
        errs = errors.select("file", "message").unionByName(errs)
    write_reserved(out_dir, registry, coded, run_log_rows(docs.select("file"), coded, errs), include_kept)
    return errs
