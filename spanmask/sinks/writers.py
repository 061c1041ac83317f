"""Outputs (N1-N5, N7): shareable texts apart from the reserved mapping, index and log.

Everything is written by the tasks, never funnelled through the driver: Spark
tables here, one file per document in ``text_files``.  Layout under ``out_dir``::

    <SAFE_SUBDIR>/texts        parquet (doc_id, file, out_name, text)
    <RESERVED_SUBDIR>/mapping  csv + json (entity_id, placeholder, label, text)
    <RESERVED_SUBDIR>/index    csv (file, placeholder, label, text, start, end, score, will_redact, source)
    <RESERVED_SUBDIR>/log      json (metrics, counts per label, errors)
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import OUTPUT_SUFFIX, RESERVED_SUBDIR, SAFE_SUBDIR
from ..functions.text import extension, stem
from ..session import ship_package


def safe_dir(out_dir: str) -> str:
    return os.path.join(out_dir, SAFE_SUBDIR)


def reserved_dir(out_dir: str) -> str:
    return os.path.join(out_dir, RESERVED_SUBDIR)


def output_name(file: Column) -> Column:
    """``{stem}_{ext}_anonymized.txt``; ``file`` when there is no extension."""
    ext = extension(file)
    tag = F.when(ext == "", F.lit("file")).otherwise(ext)
    return F.concat(stem(file), F.lit("_"), tag, F.lit(OUTPUT_SUFFIX))


def index_rows(spans: DataFrame, include_kept: bool = False) -> DataFrame:
    """The occurrence index (redacted spans only unless ``include_kept``)."""
    src = spans if include_kept else spans.where(F.col("will_redact"))
    return src.select(
        "file", F.col("code").alias("placeholder"), "label", "text", "start", "end",
        F.when(F.col("score").isNull(), F.lit("")).otherwise(F.format_string("%.3f", F.col("score"))).alias("score"),
        "will_redact", "source")


def mapping_rows(registry: DataFrame) -> DataFrame:
    return registry.select("entity_id", "placeholder", "label", "text")


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side by side columns of two single-row aggregates (an equi-join on a constant key)."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def write_outputs(out_dir: str, texts: DataFrame, registry: DataFrame, spans: DataFrame, log: DataFrame,
                  include_kept: bool = False) -> None:
    """N1-N4.  Text goes only under the safe folder; originals only under reserved."""
    texts.select("doc_id", "file", output_name(F.col("file")).alias("out_name"),
                 F.col("redacted_text").alias("text")).write.mode("overwrite").parquet(
        os.path.join(safe_dir(out_dir), "texts"))
    write_reserved(out_dir, registry, spans, log, include_kept)


def write_reserved(out_dir: str, registry: DataFrame, spans: DataFrame, log: DataFrame, include_kept: bool = False) -> None:
    """Mapping, index and log, under the reserved folder."""
    mapping = mapping_rows(registry)
    mapping.write.mode("overwrite").option("header", True).option("escape", '"').csv(
        os.path.join(reserved_dir(out_dir), "mapping_csv"))
    mapping.write.mode("overwrite").json(os.path.join(reserved_dir(out_dir), "mapping_json"))
    index_rows(spans, include_kept).write.mode("overwrite").option("header", True).option("escape", '"').csv(
        os.path.join(reserved_dir(out_dir), "index_csv"))
    log.withColumn("processed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")) \
        .write.mode("overwrite").json(os.path.join(reserved_dir(out_dir), "log"))


def _leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text those of its values that stand in it, by one pass of an automaton of these values."""
    import ahocorasick
    for b in batches:
        for i in range(b.num_rows):
            search = ahocorasick.Automaton()
            for v in b.column("values")[i].as_py():
                search.add_word(v, v)
            search.make_automaton()
            left = {v for _, v in search.iter(b.column("redacted_text")[i].as_py())}
            if left:
                yield pa.RecordBatch.from_arrays([pa.array([b.column("doc_id")[i].as_py()] * len(left), b.schema.field("doc_id").type),
                                                  pa.array(sorted(left))], ["doc_id", "value"])


def leak_check(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Redacted original values still present in their document's safe text (must be empty).

    The distinct values of a document meet its text once, and the text is read
    once, however many they are.
    """
    ship_package(texts.sparkSession)
    values = spans.where(F.col("will_redact") & (F.length("text") > 0)) \
        .groupBy("doc_id").agg(F.collect_set("text").alias("values"))
    both = texts.where(F.length("redacted_text") > 0).select("doc_id", "redacted_text").join(values, "doc_id")
    return both.mapInArrow(_leaks, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, value string")


def run_log_rows(files: DataFrame, spans: DataFrame, errors: DataFrame) -> DataFrame:
    """N4 as rows ``(section, key, value)``: totals, one row per input file, per label, per error.

    The timestamp line is left to the writer; rows (not one string) keep a log of
    millions of input files distributed.
    """
    tot = spans.agg(F.count("*").alias("total_spans"), F.count_if(F.col("will_redact")).alias("redacted_spans"),
                    F.count_if(~F.col("will_redact")).alias("kept_spans"))
    n_files = files.agg(F.count("*").alias("processed_files"))
    summary = one_row_join(n_files, tot).select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
          for c in ("processed_files", "total_spans", "redacted_spans", "kept_spans")])).alias("kv")) \
        .select(F.lit("summary").alias("section"), "kv.key", "kv.value")
    listed = files.select(F.lit("input_file").alias("section"), F.col("file").alias("key"), F.lit("").alias("value"))
    by_label = spans.where(F.col("will_redact")).groupBy("label").count().select(
        F.lit("redactions_by_label").alias("section"), F.col("label").alias("key"),
        F.col("count").cast("string").alias("value"))
    errs = errors.select(F.lit("error").alias("section"), F.col("file").alias("key"), F.col("message").alias("value"))
    return summary.unionByName(listed).unionByName(by_label).unionByName(errs)
