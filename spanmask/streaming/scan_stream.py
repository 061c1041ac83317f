"""Incremental scan: documents arriving as files are scanned batch by batch.

``readStream`` of a folder (``binaryFile``: whole files as rows) feeds the same
ingest and scan as the batch job inside ``foreachBatch``; each batch writes its own partition of a parquet table
and the stream's progress lives in ``checkpointLocation`` (a shared folder on
a cluster), so a restarted query resumes without rescanning or losing files.
Placeholder numbering stays a batch job over the accumulated spans (numbers
depend on every document, as in the batch pipeline).
"""
from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_LABELS
from ..functions.text import basename, extension_with_dot
from ..plans.scan import scan
from ..sources.files import documents_from_files, is_supported


def file_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming (path, name, ext, content) of supported files dropped into ``folder``."""
    raw = (spark.readStream.format("binaryFile")
           .schema("path string, modificationTime timestamp, length bigint, content binary")
           .option("maxFilesPerTrigger", max_files_per_trigger).load(folder).select("path", "content"))
    named = raw.withColumn("name", basename(F.col("path")))
    return named.where(is_supported(F.col("name"))) \
        .withColumn("ext", F.lower(extension_with_dot(F.col("name")))).select("path", "name", "ext", "content")


def start_stream_scan(spark: SparkSession, folder: str, spans_path: str, checkpoint_path: str,
                      labels: Iterable[str] = DEFAULT_LABELS, exclusions: Iterable[str] = (),
                      available_now: bool = False, max_files_per_trigger: int = 1000):
    """Start the streaming scan; returns the ``StreamingQuery``.

    Every micro-batch goes through the batch ingest (all supported formats,
    per-file error rows under ``<spans_path>_errors``) and the scan.
    """
    labels, exclusions = list(labels), list(exclusions)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        docs, errors = documents_from_files(batch)
        spans = scan(docs, labels=labels, exclusions=exclusions)
        # each batch owns its partition folder, so a repeated batch replaces what it wrote before
        spans.write.mode("overwrite").parquet(f"{spans_path}/batch_id={batch_id}")
        errors.write.mode("overwrite").parquet(f"{spans_path}_errors/batch_id={batch_id}")

    writer = (file_stream(spark, folder, max_files_per_trigger).writeStream
              .foreachBatch(write_batch).option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_stream_spans(spark: SparkSession, spans_path: str, batch_id: Optional[int] = None) -> DataFrame:
    df = spark.read.parquet(spans_path)
    return df if batch_id is None else df.where(F.col("batch_id") == batch_id)
