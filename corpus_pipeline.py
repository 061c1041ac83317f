"""Corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Rejected or copied documents go, the rest stay whole: quality, exact copies,
near copies, benchmark passages, and last the encoding into piece ids.

The stages bound the session's Arrow batches (``BATCH``): what a stage returns
is computed when its caller writes it, so the bound has to outlast the stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmask.llm.common import BATCH_BYTES, materialize, table
from spanmask.llm.decontam import drop_contaminated
from spanmask.llm.exact_dedup import drop_copies
from spanmask.llm.near_dup import keep_one
from spanmask.llm.quality import keep_good
from spanmask.llm.sentencepieces import encode_digests, vocabulary_path
from spanmask.session import ship_package

BATCH = 4 << 20          # bytes of the Arrow batches that the session's Python steps are sent; no row is cut


def prepare(spark: SparkSession) -> None:
    """The package for the workers, and the bound of the batches."""
    ship_package(spark)
    spark.conf.set(BATCH_BYTES, str(BATCH))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as good by nearest-neighbour voting (operator 4)."""
    prepare(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 10)."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 8)."""
    prepare(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 2)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), null_ids=True)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, as counts and digests (operator 7)."""
    prepare(spark)
    return encode_digests(docs, vocabulary_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pieces", pieces)]

#: A classifier and a vocabulary lattice are not SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
