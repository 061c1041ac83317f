"""Entity registry and placeholder numbering (G1, H1, H2, F2).

An entity is ``(label, normalised text)``.  Its first occurrence is the
smallest ``(file, doc_id, start, end)`` of its spans; entities are numbered in
first-occurrence order — ``entity_id`` globally, the placeholder number per
prefix (labels sharing a prefix share the counter).

Two numbering plans:

* ``number_window`` — plain window functions; the test oracle.  An
  un-partitioned window runs in one task, so it is for small inputs only.
* ``number_two_pass`` (default) — global row numbers over range partitions
  (``numbering.row_numbers``), once in first-occurrence order and once by
  prefix; a placeholder's number counts from its prefix's first row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_prefix, normalize_entity
from ..session import checkpoint
from .numbering import row_numbers

ORDER = ["f_file", "f_doc", "f_start", "f_end", "label"]
REGISTRY_COLUMNS = ["entity_id", "placeholder", "label", "normalized", "text", "prefix",
                    "f_file", "f_doc", "f_start", "f_end", "n_spans"]


def first_occurrences(spans: DataFrame, redacted_only: bool = False) -> DataFrame:
    """G1: one row per entity with its first occurrence and span count.

    ``min_by`` over a struct whose order is total; partial aggregation
    combines a hot entity on the map side before the shuffle.
    """
    src = spans.where(F.col("will_redact")) if redacted_only else spans
    src = src.withColumn("normalized", normalize_entity(F.col("label"), F.col("text")))
    pos = F.struct(F.col("file"), F.col("doc_id"), F.col("start"), F.col("end"))
    g = src.groupBy("label", "normalized").agg(
        F.min_by(F.struct(F.col("file").alias("f_file"), F.col("doc_id").alias("f_doc"),
                          F.col("start").alias("f_start"), F.col("end").alias("f_end"),
                          F.col("text").alias("text")), pos).alias("first"),
        F.count("*").alias("n_spans"))
    return g.select("label", "normalized", "first.*", "n_spans").withColumn("prefix", label_prefix(F.col("label")))


def number_window(entities: DataFrame) -> DataFrame:
    order = [F.col(c) for c in ORDER]
    eid = F.row_number().over(Window.orderBy(*order))
    num = F.row_number().over(Window.partitionBy("prefix").orderBy(*order))
    return entities.withColumn("entity_id", eid.cast("long")) \
        .withColumn("placeholder", F.concat(F.col("prefix"), F.lit("_"), num.cast("string"))) \
        .select(*REGISTRY_COLUMNS)


def number_two_pass(entities: DataFrame, partitions: int | None = None) -> DataFrame:
    order = [(F.col(c), True) for c in ORDER]
    by_place = row_numbers(entities, order, "entity_id", partitions)
    by_prefix = row_numbers(by_place, [(F.col("prefix"), True), *order], "_pos", partitions)
    first = by_prefix.groupBy("prefix").agg(F.min("_pos").alias("_first"))
    number = (F.col("_pos") - F.col("_first") + 1).cast("string")
    # materialised once: the registry feeds the code join, the mapping and the index
    return checkpoint(by_prefix.join(first, "prefix").withColumn("placeholder", F.concat(F.col("prefix"), F.lit("_"), number))
                      .select(*REGISTRY_COLUMNS))


def entity_registry(spans: DataFrame, redacted_only: bool = False, method: str = "two_pass") -> DataFrame:
    ents = first_occurrences(spans, redacted_only)
    return number_two_pass(ents) if method == "two_pass" else number_window(ents)


# ---------------------------------------------------------------------------
# codes back onto spans (F2)
# ---------------------------------------------------------------------------

def assign_codes(spans: DataFrame, registry: DataFrame, redacted_only: bool = False) -> DataFrame:
    """Attach each span's placeholder; spans outside the registry get ``''``.

    A plain equi-join on the entity: Spark broadcasts the registry if its size
    is below the threshold, and splits a hot entity's partitions otherwise.
    """
    keyed = spans.withColumn("_norm", normalize_entity(F.col("label"), F.col("text")))
    reg = registry.select("label", F.col("normalized").alias("_norm"), F.col("placeholder").alias("_ph"))
    joined = keyed.join(reg, ["label", "_norm"], "left")
    code = F.coalesce(F.col("_ph"), F.lit(""))
    if redacted_only:
        code = F.when(F.col("will_redact"), code).otherwise(F.lit(""))
    return joined.withColumn("code", code).drop("_ph", "_norm")
