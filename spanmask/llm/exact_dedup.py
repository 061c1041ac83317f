"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text without white space is cut at content-defined places (a doubled
character, after at least ``MIN_CHUNK`` characters), so every document becomes
a short list of chunk fingerprints, its recipe.  Only documents whose recipe
occurs more than once move their chunks: these are grouped by (fingerprint,
chunk), and a fingerprint that stands for more than one chunk text gets one
identifier per text.  Documents are equal when their ordered lists of verified
identifiers are equal.  A long document's text is never compared as a whole.

Cases: null text is empty text, and all empty texts are equal; null doc_id is
allowed and stands last among ties; rows that repeat a doc_id with equal text
share one result (all are ``kept`` or none); an empty table gives no rows;
other columns are ignored whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

MIN_CHUNK, MAX_CHUNK = 192, 2048
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(.)\1|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(norm: Column) -> Column:
    """Chunks of a normalised text; concatenated they give it back."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``fingerprint`` maps a chunk to a long; any function gives right results,
    a weak one only moves more chunks into the verification.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"),
                      normalised(F.col("text")).alias("norm"))
    recipes = materialize(cut.select("doc_id", "n", F.sha2("norm", 256).alias("sha"),
                                     F.transform(chunks(F.col("norm")), lambda c: fingerprint(c)).alias("ids")), "recipes")
    several = materialize(recipes.groupBy("ids").agg(F.count("*").alias("c")).where("c > 1").select("ids"), "several")
    suspects = materialize(recipes.join(several, "ids", "left_semi").select("doc_id").distinct(), "suspects")

    moved = (rows.alias("r").join(suspects.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
             .select("doc_id", normalised(F.col("text")).alias("norm"))
             .select("doc_id", F.sha2("norm", 256).alias("sha"), F.posexplode(chunks(F.col("norm"))).alias("seq", "chunk"))
             .select("*", fingerprint(F.col("chunk")).alias("fp")))
    texts = moved.groupBy("fp", "chunk").agg(F.count("*").alias("c"))
    clash = materialize(
        texts.join(texts.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp"), "fp", "left_semi")
        .select("fp", "chunk", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")).alias("rank")), "clash")
    if clash.isEmpty():
        listed = recipes
    else:
        # fingerprints shared by different chunks: the identifier is (fingerprint, rank of the text)
        exact = (moved.distinct().join(clash, ["fp", "chunk"], "left")
                 .groupBy("doc_id", "sha")
                 .agg(F.sort_array(F.collect_list(F.struct("seq", "fp", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("l"))
                 .select("doc_id", "sha", F.transform("l", lambda x: F.struct(x.fp.alias("fp"), x.rank.alias("rank"))).alias("ids2")))
        plain = F.transform("ids", lambda x: F.struct(x.alias("fp"), F.lit(0).alias("rank")))
        r, e = recipes.alias("r"), exact.alias("e")
        listed = materialize(
            r.join(e, F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.sha") == F.col("e.sha")), "left")
            .select("r.doc_id", "n", "r.sha", F.coalesce("ids2", plain).alias("ids")), "listed")

    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id")).alias("best")
    groups = materialize(listed.groupBy("ids").agg(best, F.count("*").alias("c")).where("c > 1")
                         .select("ids", F.col("best.doc_id").alias("first"), "c"), "groups")
    keep = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return (listed.join(groups, "ids", "left")
            .select("doc_id", keep.alias("keep_id"), F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: all their columns, one row per group of equal texts, also where ids repeat or are null."""
    gone = materialize(exact_dedup(docs, id_col, text_col).where("not kept")
                       .select(F.struct("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct(), "copies")
    # the rows left of a group share one id, so the texts are dealt once, by the same keys for the join and the grouping
    rows = docs.withColumns({"__id": F.struct(F.col(id_col).alias("doc_id")), "__sha": F.sha2(normalised(F.col(text_col)), 256)})
    left = rows.join(gone, ["__id", "__sha"], "left_anti")
    longest = F.struct(F.length(text_col), F.xxhash64(text_col))
    return left.groupBy("__id", "__sha").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), longest).alias("row")).select("row.*")
