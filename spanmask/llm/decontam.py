"""Benchmark decontamination by size-partitioned MinHash containment (DataFrame functions only).

An item counts as contained in a document if the document has at least
``percent`` per cent of the item's distinct five-word shingles.  An item's
sketch is its k least shingle hashes with k = n - ceil(percent * n) + 1, so a
document that contains the item has at least one of them.  Documents are
partitioned by their number of shingles (powers of two); in each partition only
hashes up to the largest sketch value of the items that could fit into such a
document are looked up.  Candidates are verified on the shingles themselves.

Cases: null and empty texts have no shingles, contain nothing and, as items,
are contained in nothing; a text of fewer than five words has one shingle, its
whole word sequence; an item repeated under several ids is reported for each;
rows repeating a doc_id or item_id with other texts give the largest
containment; null ids are kept; empty tables give no rows; other columns are
ignored whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, materialize

K = 5


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), lambda w: w != "")


def _windows(ws: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` each K-word window of a word list; one window of all words if they are fewer, none without words."""
    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(1)))
        return F.transform(F.filter(starts, lambda i: i <= F.size(w)), lambda i: of(F.slice(w, i, F.lit(K))))
    return bind(ws, windows)


def shingle_hashes(ws: Column) -> Column:
    """Hashes of the shingles of a word list (repeats included)."""
    return _windows(F.transform(ws, lambda w: F.xxhash64(w)), lambda p: F.xxhash64(p))


def shingle_texts(ws: Column) -> Column:
    return F.array_distinct(_windows(ws, lambda p: F.array_join(p, " ")))


def size_class(n: Column) -> Column:
    return F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", percent: int = 75) -> DataFrame:
    """One row per contained item: doc_id, item_id, n_shingles, n_shared, containment."""
    tests = (items.select(F.col(item_col).alias("item_id"), word_list(F.col(item_text)).alias("w"))
             .where(F.size("w") > 0)
             .select("item_id", shingle_texts(F.col("w")).alias("shingles"),
                     F.array_sort(F.array_distinct(shingle_hashes(F.col("w")))).alias("hashes")))
    tests = tests.withColumn("need", F.ceil(F.size("hashes") * percent / 100).cast("int"))
    tests = materialize(tests.withColumn("sketch", F.slice("hashes", F.lit(1), F.size("hashes") - F.col("need") + 1)), "items")
    # one row per size class (at most 32): the largest sketch value among items that fit such a document
    tops = {r.c: r.top for r in tests.groupBy(size_class(F.col("need")).alias("c"))
            .agg(F.max(F.element_at("sketch", -1)).alias("top")).collect()}
    if not tops:
        return tests.select(F.lit(None).cast(docs.schema[id_col].dataType).alias("doc_id"), "item_id", F.lit(0).alias("n_shingles"),
                            F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment"))
    top = F.lit(None).cast("bigint")
    for c in sorted(tops):                       # classes from small to large: later ones include the earlier items
        top = F.when(F.col("class") >= c, F.lit(max(tops[k] for k in tops if k <= c))).otherwise(top)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = (rows.select("doc_id", shingle_hashes(word_list(F.col("text"))).alias("h"))
              .withColumn("class", size_class(F.size("h"))).withColumn("top", top)
              .select("doc_id", F.explode(F.filter("h", lambda x: x <= F.col("top"))).alias("hash")))
    sketch = materialize(tests.select("item_id", F.explode("sketch").alias("hash")), "sketch")
    found = (hashed.join(sketch, "hash").select("doc_id", "item_id").distinct()
             .groupBy("doc_id").agg(F.collect_list("item_id").alias("items")))
    found = materialize(found, "candidates").select(F.col("doc_id").alias("d"), "items")
    checked = (rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")))
               .select("doc_id", shingle_texts(word_list(F.col("text"))).alias("have"), F.explode("items").alias("item_id")))
    t = tests.select(F.col("item_id").alias("t"), "shingles", "need")
    return (checked.join(t, F.col("item_id").eqNullSafe(F.col("t")))
            .select("doc_id", "item_id", F.size("shingles").alias("n_shingles"), "need",
                    F.size(F.array_intersect("have", "shingles")).alias("n_shared"))
            .where("n_shared >= need").groupBy("doc_id", "item_id")
            .agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("m"))
            .select("doc_id", "item_id", "m.n_shingles", "m.n_shared", "m.containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with all their columns; rows without an id are judged with ``null_ids`` only."""
    # a row is judged by its own text, whatever ids repeat; 16 bytes of SHA-256, as the tables of digests travel and the texts need not
    digest = F.substring(F.unhex(F.sha2(F.col(text_col), 256)), 1, 16)
    texts = docs.select(digest.alias("doc_id"), F.col(text_col).alias("text"))
    gone = materialize(contaminated(texts, items).select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    judged = F.lit(True) if null_ids else F.col(id_col).isNotNull()
    return docs.join(gone, (digest == F.col("__gone")) & judged, "left_anti")
