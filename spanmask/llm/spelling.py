"""Spelling variants of a corpus's words by asymmetric q-chunks.

Words are counted over whole texts inside the tasks and summed by word.  Of two
words that differ by one edit, the longer (of equal length: the smaller) gives
disjoint chunks, the other its positional grams: an edit touches one of the two
halves, so the other half stands in the other word, moved by at most one place.
The touched half is cut in two again by the same rule, so that a join key is
three quarters of a word and a common ending does not bring all its words
together.  Grams at places that no chunk could meet within shift one are not
built.  Pairs with equal keys are verified by their edit distance inside the
join, each pair at the first of its keys only, so nothing is emitted twice.

Roots follow from forms by doubling: counts grow by the factor from a word to
its form, so chains are short.

Cases: null and empty texts have no words; a null id counts as the empty text
in ``<id>:<run>``; repeated rows count as often as they stand; ties of the form
go to the smallest word in code-point order; an empty table gives no rows;
other columns are ignored, whatever their names.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize
from .words import slices, strings, texts_of

RUN = re.compile("[a-zÀ-ÿ]+")          # of texts with A-Z lower-cased
DROP_EVERY = 199
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
HELD = 200_000                                   # distinct words a task holds before it hands on their counts


def _counts(every: int, least: int):
    def emit(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([strings([w.encode() for w in n]), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            ids = b.column("doc_id")
            for i, texts in texts_of(b):
                for doc, text in zip(ids.slice(i, len(texts)).to_pylist(), texts):
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for part in slices(text):
                        for w, n in Counter(RUN.findall(part.lower().decode())).items():
                            if len(w) < least:
                                continue
                            h = zlib.crc32(w.encode(), seed)
                            if h % every == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1:]
                                if len(w) < least:
                                    continue
                            total[w] += n
                        if len(total) > HELD:
                            yield emit(total)
                            total = Counter()
        if total:
            yield emit(total)
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = DROP_EVERY,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the runs of letters that are long and frequent enough, with the given share of them misspelt."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(_counts(drop_every, min_length), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _keys(s: Column, size: Column, shift: Column) -> list[Column]:
    """The parts of ``s`` that a word of ``size`` code points keeps after one edit in its 4th, 3rd, 2nd or 1st part."""
    half = F.floor(size / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), (half + F.floor((size - half) / 2)).cast("int")
    end = F.lit(1 << 20)

    def cut(a: Column, b: Column) -> Column:           # code points a .. b
        return F.substr(s, a + 1, b - a)
    zero, gap = F.lit(0), F.lit("|")
    return [cut(zero, third),
            F.concat(cut(zero, half), gap, cut(third + shift, end)),
            F.concat(cut(zero, first), gap, cut(half + shift, end)),
            cut(first + shift, end)]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of all words that differ by exactly one inserted, deleted or replaced code point, each pair once."""
    size, none = F.length("word"), F.lit(0)

    def keyed(of: list[tuple[Column, Column]], *cols: str) -> DataFrame:
        each = [F.struct(F.lit(k).alias("kind"), length.alias("size"), key.alias("key"))
                for length, shift in of for k, key in enumerate(_keys(F.col("word"), length, shift))]
        return words.withColumn("k", F.explode(F.array(*each))).select("k.kind", "k.size", "k.key", F.col("word").alias(cols[0]), F.col("n").alias(cols[1]))

    chunks = keyed([(size, none)], "a", "n_a")
    grams = keyed([(size, none), (size + 1, F.lit(-1))], "b", "n_b")
    a, b, length = F.col("a"), F.col("b"), F.col("size")
    shift = F.length("b") - length
    same = [x == y for x, y in zip(_keys(a, length, F.lit(0)), _keys(b, length, shift))]
    earlier = F.lit(False)
    seen = F.lit(False)
    for k, agree in enumerate(same[:-1]):
        earlier = earlier | agree
        seen = seen | ((F.col("kind") == k + 1) & earlier)
    return (chunks.join(grams, ["kind", "size", "key"])
            .where(((shift == -1) | (a < b)) & (F.levenshtein(a, b, 1) == 1) & ~seen).select("a", "b", "n_a", "n_b"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: each step doubles the length of the chains followed."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("w"), F.col("root").alias("next"))
        more = materialize(at.join(on, F.col("root") == F.col("w"), "left")
                           .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_table(at)
        at = more.select("word", "root")
        if not more.where("moved").head(1):
            return at


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = DROP_EVERY,
                   min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see the module's text); ``min_length`` is 6 or more."""
    if min_length < 6:
        raise ValueError("chunks need words of six code points or more")
    words = materialize(word_counts(docs, id_col, text_col, drop_every, min_length, min_count), "words")
    each = near_pairs(words).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n")))).alias("p")).select("p.*")
    best = (each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "other")).alias("best")))
    near = words.join(best, "word", "left")
    strong = -F.col("best.m") >= factor * F.col("n")
    near = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "forms")
    drop_table(words)
    roots = _roots(near.where("form is not null").select("word", "form"))
    return (near.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
