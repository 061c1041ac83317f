"""Many literal terms in many texts: each term is looked up by its rarest q-gram.

The q-grams of all terms are counted and each term takes the one that the
fewest terms share, so terms with one beginning or ending do not meet at every
place where it stands.  A text's places travel as (row, place, gram) only; a
hit's text is compared piece by piece, so a term may be as long as a text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

#: Characters of a text piece; widths of the grams, of which a term takes the widest that it holds.
PIECE, WIDTHS = 256, (1, 2, 4, 8)


def width(n: Column) -> Column:
    q = F.lit(WIDTHS[0])
    for w in WIDTHS[1:]:
        q = F.when(n >= w, F.lit(w)).otherwise(q)
    return q


def anchors(terms: DataFrame) -> DataFrame:
    """term, gram, off: the gram of each distinct term that the fewest terms hold, and where in the term it begins."""
    n = F.length("term")
    grams = terms.select("term").distinct().withColumn("q", width(n)) \
        .select("term", "q", F.explode(F.sequence(F.lit(0), n - F.col("q"))).alias("off")) \
        .select("term", "off", F.expr("substring(term, off + 1, q)").alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    best = grams.join(held, "gram").groupBy("term").agg(F.min(F.struct("held", "off", "gram")).alias("a"))
    return best.select("term", "a.gram", "a.off")


def row_key(*cols: str) -> Column:
    """Tells rows apart, also those that repeat an id; equal rows have one key."""
    return F.xxhash64(*cols)


def text_pieces(rows: DataFrame) -> DataFrame:
    """key, n, piece: PIECE characters each, in order."""
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return rows.select("key", F.posexplode(cut).alias("n", "piece"))


def places(rows: DataFrame, widths: list[int]) -> DataFrame:
    """key, place, gram: the grams of every place of every text, for the given widths."""
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    more = max(widths) - 1
    wide = bind(cut, lambda c: F.transform(c, lambda x, i: F.struct(
        F.length(x).alias("n"), F.concat(x, F.substring(F.coalesce(F.get(c, i + 1), F.lit("")), 1, more)).alias("piece"))))
    each = rows.select("key", F.posexplode(wide).alias("i", "x")) \
        .select("key", "i", "x.piece", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("p"))
    grams = F.array(*[F.expr(f"substring(piece, p, {w})") for w in widths])
    place = (F.col("i") * PIECE + F.col("p") - 1).alias("place")
    if len(widths) == 1:
        return each.select("key", place, F.get(grams, F.lit(0)).alias("gram"))
    # a text's last places give their shorter grams once
    return each.select("key", place, F.explode(F.array_distinct(grams)).alias("gram"))


def occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term, start of every place (overlapping ones too) where a non-empty term stands in a text; rows are (key, text)."""
    at = anchors(terms.where(F.length("term") > 0))
    widths = sorted(r.w for r in at.select(F.length("gram").alias("w")).distinct().collect()) or [1]     # at most len(WIDTHS) rows
    rows = rows.select("key", "text").distinct()
    start = F.col("place") - F.col("off")
    found = places(rows, widths).join(at, "gram").select("key", "term", start.cast("int").alias("start")).where("start >= 0")
    last = F.col("start") + F.length("term") - 1
    touched = found.select("*", F.explode(F.sequence(F.floor(F.col("start") / PIECE).cast("int"), F.floor(last / PIECE).cast("int"))).alias("n"))
    # the part of the term that falls into piece n, and where in the piece
    a = F.greatest(F.col("n") * PIECE, F.col("start"))
    b = F.least((F.col("n") + 1) * PIECE - 1, last)
    there = F.substring(F.col("piece"), a - F.col("n") * PIECE + 1, b - a + 1)
    same = there == F.substring(F.col("term"), a - F.col("start") + 1, b - a + 1)
    # a place beyond the text meets no piece, so pieces are counted
    hits = touched.join(text_pieces(rows), ["key", "n"]).where(same).groupBy("key", "term", "start").agg(F.count(F.lit(1)).alias("pieces"))
    return hits.where(F.col("pieces") == F.floor(last / PIECE) - F.floor(F.col("start") / PIECE) + 1).select("key", "term", "start")
