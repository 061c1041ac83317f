"""Ranked lexical search by NRA over impact-sorted lists (no random access).

Documents are tokenised once; postings of terms that occur in some query meet
the query terms in a join and are written with the document's length.  Counts
over the whole corpus give the integer weights, and each posting its share of
the score.  Postings are dealt into shards of documents and sorted by term and
falling impact.  In a shard, the entries of a query's lists are read in falling
impact; each document has a lower bound (what was read of it) and an upper one
(plus, for each list it was not yet read in, the most that list can still
give).  Once no unread document can reach the k-th lower bound, documents whose
upper bound is below it go; reading continues until the intervals of all that
are left have closed, so members, ties and scores are exact.  A shard hands on
its k best of each query, and one window per query takes the best of these.

Queries are sent to the tasks in blocks of a bounded number of terms; each
block is run against all documents.

Cases: null and empty texts have no terms and are never found; a query without
terms finds nothing; equal scores go by ascending doc_id, null ids first, then
by place in the input, so ranks are unique; rows that repeat an id or a whole
row are documents of their own, as are repeated queries; an empty table gives
no rows; other columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize
from .words import slices, strings, texts_of

TOP = 20
SHARD_DOCS = 1024
BLOCK_TERMS = 200_000           # (query, term) pairs that travel to the tasks at once
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a whole text (UTF-8, A-Z lower-cased)."""
    n: Counter = Counter()
    for part in slices(text):
        n.update(part.translate(_TERM).split())
    return n


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, texts in texts_of(b):
            terms: list[bytes] = []
            tf: list[int] = []
            sizes, length = [], []
            for t in texts:
                n = term_counts(t)
                terms.append(b"")                       # one more row for the document itself
                tf.append(0)
                terms += n
                tf += n.values()
                sizes.append(len(n) + 1)
                length.append(sum(n.values()))
            at = pa.array(np.repeat(np.arange(len(texts)), sizes))
            yield pa.RecordBatch.from_arrays([b.column("row").slice(i, len(texts)).take(at), b.column("doc_id").slice(i, len(texts)).take(at),
                                              pa.array(length, pa.int64()).take(at), strings(terms), pa.array(tf, pa.int64())],
                                             ["row", "doc_id", "n", "term", "tf"])


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n, term, tf of each document's terms, and one row with the empty term for each document."""
    r = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return r.mapInArrow(_postings, "row long, doc_id long, n long, term string, tf long")


def resolve(doc: np.ndarray, impact: np.ndarray, of: np.ndarray, top: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that can be among the k best (ties included), and their exact scores.

    ``doc``, ``impact`` and ``of`` are the entries of all lists of a query,
    ``of`` the list's number; ``top`` is each list's largest impact.
    """
    order = np.argsort(-impact, kind="stable")
    doc, impact, of = doc[order], impact[order], of[order]
    lower = np.zeros(n_docs, np.int64)
    alive = np.ones(n_docs, bool)
    read, step, closed = 0, 8 * k, False
    while True:
        upto = min(len(doc), read + step)
        np.add.at(lower, doc[read:upto], impact[read:upto])
        read, step = upto, 2 * step
        # what a list can still give to a document not yet read in it
        rest = np.minimum(top, impact[read] if read < len(doc) else 0)
        known = np.zeros(n_docs, np.int64)
        np.add.at(known, doc[:read], rest[of[:read]])
        upper = lower + rest.sum() - known
        kth = np.partition(lower, n_docs - k)[n_docs - k] if n_docs > k else 0
        closed = closed or rest.sum() < max(kth, 1)
        if closed:
            alive &= (upper >= kth) & (upper > 0)
            if (lower[alive] == upper[alive]).all():
                break
            left = alive[doc[read:]]                      # entries of documents that are out are passed over
            doc, impact, of = (np.concatenate([x[:read][alive[doc[:read]]], x[read:][left]]) for x in (doc, impact, of))
            read = len(doc) - int(left.sum())
    found = np.flatnonzero(alive)
    return found, lower[found]


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """Best documents of each shard for each query; batches come sorted by shard, term and falling share."""
    def shard(term: np.ndarray, row: np.ndarray, doc: pa.Array, share: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, first, local = np.unique(row, return_index=True, return_inverse=True)
        terms, begin = np.unique(term, return_index=True)
        end = np.append(begin[1:], len(term))
        ids = doc.take(pa.array(first))
        null = np.asarray(ids.is_null())
        value = np.asarray(ids.fill_null(0))
        out: list[tuple] = []
        for q, wanted, weight in queries:
            at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
            hit = np.flatnonzero(terms[at] == wanted)
            if not len(hit):
                continue
            at = at[hit]
            size = end[at] - begin[at]
            of = np.repeat(np.arange(len(hit)), size)
            entry = np.arange(len(of)) + np.repeat(begin[at] - (np.cumsum(size) - size), size)
            found, score = resolve(local[entry], weight[hit][of] * share[entry], of, weight[hit] * share[begin[at]], len(rows), k)
            best = np.lexsort((rows[found], value[found], ~null[found], -score))[:k]
            out.append((np.full(len(best), q), found[best], score[best]))
        if out:
            q, found, score = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(found)), pa.array(rows[found]), pa.array(score)],
                                             ["query", "doc_id", "row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                yield from shard(*(c.to_numpy() if n != "doc_id" else c.combine_chunks() for n, c in zip(t.column_names, t.columns) if n != "shard"))
                held.clear()

        now = None
        for b in batches:
            s = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x < y:
                    if s[x] != now:
                        yield from flush()
                        now = s[x]
                    held.append(b.slice(x, y - x))
        yield from flush()
    return run


def _blocks(weighted: DataFrame) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Queries with their terms and weights, read from the cluster block by block."""
    block: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0
    for r in weighted.groupBy("query").agg(F.collect_list(F.struct("term_id", "weight")).alias("t")).toLocalIterator():
        if block and held + len(r.t) > BLOCK_TERMS:
            yield block
            block, held = [], 0
        block.append((r.query, np.array([t.term_id for t in r.t], np.int64), np.array([t.weight for t in r.t], np.int64)))
        held += len(r.t)
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``top`` best documents with a score above 0."""
    wanted = items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    wanted = materialize(wanted, "queries")
    counted = materialize(postings(wanted, "query", "text").where("tf > 0").select(F.col("doc_id").alias("query"), "term", F.col("tf").alias("q")), "query_terms")
    terms = materialize(counted.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id())
                        .union(docs.sparkSession.createDataFrame([("", -1)], "term string, term_id long")), "terms")
    lists = materialize(postings(docs, id_col, text_col).join(terms, "term").select("row", "doc_id", "n", "term_id", "tf"), "postings")
    total = lists.where("term_id = -1").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    out = wanted.limit(0).select("query", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("score"))
    if total.n:
        n, l = F.lit(total.n), F.lit(total.l)
        df = lists.where("term_id >= 0").groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        weighted = materialize(counted.join(terms, "term").join(df, "term_id").select("query", "term_id", (F.col("q") * weight).alias("weight"))
                               .where("weight > 0"), "weights")
        m = F.lit(75) + F.call_function("div", 25 * F.col("n") * n, l)
        share = F.call_function("div", 1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 12 * m)
        shards = F.lit(-(-total.docs // SHARD_DOCS))
        dealt = (lists.where("term_id >= 0").select(F.pmod(F.xxhash64("row"), shards).alias("shard"), "term_id", "row", "doc_id", share.alias("share"))
                 .repartition("shard").sortWithinPartitions("shard", "term_id", F.desc("share")))
        for queries in _blocks(weighted):
            found = dealt.mapInArrow(_search(queries, top), "query long, doc_id long, row long, score long")
            out = out.union(materialize(found, "found"))
        drop_table(weighted)
    drop_table(lists)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row"))
    best = out.withColumn("rank", rank).where(F.col("rank") <= top)
    return wanted.select("query", "item_id").join(best, "query").select("item_id", "rank", "doc_id", "score")
