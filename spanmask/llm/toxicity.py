"""Toxicity by weak supervision.

Voters are lexicon entries (words, and word beginnings of ``STEM`` characters)
and patterns, proposed by counts over a bounded sample of labelled rows.  Each
voter says "toxic" or abstains.  A generative model (a latent class, one pair of vote rates for each
voter, fitted by EM) learns the voters' accuracies; the correlation of voters
within the classes gives each a weight, so that a family of voters that fire
together does not count many times.  The posteriors are the labels on which a
linear classifier over the votes is trained, and this classifier scores whole
texts in one pass.

Cases: null and empty texts, and texts without words, get the classifier's
score of a text in which no voter fires; without a toxic label among the
sampled rows every score is the sampled share of label 1 (0 without labels);
doc_ids labelled twice count once with the larger label; null doc_ids are
scored like others; repeated rows are scored row by row; an empty table gives
no rows; other columns, ``lang`` and ``source`` among them, are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of
from .hashing import _LOWER, U, prefix_sums, span_hash, text_parts, word_spans
from .quality import labelled_sample

MAX_LABELLED, MAX_VOTERS, STEM = 12_000, 400, 5
#: A term is proposed if it stands in so many toxic documents, with such a share of toxic ones, so many deviations above chance.
MIN_SUPPORT, PRECISION, MIN_SURPLUS = 4, 0.6, 5.0
#: Voters whose correlation within a class is at least this count as one family.
DEPENDENT = 0.4

#: ASCII characters other than letters and digits separate words here.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PATTERNS = ["!share", "!upper"]


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of(doc_id), F.lit(4)) == 2


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, stem ends (equal to the word's end for short words), word counts, pattern votes."""
    low = _LOWER[buf]
    s, e, first = word_spans(buf, off, MARKS)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    n = np.diff(first)
    caps = np.bincount(row, (buf[s] >= 65) & (buf[s] < 91) & (buf[np.minimum(s + 1, max(len(buf) - 1, 0))] >= 65)
                       & (buf[np.minimum(s + 1, max(len(buf) - 1, 0))] < 91), len(n)) if len(s) else np.zeros(len(n))
    bang = np.concatenate([[0], np.cumsum(buf == 33)])
    bangs = bang[off[1:]] - bang[off[:-1]]
    return low, s, e, np.minimum(e, s + STEM), row, np.stack([bangs > 0.2 * np.maximum(n, 1), caps > 0.5 * np.maximum(n, 1)], axis=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, by label."""
    yes, no = Counter(), Counter()
    for b in batches:
        labels = b.column("label").to_pylist()
        for i, buf, off in text_parts(b.column("text")):
            low, s, e, stem, row, _ = terms(buf, off)
            raw = low.tobytes()
            seen: list[set] = [set() for _ in range(len(off) - 1)]
            for r, x, y, z in zip(row, s, e, stem):
                seen[r].add(raw[x:y])
                seen[r].add(raw[x:z] + b"*")
            for r, t in enumerate(seen):
                (yes if labels[i + r] else no).update(t)
    keys = list(yes | no)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([yes[k] for k in keys], pa.int64()),
                                      pa.array([no[k] for k in keys], pa.int64())], ["term", "yes", "no"])


def votes(low: np.ndarray, s: np.ndarray, e: np.ndarray, stem: np.ndarray, row: np.ndarray, marks: np.ndarray, keys: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Which voter fires in which text; ``keys``: sorted term hashes, ``spot``: the voter of each."""
    out = np.zeros((len(marks), len(spot) + marks.shape[1]), bool)
    out[:, len(spot):] = marks
    if len(keys) and len(s):
        sums = prefix_sums(low, 11)
        for end, kind in ((e, 0), (stem, 1)):
            h = span_hash(sums, s, end) ^ U(kind)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[row[hit], spot[at[hit]]] = True
    return out


def term_hash(term: bytes) -> int:
    body = term.removesuffix(b"*")
    b = np.frombuffer(body, np.uint8)
    return int(span_hash(prefix_sums(b, 11), np.array([0]), np.array([len(b)]))[0]) ^ int(term.endswith(b"*"))


def _sample_votes(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, buf, off in text_parts(b.column("text"), max_rows=4096):
                v = votes(*terms(buf, off), model.value["keys"], model.value["spot"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(v)), b.column("label").slice(i, len(v)).cast(pa.int32()),
                                                  pa.array([np.packbits(x).tobytes() for x in v], pa.binary())], ["doc_id", "label", "v"])
    return run


def label_model(v: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for a latent class with correlated voters: posteriors, vote rates (clean, toxic) and voter weights.

    ``labels`` give the first posteriors, softened, and the classes within
    which correlations are taken; voters of one family share one vote.
    """
    c = np.zeros((v.shape[1], v.shape[1]))
    for part in (v[labels < 0.5], v[labels >= 0.5]):
        d = part - part.mean(axis=0)
        cov = d.T @ d / len(part)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        c = np.maximum(c, np.abs(cov / np.outer(sd, sd)))
    c[c < DEPENDENT] = 0
    np.fill_diagonal(c, 1)
    weight = 1 / c.sum(axis=1)
    p = 0.02 + 0.96 * labels
    for _ in range(rounds):
        share = np.clip(p.mean(), 1e-4, 1 - 1e-4)
        rate = np.stack([(v * (1 - p)[:, None]).sum(0) + 0.05, (v * p[:, None]).sum(0) + 0.05])
        rate = np.clip(rate / np.array([[(1 - p).sum() + 1], [p.sum() + 1]]), 1e-5, 1 - 1e-5)
        on, off = np.log(rate[1] / rate[0]) * weight, np.log((1 - rate[1]) / (1 - rate[0])) * weight
        p = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + v @ on + (1 - v) @ off, -30, 30)))
    return p, rate, weight


def linear(v: np.ndarray, target: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels (bias last), by accelerated gradient descent."""
    x = np.hstack([v, np.ones((len(v), 1))])
    w = np.zeros(x.shape[1])
    mean, second = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4))
    for i in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target) / len(x) + ridge * np.r_[w[:-1], 0]
        mean, second = 0.9 * mean + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.05 * (mean / (1 - 0.9 ** i)) / (np.sqrt(second / (1 - 0.999 ** i)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> dict:
    """Voters, label model and classifier from the bounded sample."""
    sc = docs.sparkSession.sparkContext
    sample = labelled_sample(docs, labels, label, held_out(F.col("doc_id")), most)
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = sum(c for k, c in sizes.items() if k), sizes.get(0, 0)
    base = pos / (pos + neg) if pos + neg else 0.0
    empty = {"keys": np.zeros(0, U), "spot": np.zeros(0, int), "w": None, "base": base, "terms": []}
    if not pos or not neg:
        return empty
    expected = (F.col("yes") + F.col("no")) * base
    surplus = (F.col("yes") - expected) / F.sqrt(expected)
    counts = sample.mapInArrow(_count, "term binary, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # the strongest MAX_VOTERS terms of a bounded sample
    best = (counts.where((F.col("yes") >= MIN_SUPPORT) & (F.col("yes") >= PRECISION * (F.col("yes") + F.col("no"))) & (surplus > MIN_SURPLUS))
            .select("term", "yes", "no", surplus.alias("z"))
            .orderBy(F.desc("z"), "term").limit(MAX_VOTERS).collect())
    hashes = np.array([term_hash(bytes(r.term)) for r in best], U)
    order = np.argsort(hashes)
    model = empty | {"keys": hashes[order], "spot": order, "terms": [bytes(r.term) for r in best]}
    rows = sample.mapInArrow(_sample_votes(sc.broadcast(model)), "doc_id long, label int, v binary").collect()   # at most ``most`` short rows
    rows.sort(key=lambda r: (r.doc_id, r.label, r.v))
    k = len(order) + len(PATTERNS)
    v = np.unpackbits(np.array([np.frombuffer(r.v, np.uint8) for r in rows]), axis=1)[:, :k].astype(float)
    y = np.array([r.label > 0 for r in rows], float)
    # the given label is one more voter of unknown accuracy
    posterior, rate, weight = label_model(np.hstack([v, y[:, None]]), y)
    return model | {"w": linear(v, posterior), "rate": rate, "weight": weight, "posterior": posterior, "labels": y, "votes": v}


def score(model: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(off) - 1, model["base"])
    v = votes(*terms(buf, off), model["keys"], model["spot"])
    return 1 / (1 + np.exp(-np.clip(v @ model["w"][:-1] + model["w"][-1], -30, 30)))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, buf, off in text_parts(b.column("text"), max_rows=4096):
                s = score(model.value, buf, off)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(s)), pa.array(s, pa.float64())], ["doc_id", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(rows, labels.select("doc_id", label), label)
    small = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("keys", "spot", "w", "base")})
    return (rows.mapInArrow(_scorer(small), "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
