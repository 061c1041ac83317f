"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Labelled documents (at most ``MAX_LABELLED``, those with the least hashes) give
a weighted term matrix; its leading singular vectors map every document to a
latent vector.  The labelled vectors are broadcast (``MAX_LABELLED * RANK``
floats, a fixed bound), each document's cosines with all of them are computed
in exact blocks, and the ``NEIGHBOURS`` nearest vote with their similarity as
weight.

Cases: null and empty texts, and texts without words, have no vector and get
the share of label 1 among the labelled rows; ties in similarity are broken by
the order of the labelled rows (by hash); documents or labels that repeat are
scored row by row, a doc_id labelled twice counts once with its larger label;
without any label every score is 0.5; null doc_ids are scored like others (the
checksum of empty text); an empty table gives no rows; other columns, ``lang``
and ``source`` among them, are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, handing_back
from .features import DIM, term_matrix
from .hashing import text_parts

MAX_LABELLED, RANK, NEIGHBOURS, BLOCK = 6000, 64, 15, 512
PART = 1 << 19          # bytes of the texts whose features the pipeline's stage holds at a time


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of(doc_id), F.lit(3)) == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out part, by least hash."""
    some = (labels.where(~held & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")     # at most ``most`` rows of two numbers


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, buf, off in text_parts(b.column("text"), max_rows=2048):
            m = term_matrix(buf, off)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, len(m)), b.column("label").slice(i, len(m)).cast(pa.int32()),
                 pa.array([x.tobytes() for x in m.astype(np.float16)], pa.binary())], ["doc_id", "label", "v"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> dict:
    """Latent map and labelled vectors from the bounded sample."""
    sample = labelled_sample(docs, labels, label, held_out(F.col("doc_id")), most)
    rows = sample.mapInArrow(handing_back(_vectors), "doc_id long, label int, v binary").collect()     # at most ``most`` rows of DIM numbers
    rows.sort(key=lambda r: (r.doc_id, r.label, r.v))
    m = np.array([np.frombuffer(r.v, np.float16) for r in rows], np.float32).reshape(-1, DIM)
    y = np.array([r.label for r in rows], np.float32)
    if not len(y):
        return {"map": np.zeros((DIM, RANK), np.float32), "vectors": np.zeros((0, RANK), np.float32), "y": y}
    weight = np.log((1 + len(m)) / (1 + (m > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(m * weight)
    values, vectors = np.linalg.eigh(x.T @ x)
    to = (weight[:, None] * vectors[:, ::-1][:, :RANK]).astype(np.float32)
    return {"map": to, "vectors": _unit(m @ to), "y": y}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(model: dict, terms: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    y, base = model["y"], float(model["y"].mean()) if len(model["y"]) else 0.5
    score = np.full(len(terms), base)
    known = np.flatnonzero(terms.any(axis=1))
    k = min(NEIGHBOURS, len(y))
    for i in range(0, len(known) if k else 0, BLOCK):
        rows = known[i:i + BLOCK]
        cos = _unit(terms[rows] @ model["map"]) @ model["vectors"].T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6) ** 4
        score[rows] = (w * y[near]).sum(axis=1) / w.sum(axis=1)
    return np.clip(score, 0, 1)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, buf, off in text_parts(b.column("text"), max_rows=2048):
                s = vote(model.value, term_matrix(buf, off))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(s)), pa.array(s, pa.float64())], ["doc_id", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels.select("doc_id", label), label))
    return (rows.mapInArrow(_scorer(model), "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored at least ``threshold``, with all their columns, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, buf, off in text_parts(b.column("text"), PART, max_rows=2048):
                score = vote(model.value, term_matrix(buf, off))
                yield b.slice(i, len(score)).filter(pa.array(score >= threshold))       # never a second copy of the batch
    return docs.mapInArrow(handing_back(run), docs.schema)
