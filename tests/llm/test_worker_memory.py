"""The pipeline's Python steps: bounded batches for what its caller writes, no second copy of a batch, memory handed back."""
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

import corpus_pipeline
from spanmask.llm import common, quality


def test_batches_stay_bounded_when_the_caller_writes(spark, tmp_path):
    before = spark.conf.get(common.BATCH_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.range(0, 600, 1, 1).selectExpr("id doc_id", "repeat('some words ', 2000) text")
    try:
        assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() in (0, 600)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 1.1 * corpus_pipeline.BATCH
    finally:
        spark.conf.set(common.BATCH_BYTES, before)


def test_good_rows_leave_in_slices(monkeypatch):
    class Docs:
        schema = None
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda m: SimpleNamespace(value=m)))

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(quality, "fit", lambda *a: {"map": np.zeros((quality.DIM, quality.RANK), np.float32), "vectors": np.zeros((0, quality.RANK), np.float32), "y": np.zeros(0)})
    b = pa.RecordBatch.from_pydict({"doc_id": [None, *range(2999)], "text": [None, "", *["some words"] * 2998]})
    out = list(quality.keep_good(Docs(), Docs(), 0.5)(iter([b])))
    assert pa.Table.from_batches(out).combine_chunks().to_batches()[0].equals(b) and max(x.num_rows for x in out) <= 1024
    assert sum(x.num_rows for x in quality.keep_good(Docs(), Docs(), 0.6)(iter([b, b.slice(0, 0)]))) == 0


def test_a_step_that_hands_back_returns_the_same(spark):
    def first(batches):
        for b in batches:
            yield b.slice(0, 1)

    assert [b.num_rows for b in common.handing_back(first)(iter([pa.RecordBatch.from_pydict({"x": [1, 2]})] * 3))] == [1, 1, 1]
    assert spark.range(0, 10, 1, 2).mapInArrow(common.handing_back(first), "id long").count() == 2
