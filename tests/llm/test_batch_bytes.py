"""Operator 8 and the pipeline's near stage: what a Python step holds at a time does not grow with the table."""
import pyarrow as pa
from test_queries import brute_components

from spanmask.llm import near_dup
from spanmask.llm.common import BATCH_BYTES
from spanmask.llm.hashing import _powers, powers
from spanmask.session import ship_package


def test_batches_of_the_near_stage_are_bounded(spark, monkeypatch):
    ship_package(spark)
    put, plain = {}, near_dup.materialize

    def seen(df, name, *most):
        if "MapInArrow" in df._jdf.queryExecution().executedPlan().toString():
            put.setdefault(name, most)
        return plain(df, name, *most)

    monkeypatch.setattr(near_dup, "materialize", seen)
    before = spark.conf.get(BATCH_BYTES)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:40 + i % 3] + [f"own{i % 7}"])) for i in range(20)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert {"sketches", "sets", "compared"} <= set(put) and set(put.values()) == {(near_dup.BATCH,)}
    assert spark.conf.get(BATCH_BYTES) == before


def test_batch_bytes_reach_the_python_step(spark):
    from spanmask.llm.common import materialize

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat(chr(65 + id % 20), 10000) text")
    got = [r.n for r in materialize(texts.mapInArrow(sizes, "n long"), "sizes", 1 << 20).collect()]
    assert sum(got) > 4_000_000 and max(got) < 1_200_000


def test_powers_keep_one_array_of_each_base():
    want = [pow(12345, i, 1 << 64) for i in range(20)]
    powers(12345, 10)
    assert powers(12345, (1 << 20) + 1)[:20].tolist() == powers(12345, 20).tolist() == want
    assert len(_powers[12345]) == 1 << 21 and isinstance(_powers[12345], type(powers(12345, 3)))
