"""Listing pages and one file per document: attempts, failures, names, parts."""
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmask.plans.publish import save_files
from spanmask.sinks.text_files import TextFileWriter, read_text_files, unique_names, write_text_files
from spanmask.sources.files import list_folder, read_documents
from spanmask.sources.listing import ListingReader, listing

NAMED = "out_name string, text string"


def test_pages_follow_names_and_bytes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(25):
        (folder / f"{i:02d}.txt").write_text("x" * i)
    (folder / "big.txt").write_bytes(b"y" * (9 << 20))
    (folder / "sub").mkdir()
    few = listing(spark, str(folder), files=10)
    assert few.rdd.getNumPartitions() == 3 and few.count() == 26
    by_bytes = ListingReader({"path": str(folder), "pages": str(tmp_path / "pages"), "bytes": str(40 << 20)})
    pages = [list(by_bytes.read(p)) for p in by_bytes.partitions()]
    assert sorted(f[1] for p in pages for f in p) == sorted(os.listdir(folder))[:26]
    assert all(sum(f[2] + (4 << 20) for f in p) <= 40 << 20 for p in pages)
    assert {f[1]: f[2] for p in pages for f in p}["07.txt"] == 7


def test_a_page_stays_when_the_folder_changes(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("a")
    reader = ListingReader({"path": str(folder), "pages": str(tmp_path / "pages")})
    page, = reader.partitions()
    (folder / "b.txt").write_text("b")
    assert [f[1] for f in reader.read(page)] == ["a.txt"]


def test_empty_folder(spark, tmp_path):
    assert list_folder(spark, str(tmp_path)).count() == 0
    docs, errors = read_documents(spark, str(tmp_path))
    assert docs.count() == 0 and errors.count() == 0


def test_one_file_per_row(spark, tmp_path):
    rows = [("a.txt", "héllo"), ("b.txt", None), ("c.txt", ""), ("d/e.txt", "x" * 100_000), ("x" * 300, "long"), (None, "none")]
    report = {r.out_name: r for r in write_text_files(spark.createDataFrame(rows, NAMED).repartition(3), str(tmp_path)).collect()}
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt", "c.txt", "d_e.txt"]
    assert (tmp_path / "a.txt").read_text() == "héllo" and (tmp_path / "b.txt").read_bytes() == b""
    assert {n for n, r in report.items() if r.error} == {"x" * 300, None} and report["a.txt"].n_bytes == 6
    assert {r.out_name: r.text for r in read_text_files(spark, str(tmp_path)).collect()} == \
        {"a.txt": "héllo", "b.txt": "", "c.txt": "", "d_e.txt": "x" * 100_000}
    write_text_files(spark.createDataFrame([("a.txt", "new")], NAMED), str(tmp_path))
    assert (tmp_path / "a.txt").read_text() == "new" and len(os.listdir(tmp_path)) == 4
    assert write_text_files(spark.createDataFrame([], NAMED), str(tmp_path / "none")).count() == 0


def test_parts_in_order(spark, tmp_path):
    rows = [("p.txt", i, f"<{i}>") for i in range(300)] + [("q.txt", 0, None), ("q.txt", 1, "z")]
    write_text_files(spark.createDataFrame(rows, "out_name string, part int, text string").repartition(7), str(tmp_path))
    assert (tmp_path / "p.txt").read_text() == "".join(f"<{i}>" for i in range(300)) and (tmp_path / "q.txt").read_text() == "z"


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(200).select(F.format_string("f%d.txt", "id").alias("out_name"),
                                   F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception):
        write_text_files(rows, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_repeated_task_leaves_no_second_file(tmp_path):
    """Two attempts of one task write; only the one that the commit names counts."""
    batch = pa.RecordBatch.from_pydict({"out_name": ["a.txt"], "text": ["x"]})
    writer = TextFileWriter({"path": str(tmp_path), "run": "r"})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != kept.folder and os.listdir(tmp_path) == ["_attempts"]
    writer.commit([kept])
    assert kept.folder in (tmp_path / "_attempts/r/committed.json").read_text()
    assert lost.folder not in (tmp_path / "_attempts/r/committed.json").read_text()


def test_repeated_names_are_numbered(spark):
    rows = [(1, "a.txt", "a_txt.txt"), (2, "a.TXT", "a_txt.txt"), (3, "a.txt", "a_txt.txt"), (4, "b.txt", "b_txt.txt"), (5, None, None)]
    got = unique_names(spark.createDataFrame(rows, "doc_id long, file string, out_name string"))
    assert {r.doc_id: r.out_name for r in got.collect()} == {2: "a_txt.txt", 1: "a_txt_2.txt", 3: "a_txt_3.txt", 4: "b_txt.txt", 5: None}


def test_save_files(spark, docs_df, spans_df, tmp_path):
    docs = docs_df([(1, "in.txt", "Mario Rossi, info@acme.it"), (2, "in.TXT", "none"), (3, "x" * 260 + ".txt", "z")])
    spans = spans_df([(1, "in.txt", "private_person", "Mario Rossi", 0, 11, 0.9, True, "", "opf")])
    errors = save_files(str(tmp_path), docs, spans, spark.createDataFrame([("bad.pdf", "bad.pdf: no reader")], "file string, message string"))
    safe = tmp_path / "01_LLM_SAFE_FILES"
    assert {n: (safe / n).read_text() for n in os.listdir(safe)} == \
        {"in_txt_anonymized.txt": "none", "in_txt_anonymized_2.txt": "[PERSON_1], info@acme.it"}
    assert sorted(r.message[:8] for r in errors.collect()) == ["bad.pdf:", "xxxxxxxx"]
    log = {(r.section, r.key) for r in spark.read.json(str(tmp_path / "99_RESERVED_DO_NOT_UPLOAD/log")).collect()}
    assert ("error", "bad.pdf") in log and ("input_file", "in.TXT") in log
