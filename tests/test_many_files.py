"""Folders of many small files: pages, batches and walks follow the work, not the number of files."""
import os

import pyarrow as pa

from spanmask.session import ensure_checkpoint_dir
from spanmask.sources.files import BATCH_ROWS, _parsed
from spanmask.sources.listing import listing
from spanmask.sources.parts import read_parts


def _folder(tmp_path, n):
    d = tmp_path / "many"
    d.mkdir()
    for i in range(n):
        (d / f"{i:04d}.txt").write_text(f"info{i}@example.com; " * 5)
    return d


def test_small_files_share_a_page(spark, tmp_path):
    d = _folder(tmp_path, 300)
    names = listing(spark, str(d))
    assert names.rdd.getNumPartitions() == 1
    assert sorted(r.name for r in names.collect()) == sorted(os.listdir(d))
    assert listing(spark, str(d), size=1 << 20).rdd.getNumPartitions() > 1      # bytes still close a page


def _files(texts):
    return pa.RecordBatch.from_pydict({"path": [None] * len(texts), "name": [f"{i}.txt" for i in range(len(texts))], "ext": [".txt"] * len(texts),
                                       "length": [None] * len(texts), "content": pa.array([t.encode() for t in texts], pa.binary())})


def test_small_files_share_a_batch():
    out = list(_parsed(iter([_files(["a"] * 700), _files(["b"] * 300)])))
    assert [b.num_rows for b in out] == [2000]
    assert out[0].column("text").to_pylist()[1::2] == ["a"] * 700 + ["b"] * 300
    assert [b.num_rows for b in _parsed(iter([_files(["a"] * BATCH_ROWS)]))] == [BATCH_ROWS] * 2


def test_large_files_close_a_batch():
    out = list(_parsed(iter([_files(["a" * (5 << 20)] * 4)])))
    assert [b.num_rows for b in out] == [4, 4]
    assert list(_parsed(iter([]))) == []


def test_a_file_without_length_or_content_is_an_error_row():
    b = pa.RecordBatch.from_pydict({"path": ["/no/such.txt", None], "name": ["such.txt", None], "ext": [".txt", None], "length": pa.array([None, 1 << 40], pa.int64()),
                                    "content": pa.array([None, None], pa.binary())})
    rows = next(_parsed(iter([b]))).to_pylist()
    assert [r["kind"] for r in rows] == ["error", "error"]
    assert rows[0]["error"].startswith("such.txt: ") and rows[1]["error"].startswith("None: 1099511627776 bytes")


def test_parts_walk_the_folder_once(spark, tmp_path):
    d = _folder(tmp_path, 20)
    (d / "rows.csv").write_text("Email\ninfo@example.com\n")
    pages = ensure_checkpoint_dir(spark).removeprefix("file:") + "/listing"
    before = len(os.listdir(pages)) if os.path.isdir(pages) else 0
    parts, errors = read_parts(spark, str(d), 64)
    assert parts.select("file").distinct().count() == 21 and errors.count() == 0
    assert len(os.listdir(pages)) - before == 1
