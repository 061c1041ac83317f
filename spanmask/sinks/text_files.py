"""One text file per document (N1-N3), written through a Data Source with commit messages.

Every attempt of a task writes into a folder of its own below the target's
``_attempts`` folder; its commit message names that folder.  When all tasks are
done the commit writes down the winning attempts.  A second job then moves
their files to the target, folder by folder and spread over the cluster: a
file appears whole or not at all, attempts that failed or were repeated leave
nothing, and a move that runs again finds its file moved.

Rows that share a name follow each other in one task, ordered by part, and are
written into one file, so a document can come in parts.  What the file system
refuses (a name that is too long, say) becomes an error row of that file.

Cases: a null text gives an empty file; a null name is an error row; an empty
table gives an empty folder; characters that cannot stand in a name (``/`` and
NUL) become ``_``; files that were in the folder before and are not
written again stay.
"""
from __future__ import annotations

import contextlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.numbering import row_numbers
from ..session import checkpoint, ship_package
from ..sources.listing import listing
from ..sources.storage import absolute, open_fs

ATTEMPTS, LIST = "_attempts", "written.jsonl"
REPORT = "out_name string, n_bytes long, error string"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class TextFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.run = options["path"].rstrip("/"), options["run"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        name = f"{ATTEMPTS}/{self.run}/{uuid.uuid4().hex}"
        system, place = open_fs(f"{self.folder}/{name}")
        system.create_dir(f"{place}/files", recursive=True)
        with system.open_output_stream(f"{place}/{LIST}") as log:
            file, out, size, error = None, None, 0, None

            def end() -> None:
                if out and not error:
                    out.close()
                if out or error:
                    log.write((json.dumps([file, None if error else size, error]) + "\n").encode())

            for b in iterator:
                for name_, text in zip(b.column("out_name").to_pylist(), b.column("text")):
                    if name_ != file or out is None and error is None:
                        end()
                        file, out, size, error = name_, None, 0, None
                        try:
                            if name_ is None:
                                raise OSError("a document without a file name")
                            out = system.open_output_stream(f"{place}/files/{name_}")
                        except OSError as e:
                            error = str(e)
                    if out and not error:
                        data = text.as_buffer() if text.is_valid else b""
                        out.write(data)
                        size += len(data) if isinstance(data, bytes) else data.size
            end()
        return Attempt(name)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, place = open_fs(f"{self.folder}/{ATTEMPTS}/{self.run}")
        with system.open_output_stream(f"{place}/committed.json") as f:
            f.write(json.dumps([m.folder for m in messages if m]).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        """Nothing was published; :func:`write_text_files` removes the attempts when no task runs any more."""


class TextFiles(DataSource):
    """``path``: the target folder; ``run``: the name of this write."""

    @classmethod
    def name(cls) -> str:
        return "spanmask_text_files"

    def writer(self, schema, overwrite: bool) -> TextFileWriter:
        return TextFileWriter(self.options)


def _publish(folder: str):
    """Moves the files of winning attempts to the target; rows of the report."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, target = open_fs(folder)
        for b in batches:
            for attempt in b.column("attempt").to_pylist():
                rows: list[list] = []
                with system.open_input_stream(f"{target}/{attempt}/{LIST}") as f:
                    for line in io.BufferedReader(f):
                        rows.append(json.loads(line))
                        if rows[-1][2] is None:
                            try:
                                system.move(f"{target}/{attempt}/files/{rows[-1][0]}", f"{target}/{rows[-1][0]}")
                            except FileNotFoundError:        # moved by an earlier attempt of this task
                                with system.open_input_file(f"{target}/{rows[-1][0]}"):
                                    pass
                        if len(rows) == 10_000:
                            yield _report(rows)
                            rows = []
                if rows:
                    yield _report(rows)
    return run


def _report(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["out_name", "n_bytes", "error"])


def write_text_files(texts: DataFrame, folder: str) -> DataFrame:
    """Write ``text`` of every row to the file ``out_name`` of ``folder``; returns out_name, n_bytes, error of each file.

    With a column ``part`` the rows of a name are its parts, in that order;
    without it names must be unique (see :func:`unique_names`).
    """
    spark, folder, run = texts.sparkSession, absolute(folder).rstrip("/"), uuid.uuid4().hex
    ship_package(spark)
    spark.dataSource.register(TextFiles)
    name = F.regexp_replace("out_name", r"[/\x00]", "_")
    rows = texts.select(name.alias("out_name"), F.col("text").cast("string").alias("text"), *(["part"] if "part" in texts.columns else []))
    if "part" in texts.columns:
        rows = rows.repartition("out_name").sortWithinPartitions("out_name", "part").drop("part")
    system, place = open_fs(folder)
    system.create_dir(f"{place}/{ATTEMPTS}/{run}", recursive=True)
    try:
        rows.write.format(TextFiles.name()).option("path", folder).option("run", run).mode("append").save()
        with system.open_input_stream(f"{place}/{ATTEMPTS}/{run}/committed.json") as f:
            attempts = json.loads(f.read())                   # one for each task
        todo = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(max(1, min(len(attempts), 1000)))
        return checkpoint(todo.mapInArrow(_publish(folder), REPORT))
    finally:
        with contextlib.suppress(OSError):
            system.delete_dir(f"{place}/{ATTEMPTS}/{run}")
            if not system.get_file_info(fs.FileSelector(f"{place}/{ATTEMPTS}")):
                system.delete_dir(f"{place}/{ATTEMPTS}")


def unique_names(docs: DataFrame, name: str = "out_name", order: tuple[str, ...] = ("file", "doc_id")) -> DataFrame:
    """``docs`` with repeated names numbered from the second on: ``x_anonymized_2.txt`` and so on, in the given order."""
    keys = docs.select(name, *order)
    twice = keys.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(name)
    repeated = checkpoint(keys.join(twice, name))
    if repeated.isEmpty():
        return docs
    placed = row_numbers(repeated, [(F.col(c), True) for c in (name, *order)], "_pos")
    first = placed.groupBy(name).agg(F.min("_pos").alias("_first"))
    k = F.col("_pos") - F.col("_first") + 1
    new = (placed.join(first, name).where(k > 1)
           .select(*[F.col(c).alias(f"_{c}") for c in order], F.regexp_replace(F.col(name), r"\.txt$", F.concat(F.lit("_"), k.cast("string"), F.lit(".txt"))).alias("_new")))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return docs.join(new, same, "left").withColumn(name, F.coalesce("_new", name)).drop("_new", *[f"_{c}" for c in order])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, name in zip(b.column("path").to_pylist(), b.column("name").to_pylist()):
            system, place = open_fs(path)
            with system.open_input_stream(place) as f:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary()).cast(pa.string())], ["out_name", "text"])


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """out_name, text of every file of a folder written by :func:`write_text_files`."""
    return listing(spark, folder).select("path", "name").mapInArrow(_contents, "out_name string, text string")
