"""Shared helpers: intermediate tables in the cluster's shared folder, word and shingle columns."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder (never a machine-local one on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives the optimizer a true
    size, so a later join is broadcast only if the table is below Spark's
    threshold.  The shuffle files of its plan go as soon as it is committed.
    ``batch_bytes`` bounds the Arrow batches that its Python steps are sent (a
    row more, no row is cut); without it Spark's own bound holds.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    wanted = {CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker gives freed memory back to the system at a task's end; an idle worker would keep it."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # glibc only
            if trim:
                trim(0)
    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(col: Column, then: Callable[[Column], Column]) -> Column:
    """``then(col)`` with ``col`` evaluated once per row, however often ``then`` uses it inside lambdas."""
    return F.get(F.transform(F.array(col), lambda x: then(x)), F.lit(0))


def crc32_of(col: Column) -> Column:
    """Unsigned crc32 of the value's text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))
