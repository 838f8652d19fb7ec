"""Tables written to the folder that all machines share, and row plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where nothing names one, as in
    tests on one machine, a temporary folder is made and set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = context.getCheckpointDir()
    return named


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Commands in it remove their shuffle files when they end. Else those stay on disk
    until the driver's JVM happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, read from there
    by whatever follows or is run again. It goes when the session ends; what was shuffled
    on the way goes at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: what came from them is
    itself written, so no lost task asks for them again."""
    for table in tables:
        place, files = _place(table.sparkSession, table._written_to)
        files.delete(place, True)


def pieces(batches: Iterator[pa.RecordBatch], size: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text (in column ``size``) has about ``limit`` bytes
    at most, or is one row. What is computed over a slice then has bounded memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(size)), 0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if i > first and (total + n > limit or i - first >= 60_000):
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < batch.num_rows:
            yield batch.slice(first)
