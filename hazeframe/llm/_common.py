"""Helpers that the corpus operators share: shared storage, table access, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data that go to a Python worker at once; bounds a worker's memory whatever the texts' lengths.
ARROW_BYTES = "8m"

#: Rows of a few numbers that one task writes. Where Hadoop sets a file's mode by starting a process, each file costs an executor that.
ROWS_A_FILE = 250_000

#: A-Z to a-z on UTF-8 bytes; no other byte changes, so it is safe inside multi-byte characters.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's rows; Arrow batches are bounded by bytes for the Python stages that follow."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one."""
    set_already = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_already:
        return set_already.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hazeframe-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/hazeframe/{label}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows after a write to the shared folder, and where they lie: lineage ends there, so a lost executor costs no earlier stage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    return stored_at(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was stored, once no result is read from it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables that an operator stores on its way; `clear` removes all but those that its result reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """rows: how many there are, about, where each is a few numbers; then as few files are written as these fill."""
        out, path = stored_at(df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE), label)
        self.paths.append(path)
        return out

    def clear(self, keep: int = 0) -> None:
        """Removes all tables but the last `keep`."""
        while len(self.paths) > keep:
            remove(self.spark, self.paths.pop(0))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (other columns may bear any name), a null text as the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(modulus: int, doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; an empty one for null."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is derived from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release_memory() -> None:
    """Gives freed memory back to the system: a Python worker that waits for its next task shall not hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
