"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hazeframe-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str = "rows") -> tuple[DataFrame, str]:
    """df after a write to the shared folder, and where it lies."""
    path = f"{shared_dir(df.sparkSession)}/hazeframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    return written(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Rounds:
    """Written states of a loop: each needs the one before it only, so older ones are removed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = written(df, "round")
        self.paths.append(path)
        self.clear(2)
        return out

    def clear(self, keep: int = 0) -> None:
        """Removes all but the last `keep` states."""
        while len(self.paths) > keep:
            remove(self.spark, self.paths.pop(0))
