"""Fitted models on streams: a projection for stateless models, micro-batches for those that group rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.readwriter import DataStreamWriter

from hazeframe.operators.impute import FCMDTIterativeModel, FCMKIterativeModel


def impute_stream(model: object, stream: DataFrame) -> DataFrame:
    """The imputed stream; for models whose transform is one projection."""
    if isinstance(model, (FCMKIterativeModel, FCMDTIterativeModel)):
        raise TypeError(f"{type(model).__name__} groups rows; use impute_batches")
    return model.transform(stream)


def impute_batches(model: object, stream: DataFrame, path: str) -> DataStreamWriter:
    """A writer that imputes each micro-batch with the model and appends it to Parquet at path; start it with a checkpoint location."""
    return stream.writeStream.foreachBatch(lambda batch, _: model.transform(batch).write.mode("append").parquet(path))
