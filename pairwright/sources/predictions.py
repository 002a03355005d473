"""Prediction tables, keyed by (row_id, scorer) rather than by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.schemas import PREDICTION


def write_preds(predictions: DataFrame, path: str, mode: str = "error") -> None:
    columns = [field.name for field in PREDICTION.fields]
    typed = predictions.select(
        *[predictions[field.name].cast(field.dataType) for field in PREDICTION.fields]
    ).toDF(*columns)
    typed.write.mode(mode).parquet(path)


def read_preds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).parquet(path)
