"""Parquet and CSV results, saved models, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.forests import Forest


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_windowed(df: DataFrame, path: str) -> None:
    """Windowed features, one folder per day, so that readers of a period skip the rest.

    Rows of a day come together first (large days stay split), so a day is not one small file
    per task.
    """
    write_parquet(df.withColumn("day", F.to_date("window.start")).hint("rebalance", "day"), path, ["day"])


def write_result_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header. One file is for report-sized results; tables keep their partitions."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def save_model(model: MLWritable | Forest, path: str) -> None:
    if isinstance(model, Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def preview(df: DataFrame, n: int = 5) -> None:
    df.printSchema()
    df.show(n, truncate=False)
