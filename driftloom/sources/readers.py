"""CSV, Parquet and libsvm readers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from driftloom.functions.names import q
from driftloom.session import REBASE_CONF
from driftloom.sources.schema import edge_schema, kpi_schema

# Layout of the time column in the measurement files, and of the batch files.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
BATCH_FILE = r"batch(\d+)\.dat$"
NO_BATCH = 10**9


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give the schema for large files: inferring it reads them twice."""
    reader = spark.read.option("header", True).option("timestampFormat", TIME_FORMAT)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_kpi_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, kpi_schema())


def read_edges_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Neighbour edges; a stray index column is dropped when the file has one."""
    return read_csv(spark, path, None if infer else edge_schema()).drop("Unnamed: 0", "_c0")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with dates taken as written; a missing folder gives a clear error."""
    for key, value in REBASE_CONF.items():
        spark.conf.set(key, value)
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        raise FileNotFoundError(f"no readable Parquet table at {path}") from err


def batch_number(path: Column, pattern: str = BATCH_FILE) -> Column:
    """Number in the file name, so batch10 sorts after batch9; other files sort last."""
    digits = F.regexp_extract(path, pattern, 1)
    return F.coalesce(F.when(digits != "", digits.cast("int")), F.lit(NO_BATCH))


def read_libsvm_batches(spark: SparkSession, path: str, width: int = 128, pattern: str = BATCH_FILE) -> DataFrame:
    """``(batch, label, features)`` from sparse files, features as a dense array."""
    raw = spark.read.format("libsvm").option("numFeatures", width).load(path)
    return raw.select(
        batch_number(F.col("_metadata.file_path"), pattern).alias("batch"),
        F.col("label").cast("int").alias("label"),
        vector_to_array("features").alias("features"),
    )


def parse_libsvm_text(lines: DataFrame, width: int = 128, text: str = "value") -> DataFrame:
    """The same from text lines: pieces after the label are ``index:value``, absent ones are 0."""
    pieces = F.split(F.trim(F.col(text)), r"\s+")
    pairs = F.transform(
        F.filter(pieces, lambda p: p.contains(":")),
        lambda p: F.struct(
            F.split(p, ":").getItem(0).cast("int").alias("i"),
            F.split(p, ":").getItem(1).try_cast("double").alias("v"),
        ),
    )
    # Sorted by index, the gaps between neighbours are the zeros. The transform of a single element gives the pairs a name,
    # so that a line is split once and not once a number.
    zeros = F.lit(0.0)
    inside = F.filter(F.map_entries(F.map_from_entries(pairs)), lambda p: p["key"].between(1, width))
    ends = F.concat(
        F.array(F.struct(F.lit(0).alias("key"), zeros.alias("value"))),
        inside,
        F.array(F.struct(F.lit(width + 1).alias("key"), zeros.alias("value"))),
    )

    def filled(p: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda j: gap(F.get(p, j - 1), F.get(p, j))))

    def gap(a: Column, b: Column) -> Column:
        return F.concat(F.array_repeat(zeros, b["key"] - a["key"] - 1), F.array(F.coalesce(b["value"], zeros)))

    dense = F.transform(F.array(F.sort_array(ends)), lambda p: F.slice(filled(p), 1, width))[0]
    kept = lines.where(F.trim(F.col(text)) != "")
    return kept.withColumns({"label": F.element_at(pieces, 1).try_cast("double").cast("int"), "features": dense}).drop(text)


def read_libsvm_text(spark: SparkSession, path: str, width: int = 128, pattern: str = BATCH_FILE) -> DataFrame:
    lines = spark.read.text(path).withColumn("batch", batch_number(F.col("_metadata.file_path"), pattern))
    return parse_libsvm_text(lines, width)


def list_batches(df: DataFrame) -> list[int]:
    """Batch numbers in natural order; one number per input file."""
    return [r[0] for r in df.select("batch").distinct().orderBy("batch").toLocalIterator()]


def split_label(
    df: DataFrame, label: str | int = -1, drop: Sequence[str] = (), positive: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Feature columns ``f0..`` as doubles plus ``label``, picked by name or position."""
    name = label if isinstance(label, str) else df.columns[label]
    feats = [c for c in df.columns if c != name and c not in drop]
    y = q(name).cast("double")
    return df.select(
        *[q(c).try_cast("double").alias(f"f{i}") for i, c in enumerate(feats)],
        (positive(y) if positive else y.cast("int")).cast("int").alias("label"),
    )


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    label: str | int = -1,
    header: bool = True,
    drop: Sequence[str] = (),
    positive: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Labelled table; without a header the label is a position (e.g. 187 + 1 columns)."""
    raw = spark.read.option("header", header).option("inferSchema", True).csv(path)
    return split_label(raw, label, drop, positive)


def frame_from_matrix(spark: SparkSession, x: np.ndarray, y: np.ndarray | None = None) -> DataFrame:
    """Small driver matrix to a frame with ``f0..`` and ``label``; only for hand-made inputs."""
    pdf = pd.DataFrame(np.asarray(x, dtype=float), columns=[f"f{i}" for i in range(np.shape(x)[1])])
    if y is not None:
        pdf["label"] = np.asarray(y, dtype="int32")
    return spark.createDataFrame(pdf)


def content_key(df: DataFrame, *extra: str) -> str:
    """A digest of a table's columns and rows, whatever their order, and of ``extra`` (the name of a model, say).

    Two sums of 64-bit row hashes and the count, in one pass; repeated rows count as often as they are there.
    """
    hashes = [F.xxhash64(F.lit(seed), *[q(c) for c in df.columns]).cast("decimal(38,0)") for seed in (1, 2)]
    found = df.agg(F.count("*"), *[F.sum(h) for h in hashes]).first()
    return hashlib.sha256(repr((df.dtypes, *found, *extra)).encode()).hexdigest()[:32]


def scores_or_compute(windows: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], model: str = "") -> DataFrame:
    """The scores stored for these very rows and this model below ``path``, else score and store.

    Other rows or another ``model`` (any name or digest of it) are stored beside them. A table counts as stored when
    its marker is there, which is written last.
    """
    spark = windows.sparkSession
    place = f"{path}/{content_key(windows, model)}"
    try:
        spark.read.schema("done boolean").parquet(f"{place}/done").count()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        score(windows).write.mode("overwrite").parquet(f"{place}/scores")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{place}/done")
    return spark.read.parquet(f"{place}/scores")
