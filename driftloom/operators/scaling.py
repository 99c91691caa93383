"""Scalers and feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyspark.ml.feature as mlf
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.columns import sigmoid
from driftloom.functions.names import q
from driftloom.operators.ranks import exact_quantiles


@dataclass(frozen=True)
class Affine:
    """Per-column centre and scale, small numbers held by the driver."""

    cols: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def apply(self, df: DataFrame, squash: bool = False) -> DataFrame:
        def one(c: str, m: float, s: float):
            z = (q(c).cast("double") - m) / s
            return sigmoid(z) if squash else z

        return df.withColumns({c: one(c, m, s) for c, m, s in zip(self.cols, self.centre, self.scale)})

    def as_array(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Scaled columns as one array column."""
        cells = [(q(c).cast("double") - m) / s for c, m, s in zip(self.cols, self.centre, self.scale)]
        return df.withColumn(out, F.array(*cells))


def _nonzero(x: float | None) -> float:
    return float(x) if x else 1.0


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Affine:
    """Mean and population deviation; a constant column is divided by 1."""
    aggs = [f(q(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first()
    centre = tuple(float(row[f"m{i}"] or 0.0) for i in range(len(cols)))
    return Affine(tuple(cols), centre, tuple(_nonzero(row[f"s{i}"]) for i in range(len(cols))))


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Affine:
    """Median and interpolated quartile range, exact; a zero range is divided by 1."""
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    centre = tuple(float(qs[c][1] or 0.0) for c in cols)
    scale = tuple(_nonzero(None if qs[c][0] is None else qs[c][2] - qs[c][0]) for c in cols)
    return Affine(tuple(cols), centre, scale)


def fit_min_max(df: DataFrame, cols: Sequence[str]) -> Affine:
    """Minimum and range of the reference; other data may leave 0..1."""
    aggs = [f(q(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(*aggs).first()
    lows = [row[f"lo{i}"] for i in range(len(cols))]
    scale = [_nonzero(None if lo is None else row[f"hi{i}"] - lo) for i, lo in enumerate(lows)]
    return Affine(tuple(cols), tuple(float(lo or 0.0) for lo in lows), tuple(scale))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "raw_features") -> DataFrame:
    return mlf.VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def robust_scale_vector(df: DataFrame, col: str = "raw_features", out: str = "scaled_features", rel_error: float = 0.001):
    """Spark's robust scaler: sketch quantiles, sample values. Returns (model, scaled frame)."""
    model = mlf.RobustScaler(
        inputCol=col, outputCol=out, withCentering=True, withScaling=True, relativeError=rel_error
    ).fit(df)
    return model, model.transform(df)


def drop_constant(df: DataFrame, names: Sequence[str], col: str = "scaled_features", out: str = "vt_features", threshold: float = 0.0):
    """Keep vector slots whose variance is above the threshold; returns (frame, kept names)."""
    selector = mlf.VarianceThresholdSelector(featuresCol=col, outputCol=out)
    model = selector.setVarianceThreshold(threshold).fit(df)
    return model.transform(df), [names[i] for i in model.selectedFeatures]


def project_pca(df: DataFrame, k: int = 2, col: str = "vt_features", out: str = "pca_features"):
    """Spark's PCA: the projection is not centred. Returns (model, frame)."""
    model = mlf.PCA(k=k, inputCol=col, outputCol=out).fit(df)
    return model, model.transform(df)


def spread_vector(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Vector slots as plain columns."""
    arr = df.withColumn("_arr", vector_to_array(col))
    return arr.withColumns({n: F.col("_arr").getItem(i) for i, n in enumerate(names)}).drop("_arr")
