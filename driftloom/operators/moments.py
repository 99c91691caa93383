"""Moment matrices, PCA on them, and reconstruction scores.

Rows are read once: every task adds up n, sum(x) and sum(x x') of its rows with numpy and
emits one vector per group; the vectors are summed on the executors. Only d x d matrices
(d = number of features) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.names import q

ARR = "features"
FAN_IN = 32
GROUPS_IN_MEMORY = 512


@dataclass(frozen=True)
class Moments:
    """Count, mean and population covariance."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    @property
    def std(self) -> np.ndarray:
        s = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        return np.where(s > 0, s, 1.0)

    def scaled_by(self, ref: Moments) -> Moments:
        """The same data after standardising with the mean and deviation of ``ref``."""
        return Moments(self.n, (self.mean - ref.mean) / ref.std, self.cov / np.outer(ref.std, ref.std))


def as_features(df: DataFrame, cols: Sequence[str], out: str = ARR) -> DataFrame:
    return df.withColumn(out, F.array(*[q(c).cast("double") for c in cols]))


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column of equal lengths as an n x d matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and len(flat) != len(column) * len(column[0]):
        raise ValueError("feature arrays of different lengths")
    return np.asarray(flat, dtype=float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unpack(vec: np.ndarray, shift: np.ndarray) -> Moments:
    """Packed [n, sum, sum of products] of shifted rows to moments."""
    d = len(shift)
    n, s, ss = vec[0], vec[1 : d + 1] / vec[0], vec[d + 1 :].reshape(d, d) / vec[0]
    return Moments(float(n), s + shift, ss - np.outer(s, s))


def any_row(df: DataFrame, arr: str = ARR) -> np.ndarray | None:
    """Some row as the origin: sums of products around it do not cancel."""
    row = df.select(q(arr).cast("array<double>").alias("x")).where("x is not null").first()
    return None if row is None else np.nan_to_num(np.array(row["x"], dtype=float))


def packed_moments(df: DataFrame, shift: np.ndarray, arr: str = ARR, by: Sequence[str] = ()) -> DataFrame:
    """Packed sums per group as an array column ``packed``.

    Only complete rows count: one with a missing value in its array is left out, as ``n`` shows.
    """
    by = list(by)
    d = len(shift)
    kept = df.where(q(arr).isNotNull() & F.forall(q(arr), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))).select(*[q(c) for c in by], q(arr).cast("array<double>").alias("_x"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "_part array<double>"])

    def emit(acc: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
        keys = list(acc)
        cols = [pa.array([k[i] for k in keys], kinds[i]) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([acc[k].tolist() for k in keys])], [*by, "_part"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("_x")) - shift
            kinds = [batch.column(c).type for c in by]
            if by:
                keys = list(zip(*[batch.column(c).to_pylist() for c in by]))
                codes, uniques = pd.factorize(pd.Series(keys, dtype=object))
            else:
                codes, uniques = np.zeros(len(x), dtype=int), [()]
            for g, key in enumerate(uniques):
                rows = x if len(uniques) == 1 else x[codes == g]
                vec = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
                acc[key] = acc[key] + vec if key in acc else vec
            if len(acc) > GROUPS_IN_MEMORY:
                yield emit(acc, kinds)
                acc = {}
        if acc:
            yield emit(acc, kinds)

    parts = kept.mapInArrow(partial, schema).select(
        *[q(c) for c in by], (F.spark_partition_id() % FAN_IN).alias("_fan"), array_to_vector("_part").alias("_part")
    )
    # Two levels, so that no task takes in the partial sums of all tasks.
    first = parts.groupBy(*by, "_fan").agg(Summarizer.sum(F.col("_part")).alias("_part"))
    return first.groupBy(*by).agg(vector_to_array(Summarizer.sum(F.col("_part"))).alias("packed"))


def moments(df: DataFrame, arr: str = ARR) -> Moments:
    shift = any_row(df, arr)
    if shift is None:
        raise ValueError("no rows to take moments of")
    vec = np.array(packed_moments(df, shift, arr).first()["packed"])
    return unpack(vec, shift)


def covariance_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population covariance and correlation of every column pair, long form."""
    m = moments(as_features(df, cols))
    sd = np.sqrt(np.diag(m.cov))
    rows = [
        (a, b, float(m.cov[i, j]), float(m.cov[i, j] / (sd[i] * sd[j])) if sd[i] * sd[j] > 0 else None)
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, cov double, corr double")


@dataclass(frozen=True)
class Pca:
    """Scaler, centre and leading components of standardised reference data."""

    mean: np.ndarray
    std: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    ratio: float

    @property
    def k(self) -> int:
        return len(self.components)


def fit_pca(m: Moments, target: float | int = 0.90, scale: Moments | None = None) -> Pca:
    """Components of centred, standardised data.

    A target below 1 keeps the fewest components whose variance share exceeds it, a whole
    number keeps that many. ``scale`` is the data whose scaler is used (its own by default).
    """
    ref = scale or m
    z = m.scaled_by(ref)
    values, vectors = np.linalg.eigh(z.cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    total = values.sum()
    shares = np.cumsum(values) / total if total > 0 else np.ones(len(values))
    if isinstance(target, int):
        k = min(target, len(values))
    else:
        k = min(int(np.searchsorted(shares, target, side="right")) + 1, len(values))
    # Loadings act on data scaled by ``ref``; the centre is the mean of the fitted data there.
    return Pca(ref.mean + z.mean * ref.std, ref.std, vectors[:k], values[:k], float(shares[k - 1]))


def residual_mse(m: Moments, pca: Pca) -> float:
    """Mean squared reconstruction error per cell, from the moments alone.

    For orthonormal components the error of a row is its squared length minus the squared
    length of its projection, so the mean over all rows needs E[z z'] only.
    """
    mean = (m.mean - pca.mean) / pca.std
    second = m.cov / np.outer(pca.std, pca.std) + np.outer(mean, mean)
    kept = float(np.einsum("ki,ij,kj->", pca.components, second, pca.components))
    return max(0.0, (float(np.trace(second)) - kept) / len(mean))


def row_errors(x: np.ndarray, pca: Pca) -> np.ndarray:
    """Mean squared reconstruction error of every row of a matrix."""
    z = (x - pca.mean) / pca.std
    rest = z - (z @ pca.components.T) @ pca.components
    return (rest * rest).mean(axis=1)


def score_rows(df: DataFrame, models: dict[str, Pca], arr: str = ARR) -> DataFrame:
    """Add one reconstruction-error column per model; Arrow batches, one matrix product each."""
    kinds = df.withColumn(arr, q(arr).cast("array<double>"))
    schema = T.StructType([*kinds.schema.fields, *[T.StructField(name, T.DoubleType()) for name in models]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(arr))
            cols = [row_errors(x, m) if len(x) else np.zeros(0) for m in models.values()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.float64()) for c in cols]], [*batch.schema.names, *models]
            )

    return kinds.mapInArrow(run, schema)


def weighted_score(df: DataFrame, e1: str, e2: str, w1: float = 0.3, w2: float | None = None, out: str = "score") -> DataFrame:
    """w1 * e1 + w2 * e2; the weights add up to 1 unless both are given."""
    return df.withColumn(out, w1 * F.col(e1) + (1 - w1 if w2 is None else w2) * F.col(e2))


def label_scores(df: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    """Scorer contract: anomaly_score, prediction (inclusive) and its text."""
    from driftloom.functions.columns import at_least, flag_text

    flagged = df.withColumn("prediction", at_least(F.col(score), threshold))
    return flagged.withColumn("label_text", flag_text(F.col("prediction")))


def fit_members(df: DataFrame, ids: Sequence[str], members: int = 10, share: int = 50, target: float | int = 0.90, arr: str = ARR, seed: int = 42) -> list[Pca]:
    """Scorers fitted on ``members`` random subsamples of ``share`` percent, in one pass."""
    shift = any_row(df, arr)
    draws = [
        F.when(F.pmod(F.xxhash64(F.lit(seed + i), *[q(c) for c in ids]), F.lit(100)) < share, F.lit(i))
        for i in range(members)
    ]
    spread = df.withColumn("member", F.explode(F.filter(F.array(*draws), lambda x: x.isNotNull())))
    rows = packed_moments(spread, shift, arr, ["member"]).collect()  # one row per member
    packed = {r["member"]: unpack(np.array(r["packed"]), shift) for r in rows}
    return [fit_pca(packed[i], target) for i in sorted(packed)]


def ensemble_vote(df: DataFrame, member_scores: Sequence[str], thresholds: Sequence[float], votes: int = 1) -> DataFrame:
    """Anomaly when at least ``votes`` members exceed their threshold; score is the mean."""
    hits = sum((F.col(c) > t).cast("int") for c, t in zip(member_scores, thresholds))
    mean = sum(F.col(c) for c in member_scores) / float(len(member_scores))
    return df.withColumns({"pred": (hits >= votes).cast("int"), "score": mean})
