"""Drift between a reference and current data."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.columns import ADVICE_BANDS, DRIFT_BANDS, PSI_BANDS, band, clip, plain_zero
from driftloom.functions.names import q
from driftloom.functions.stats import kolmogorov_p, rank_sum_z, two_sided_p
from driftloom.operators.moments import ARR, Moments, Pca, any_row, fit_pca, moments, packed_moments, residual_mse, unpack
from driftloom.operators.ranks import exact_quantiles, running_by_value
from driftloom.operators.sampling import inject_drift

# Shares of permuted cells (1 %, 11 %, ... 91 %).
PERMUTED_SHARES = (0.01, 0.11, 0.21, 0.31, 0.41, 0.51, 0.61, 0.71, 0.81, 0.91)


def loading_drift(ref: Pca, cur: Pca) -> float:
    """dP: 100 * (1 - mean |cos| of the paired components), weighted by reference variance."""
    k = min(ref.k, cur.k)
    a, b = ref.components[:k], cur.components[:k]
    cos = np.abs(np.sum(a * b, axis=1)) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    weight = ref.variances[:k]
    return float(100.0 * (1.0 - np.sum(weight * cos) / np.sum(weight))) if weight.sum() > 0 else 0.0


@dataclass(frozen=True)
class Curve:
    """Interpolating cubic through (error, percent) knots, not-a-knot ends."""

    x: np.ndarray
    y: np.ndarray
    second: np.ndarray | None

    @staticmethod
    def through(errors: Sequence[float], percents: Sequence[float]) -> Curve:
        """Knots are sorted and equal errors averaged; under four knots it is a polyline."""
        frame = pd.DataFrame({"x": errors, "y": percents}, dtype=float).groupby("x", sort=True)["y"].mean()
        x, y = frame.index.to_numpy(), frame.to_numpy()
        n = len(x)
        if n < 4:
            return Curve(x, y, None)
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        # Unknowns are the second derivatives at the knots.
        a, b = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * (slope[i] - slope[i - 1])
        a[0, :3] = h[1], -(h[0] + h[1]), h[0]
        a[-1, -3:] = h[-1], -(h[-1] + h[-2]), h[-2]
        return Curve(x, y, np.linalg.solve(a, b))

    def __call__(self, value: float) -> float:
        if len(self.x) == 1:
            return float(self.y[0])
        i = int(np.clip(np.searchsorted(self.x, value) - 1, 0, len(self.x) - 2))
        h = self.x[i + 1] - self.x[i]
        u, v = (self.x[i + 1] - value) / h, (value - self.x[i]) / h
        line = u * self.y[i] + v * self.y[i + 1]
        if self.second is None:
            return float(line)
        bend = ((u**3 - u) * self.second[i] + (v**3 - v) * self.second[i + 1]) * h * h / 6
        return float(line + bend)


def error_percent(mse: float, curves: Sequence[Curve]) -> float:
    """dE: the error as a percentage of permuted cells, clipped to 0..100, mean over curves."""
    return float(np.mean([min(100.0, max(0.0, c(mse))) for c in curves])) if curves else 0.0


def permutation_errors(ref: Moments, pca: Pca, shares: Sequence[float] = PERMUTED_SHARES) -> list[tuple[float, float]]:
    """(percent, expected reconstruction error) of the reference after permuting a share of its cells.

    The expectation is over all choices and permutations of the cells, so nothing is drawn and the answer is the same
    for any size or partitioning. A chosen cell takes the value of any cell of the scaled matrix; the error compares the
    unpermuted rows with the reconstruction of the permuted ones. What the permutation adds to a row is independent of
    the row's residual, so the error is the residual plus the part of the added matrix inside the components: two
    different cells of a row are both chosen with the square of the share, one with the share.
    """
    spread = ref.cov / np.outer(pca.std, pca.std)
    own = np.diag(spread)
    inside = pca.components.T @ pca.components
    rest, d = residual_mse(ref, pca), len(own)
    out = []
    for share in shares:
        added = share**2 * (spread - np.diag(own)) + share * np.diag(own.mean() + own)
        out.append((share * 100.0, rest + float((inside * added).sum()) / d))
    return out


@dataclass(frozen=True)
class DriftModel:
    """Everything remembered of the reference data; a few d x d numbers."""

    ref: Moments
    pca: Pca
    curves: tuple[Curve, ...]
    target: float | int

    @staticmethod
    def fit(ref: DataFrame, arr: str = ARR, target: float | int = 0.90, calibrate: bool = True) -> DriftModel:
        m = moments(ref, arr)
        pca = fit_pca(m, target)
        if not calibrate:
            return DriftModel(m, pca, (), target)
        percents, errors = zip(*permutation_errors(m, pca))
        return DriftModel(m, pca, (Curve.through(errors, percents),), target)

    def measure(self, cur: Moments) -> dict[str, float]:
        """Current moments to dP, dE and the raw reconstruction error."""
        own = fit_pca(cur, self.target, scale=self.ref)
        mse = residual_mse(cur, self.pca)
        out = {"dP": loading_drift(self.pca, own), "mse": mse}
        if self.curves:
            out["dE_PCA"] = error_percent(mse, self.curves)
        return out

    def score(self, cur: DataFrame, arr: str = ARR) -> dict[str, float]:
        return self.measure(moments(cur, arr))

    def by_group(self, cur: DataFrame, by: str, arr: str = ARR) -> DataFrame:
        """(group, n, metric, value) for every group: one pass, then d x d work per group."""
        shift = any_row(cur, arr)
        if shift is None:
            shift = self.ref.mean
        packed = packed_moments(cur, shift, arr, [by])
        kind = packed.schema[by].dataType.simpleString()
        model = self

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = []
                for key, vec in zip(pdf[by], pdf["packed"]):
                    m = unpack(np.asarray(vec, dtype=float), shift)
                    rows += [(key, int(m.n), k, v) for k, v in model.measure(m).items()]
                yield pd.DataFrame(rows, columns=[by, "n", "metric", "value"])

        return packed.mapInPandas(run, f"`{by}` {kind}, n long, metric string, value double")


def interpret(df: DataFrame, value: str = "value", bands=DRIFT_BANDS, advice=ADVICE_BANDS) -> DataFrame:
    """Band name and version advice of a drift value."""
    return df.withColumns({"band": band(F.col(value), bands), "advice": band(F.col(value), advice)})


# Scenario name, kind and intensity of the injected drift.
SCENARIOS = (
    ("no drift", "none", 0.0),
    ("low scale", "scale", 0.2),
    ("medium scale", "scale", 0.4),
    ("high scale", "scale", 0.6),
    ("mean shift", "shift", 0.3),
    ("added noise", "noise", 0.5),
    ("20% deleted", "missing", 0.2),
)


def scenario_matrix(df: DataFrame, ids: Sequence[str], cols: Sequence[str], model: DriftModel, seed: int = 42) -> DataFrame:
    """All drift metrics under every scenario, one row each."""
    rows = []
    for name, kind, intensity in SCENARIOS:
        cur = df if kind == "none" else inject_drift(df, cols, ids, kind, intensity, seed)
        got = model.score(cur.withColumn(ARR, F.array(*[q(c).cast("double") for c in cols])))
        rows.append((name, got["dP"], got.get("dE_PCA"), got["mse"]))
    return df.sparkSession.createDataFrame(rows, "scenario string, dP double, dE_PCA double, mse double")


def _two_samples(ref: DataFrame, cur: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    def side(df: DataFrame, is_ref: int) -> DataFrame:
        return df.select(*[q(c) for c in by], plain_zero(q(col).cast("double")).alias("v"), F.lit(is_ref).alias("r"))

    return side(ref, 1).unionByName(side(cur, 0))


def ks_two_sample(ref: DataFrame, cur: DataFrame, col: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Two-sample KS statistic, asymptotic p, drift flag, means and population deviations."""
    by = list(by)
    rows = _two_samples(ref, cur, col, by).where(F.col("v").isNotNull())
    cum = running_by_value(rows, "v", {"r": F.col("r"), "c": 1 - F.col("r")}, by, totals=True)
    n1, n2 = F.max("cum_r_total"), F.max("cum_c_total")
    gap = F.max(F.abs(F.col("cum_r") / F.col("cum_r_total") - F.col("cum_c") / F.col("cum_c_total")))
    stat = cum.groupBy(*by).agg(gap.alias("ks"), n1.alias("n_ref"), n2.alias("n_cur"))
    is_ref = F.col("r") == 1
    shape = rows.groupBy(*by).agg(
        F.avg(F.when(is_ref, F.col("v"))).alias("ref_mean"), F.stddev_pop(F.when(is_ref, F.col("v"))).alias("ref_std"),
        F.avg(F.when(~is_ref, F.col("v"))).alias("cur_mean"), F.stddev_pop(F.when(~is_ref, F.col("v"))).alias("cur_std"),
    )
    if by:
        both = stat.join(shape, by)
    else:
        both = stat.withColumn("_k", F.lit(1)).join(F.broadcast(shape.withColumn("_k", F.lit(1))), "_k").drop("_k")
    out = both.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")))
    return out.withColumn("drift", F.coalesce((F.col("p_value") < alpha).cast("int"), F.lit(0)))


def psi_bins(ref: DataFrame, cur: DataFrame, col: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Shares per reference-quantile bin with the PSI term of each bin.

    The outer bins are open, a value on an inner edge belongs to the bin above it.
    """
    edges = exact_quantiles(ref, [col], [i / bins for i in range(bins + 1)])[col]
    if edges[0] is None:
        raise ValueError("the reference has no values")
    inner = sorted({e + 0.0 for e in edges[1:-1]})
    rows = _two_samples(ref, cur, col, []).where(F.col("v").isNotNull())
    splits = [-math.inf, *inner, math.inf]
    cut = Bucketizer(splits=splits, inputCol="v", outputCol="bin", handleInvalid="keep").transform(rows)
    counts = cut.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("c"))
    totals = rows.agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("c")).first()
    # Bins between equal edges are empty on both sides and add log(1) = 0.
    every = df_range(ref, len(inner) + 1).join(counts, "bin", "left").na.fill(0, ["r", "c"])
    e = clip(F.col("r") / F.lit(totals["r"]), low=floor)
    a = clip(F.col("c") / F.lit(totals["c"]), low=floor)
    return every.select("bin", e.alias("ref_share"), a.alias("cur_share"), ((a - e) * F.log(a / e)).alias("term"))


def df_range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))


def psi(ref: DataFrame, cur: DataFrame, col: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index with its band."""
    total = psi_bins(ref, cur, col, bins, floor).agg(F.sum("term").alias("psi"))
    return total.withColumn("band", F.when(F.col("psi") > 0.2, PSI_BANDS[2][1]).when(F.col("psi") > 0.1, PSI_BANDS[1][1]).otherwise(PSI_BANDS[0][1]))


def mann_whitney(ref: DataFrame, cur: DataFrame, col: str, by: Sequence[str] = (), p_warn: float = 0.01, p_alarm: float = 0.001) -> DataFrame:
    """Rank-sum test of whole tables: U, z, two-sided p and the verdict.

    Mean ranks of tied values follow from running counts of distinct values.
    """
    by = list(by)
    rows = _two_samples(ref, cur, col, by).where(F.col("v").isNotNull())
    cum = running_by_value(rows, "v", {"r": F.col("r"), "c": 1 - F.col("r")}, by, totals=True)
    # Pairs (reference above current), ties half.
    below = F.col("cum_c") - F.col("c") + F.col("c") / 2.0
    n1, n2 = F.max("cum_r_total").cast("double"), F.max("cum_c_total").cast("double")
    pairs = cum.groupBy(*by).agg(F.sum(F.col("r") * below).alias("wins"), n1.alias("n_ref"), n2.alias("n_cur"))
    full = F.col("n_ref") * F.col("n_cur")
    out = pairs.withColumn("u", F.least(F.col("wins"), full - F.col("wins"))).drop("wins")
    out = out.withColumn("z", rank_sum_z(F.col("u"), F.col("n_ref"), F.col("n_cur")))
    out = out.withColumn("p_value", two_sided_p(F.col("z")))
    verdict: Column = F.when(F.col("p_value") < p_alarm, "alarm").when(F.col("p_value") < p_warn, "warn").otherwise("normal")
    return out.withColumn("verdict", verdict)


def reconstruction_alarm(ref: DataFrame, cur: DataFrame, k: float | int = 0.90, factor: float = 1.2, arr: str = ARR) -> dict[str, float | bool]:
    """Alarm when the current error exceeds ``factor`` times the reference error; then refit.

    Both errors and the error after refitting on the current data come from two moment
    matrices, one pass over each table.
    """
    r, c = moments(ref, arr), moments(cur, arr)
    pca = fit_pca(r, k)
    before_ref, before_cur = residual_mse(r, pca), residual_mse(c, pca)
    alarm = before_cur > factor * before_ref
    after = residual_mse(c, fit_pca(c, pca.k, scale=r)) if alarm else before_cur
    return {"ref_mse": before_ref, "cur_mse": before_cur, "alarm": alarm, "adapted_mse": after}
