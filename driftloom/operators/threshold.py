"""Decision thresholds: fitted, adapted, compared without label leakage."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.columns import at_least
from driftloom.functions.names import q
from driftloom.functions.stats import kolmogorov_p
from driftloom.operators.metrics import binary_counts, class_scores, macro_means, macro_scores, threshold_sweep
from driftloom.operators.panes import SIZE, Setting, alarms, confusion_by_trial, mixed, pane_tests
from driftloom.operators.ranks import exact_quantiles, half_split
from driftloom.operators.sampling import digest_key
from driftloom.operators.sequence import forward_threshold, positions, rolling_ks
from driftloom.session import settle

# Candidate quantiles of the F1 search, and points of the sweep curve.
CANDIDATE_SPAN = (0.50, 0.999, 400)
SWEEP_POINTS = 300
REFERENCE_SAMPLE = 2000


def mean_std_threshold(df: DataFrame, score: str = "score", k: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """mean + k * population deviation, per group."""
    return df.groupBy(*by).agg((F.avg(q(score)) + k * F.stddev_pop(q(score))).alias("threshold"))


def quantile_threshold(df: DataFrame, score: str = "score", p: float = 0.95) -> float | None:
    return exact_quantiles(df, [score], [p])[score][0]


def candidates(df: DataFrame, score: str = "score", span: tuple[float, float, int] = CANDIDATE_SPAN) -> list[float]:
    """Distinct interpolated quantiles of the scores: a bounded list."""
    probs = np.linspace(*span).tolist()
    return sorted({v for v in exact_quantiles(df, [score], probs)[score] if v is not None})


def best_f1_threshold(df: DataFrame, score: str = "score", label: str = "label", grid: Iterable[float] | None = None) -> tuple[float, float]:
    """Candidate with the largest macro F1 and that F1; among equals the lowest candidate."""
    tried = list(grid) if grid is not None else candidates(df, score)
    if not tried:
        raise ValueError("no scores to choose a threshold from")
    sweep = threshold_sweep(df, tried, score=score, label=label)
    best = sweep.orderBy(F.desc("f1_macro"), F.asc("threshold")).first()
    return float(best["threshold"]), float(best["f1_macro"])


def sweep_points(df: DataFrame, score: str = "score", n: int = SWEEP_POINTS) -> list[float]:
    """n equal steps from the smallest score to the 99.9 % quantile."""
    low = df.agg(F.min(q(score))).first()[0]
    if low is None:
        raise ValueError("no scores to sweep over")
    return np.linspace(float(low), exact_quantiles(df, [score], [0.999])[score][0], n).tolist()


def compare_thresholds(df: DataFrame, thresholds: Mapping[str, float], score: str = "score", label: str = "label") -> DataFrame:
    """Macro scores and confusion counts per mode (inclusive threshold), one pass."""
    modes = F.explode(F.array(*[
        F.struct(F.lit(m).alias("mode"), F.lit(float(t)).alias("threshold"), at_least(q(score), float(t)).alias("pred"))
        for m, t in thresholds.items()
    ])).alias("m")
    rows = df.select(q(label).alias("label"), modes).select("label", "m.mode", "m.threshold", "m.pred")
    by = ["mode", "threshold"]
    return macro_scores(rows, by).join(binary_counts(rows, by), by)


def leak_free(df: DataFrame, order: Sequence[str], factory: float, score: str = "score", label: str = "label") -> DataFrame:
    """Choose the threshold on the earlier half, report both thresholds on the later half only."""
    slim = df.select(*[q(c) for c in dict.fromkeys([*order, score, label])])
    parts = settle(half_split(slim, order))
    cal, ev = parts.where(F.col("part") == "calibration"), parts.where(F.col("part") == "evaluation")
    chosen, _ = best_f1_threshold(cal, score, label)
    return compare_thresholds(ev, {"before": factory, "after": chosen}, score, label)


def reference_rows(df: DataFrame, cols: Sequence[str], ids: Sequence[str], n: int = REFERENCE_SAMPLE, seed: int = 0) -> list[tuple[float, ...]]:
    """``cols`` of n randomly chosen rows without a null there (a distributed top-k on a hash); n bounds what is collected."""
    whole = df.dropna(subset=list(cols))
    chosen = whole.orderBy(digest_key(ids, seed), *[q(c) for c in [*ids, *cols]]).limit(n)
    return [tuple(float(v) for v in r) for r in chosen.select(*[q(c) for c in cols]).collect()]


def adapt_on_drift(
    stream: DataFrame, ref: DataFrame, order: Sequence[str], ids: Sequence[str], window: int = 400, every: int = 120,
    p: float = 0.0007, k: float = 1.7872, score: str = "score", mode: str = "recent",
    sample_size: int = REFERENCE_SAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """Threshold mean + k*std that is set anew at every KS alarm.

    ``mode='recent'`` takes the alarm's own window, ``mode='reference'`` the reference data
    (the threshold then never changes). Returns the stream with ``threshold`` and ``pred``,
    and the checkpoint table with ``alarm``.
    """
    base = ref.agg(F.avg(q(score)).alias("m"), F.stddev_pop(q(score)).alias("s")).first()
    if base["m"] is None:
        raise ValueError("the reference has no scores")
    start = base["m"] + k * base["s"]
    sample = [r[0] for r in reference_rows(ref, [score], ids, sample_size)]
    placed = positions(stream, order)
    checks = rolling_ks(placed, order, sample, window, every, score)
    checks = checks.withColumn("p_value", kolmogorov_p(F.col("ks"), F.lit(len(sample)), F.lit(window)))
    # One row per checkpoint, read by the caller and by the steps below.
    checks = settle(checks.withColumn("alarm", (F.col("p_value") < p).cast("int")))
    new = F.col("mean") + k * F.col("std") if mode == "recent" else F.lit(start)
    changes = checks.where(F.col("alarm") == 1).select("checkpoint", new.alias("threshold"))
    out = forward_threshold(placed, order, changes, start, every)
    if "_rn" not in stream.columns:
        out = out.drop("_rn", "_rn_total")
    return out.withColumn("pred", at_least(q(score), F.col("threshold"))), checks


def tune(
    stream: DataFrame, ref: DataFrame, order: Sequence[str], ids: Sequence[str], grid: Sequence[Mapping[str, float]],
    e1: str = "e1", e2: str = "e2", label: str = "label", mode: str = "recent", sample_size: int = REFERENCE_SAMPLE, size: int = SIZE,
) -> DataFrame:
    """Macro F1 of every parameter set (w1, window, every, p, k) on both halves of the stream, all sets in the same passes.

    Each set is ``adapt_on_drift`` on the score ``w1 * e1 + (1 - w1) * e2``. Choose by ``f1_calibration``, report
    ``f1_evaluation``; ``best`` marks the set with the largest calibration F1, the first among equals.
    """
    cols = [e1, e2]
    slim = stream.select(*[q(c) for c in dict.fromkeys([*order, *cols, label])])
    placed, ref = settle(positions(slim, order).select("_rn", *[q(c) for c in dict.fromkeys([*cols, label])])), settle(ref)
    trials = {i: (float(g["w1"]), 1 - float(g["w1"])) for i, g in enumerate(grid)}
    mixes = [f(mixed(cols, w)).alias(f"{n}{i}") for i, w in trials.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    base = ref.agg(*mixes).first()
    if base["m0"] is None:
        raise ValueError("the reference has no scores")
    start = {i: base[f"m{i}"] + g["k"] * base[f"s{i}"] for i, g in enumerate(grid)}
    rows = reference_rows(ref, cols, ids, sample_size)
    settings = {
        i: Setting(w, int(g["window"]), int(g["every"]), tuple(w[0] * a + w[1] * b for a, b in rows), float(g["p"]))
        for (i, w), g in zip(trials.items(), grid)
    }
    fixed = {i: (float(g["k"]), None if mode == "recent" else start[i]) for i, g in enumerate(grid)}
    changes = settle(alarms(pane_tests(placed, cols, settings, size), settings, fixed))
    cells = confusion_by_trial(placed, cols, label, settings, changes, start, placed.count(), size)
    f1 = {(r["trial"], r["part"]): r["f1_macro"] for r in macro_means(class_scores(cells, ["trial", "part"]), ["trial", "part"]).collect()}
    out = [(i, *[float(g[c]) for c in ("w1", "window", "every", "p", "k")], f1.get((i, "calibration")), f1.get((i, "evaluation"))) for i, g in enumerate(grid)]
    best = max(range(len(out)), key=lambda j: (out[j][6] if out[j][6] is not None else -1.0, -j))
    schema = "trial int, w1 double, window double, every double, p double, k double, f1_calibration double, f1_evaluation double, best int"
    return stream.sparkSession.createDataFrame([(*r, int(j == best)) for j, r in enumerate(out)], schema)
