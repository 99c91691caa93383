"""The end-to-end jobs: features, drift report, leak-free thresholds, evaluated stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.names import normalise_names
from driftloom.operators.drift import DriftModel, interpret
from driftloom.operators.features import auto_specs, drift_gauges, neighbour_window_features
from driftloom.operators.metrics import mean_history
from driftloom.operators.moments import as_features
from driftloom.operators.scaling import assemble, drop_constant, project_pca, robust_scale_vector
from driftloom.operators.sequence import prequential, prequential_auc
from driftloom.session import settle
from driftloom.sinks.runs import RunLog
from driftloom.sinks.writers import write_windowed
from driftloom.sources.readers import read_parquet


def feature_job(facts: DataFrame, edges: DataFrame, path: str, run: RunLog | None = None, specs=None, min_overlap: float = 40.0) -> DataFrame:
    """Clean names, window per (cell, neighbour), robust-scale, write; returns the written table.

    The windowed table is written to the shared folder once: the scaler's fit and the final
    write both read it instead of computing the join and aggregate again.
    """
    clean = normalise_names(facts)
    specs = specs or auto_specs(clean)
    windows = settle(neighbour_window_features(clean, edges, specs, min_overlap))
    _, scaled = robust_scale_vector(assemble(windows, [s[0] for s in specs]))
    write_windowed(scaled.drop("raw_features"), path)
    out = read_parquet(facts.sparkSession, path)
    if run:
        run.metric("total_samples", out.count())
    return out


def selection_job(windows: DataFrame, names: Sequence[str], k: int = 2, gauges: dict[str, str] | None = None):
    """Drop constant features, project on k components: (frame, kept names, variance shares, gauges)."""
    kept_frame, kept = drop_constant(windows, names)
    model, projected = project_pca(kept_frame, min(k, len(kept)))
    report = drift_gauges(windows, gauges) if gauges else None
    return projected, kept, [float(v) for v in model.explainedVariance.toArray()], report


def drift_report(ref: DataFrame, cur: DataFrame, cols: Sequence[str], by: str | None = None, **fit) -> DataFrame:
    """dP and dE of current data, whole or per batch, with band and version advice."""
    model = DriftModel.fit(as_features(ref, cols), **fit)
    feats = as_features(cur, cols)
    if by:
        rows = model.by_group(feats, by)
    else:
        got = model.score(feats)
        rows = cur.sparkSession.createDataFrame(list(got.items()), "metric string, value double")
    return interpret(rows.where(F.col("metric") != "mse"))


def evaluated_stream(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), fade: float = 0.99, auc_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Per-step log (gmean, recall, specificity, pauc) of a scored stream, and its summary."""
    log = prequential_auc(prequential(df, order, by, fade), order, by, auc_rows)
    return log, mean_history(log, by=by)


