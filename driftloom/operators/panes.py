"""Kolmogorov-Smirnov tests of a moving window against a fixed reference, for any number of settings in one pass.

The reference doesn't move, so a row matters only by its cell: between two reference values, or at one. A window is a
count per cell, and the statistic follows from the running counts of window and reference at every cell's end. From one
checkpoint to the next only the pane of rows that enter and the pane that leave change the counts, so no row is copied
to each window it is in. Rows are dealt once, in blocks with the look-back of the longest window, whatever the number of
settings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.names import q
from driftloom.functions.stats import kolmogorov_critical, kolmogorov_p
from driftloom.operators.ranks import ranked

#: Rows of a block, without its look-back.
SIZE = 8192


@dataclass(frozen=True)
class Setting:
    """Weights of the score columns, the window and its step, the reference scores, and the p below which a window is reported."""

    weights: tuple[float, ...]
    window: int
    every: int
    reference: tuple[float, ...]
    p: float | None = None

    def __post_init__(self) -> None:
        if not self.reference:
            raise ValueError("the reference has no scores")
        if self.window < 1 or self.every < 1:
            raise ValueError("window and every are whole numbers from 1")

    def scores(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = self.weights[0] * columns[0]
        for w, c in zip(self.weights[1:], columns[1:]):
            out = out + w * c
        return out


def mixed(cols: Sequence[str], weights: Sequence[float]) -> Column:
    """The score of a setting as a column, with the same additions."""
    out = F.lit(float(weights[0])) * q(cols[0])
    for w, c in zip(weights[1:], cols[1:]):
        out = out + F.lit(float(w)) * q(c)
    return out


class Cells:
    """Cells of a reference: 2 j before its j-th distinct value, 2 j + 1 at that value."""

    def __init__(self, reference: Sequence[float]):
        self.values, count = np.unique(np.asarray(reference, float) + 0.0, return_counts=True)
        upto = np.concatenate([[0], np.cumsum(count)])
        self.share = upto[(np.arange(2 * len(self.values) + 1) + 1) // 2] / len(reference)

    def of(self, x: np.ndarray) -> np.ndarray:
        """A missing score is below all others."""
        x = np.where(np.isnan(x), -np.inf, x)
        return np.searchsorted(self.values, x, "left") + np.searchsorted(self.values, x, "right")


def window_tests(x: np.ndarray, first: int, own: int, s: Setting) -> Iterator[tuple[int, float, float, float]]:
    """``checkpoint, ks, mean, std`` of the windows that end at a multiple of ``every`` from row ``own`` on; ``x`` begins at row ``first``."""
    cells = Cells(s.reference)
    at, count = cells.of(x), np.zeros(len(cells.share), np.int64)
    start = max(own, s.window - 1)
    start += -start % s.every
    least = 0.0
    if s.p is not None:  # leaves room for rounding; the caller looks at p itself
        m = len(s.reference)
        least = kolmogorov_critical(s.p) / math.sqrt(m * s.window / (m + s.window)) * (1 - 1e-9)
    low = high = None
    for t in range(start - first, len(x), s.every):
        a, b = t - s.window + 1, t + 1
        if low is None or a >= high:
            count[:] = 0
            np.add.at(count, at[a:b], 1)
        else:
            np.subtract.at(count, at[low:a], 1)
            np.add.at(count, at[high:b], 1)
        low, high = a, b
        ks = float(np.abs(np.cumsum(count) / s.window - cells.share).max())
        if ks >= least:
            seen = x[a:b][~np.isnan(x[a:b])]
            yield (t + first) // s.every, ks, *((float(seen.mean()), float(seen.std())) if len(seen) else (math.nan, math.nan))


def pane_tests(placed: DataFrame, cols: Sequence[str], settings: Mapping[int, Setting], size: int = SIZE) -> DataFrame:
    """``trial, checkpoint, ks, mean, std`` for each setting (by trial number) of a stream with positions ``_rn``.

    Row i (from 0) is a checkpoint when i is a multiple of ``every`` and the window that ends with it is full. A setting
    with ``p`` reports only windows whose p may be below it.
    """
    back = max(s.window for s in settings.values()) - 1
    size = max(size, back, 1)
    i = F.col("_rn") - 1
    block = F.floor(i / size)
    to = F.when((i % size >= size - back), F.array(block, block + 1)).otherwise(F.array(block))
    rows = placed.select(i.alias("_i"), *[q(c).cast("double").alias(f"_c{n}") for n, c in enumerate(cols)], F.explode(to).alias("_block"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        first, own = int(pdf["_i"].iloc[0]), int(key[0]) * size
        columns = [pdf[f"_c{n}"].to_numpy(float) for n in range(len(cols))]
        out = [(trial, *row) for trial, s in settings.items() for row in window_tests(s.scores(columns), first, own, s)]
        return pd.DataFrame(out, columns=["trial", "checkpoint", "ks", "mean", "std"])

    return rows.groupBy("_block").applyInPandas(run, "trial int, checkpoint long, ks double, mean double, std double")


def alarms(tests: DataFrame, settings: Mapping[int, Setting], thresholds: Mapping[int, tuple[float, float | None]]) -> DataFrame:
    """``trial, row, threshold`` of the windows whose p is below the setting's; ``thresholds`` has (k, fixed threshold or None) per trial."""
    schema = "trial int, _window long, _every long, _m long, _p double, _k double, _fixed double"
    known = tests.sparkSession.createDataFrame([(t, s.window, s.every, len(s.reference), s.p, *thresholds[t]) for t, s in settings.items()], schema)
    found = tests.join(F.broadcast(known), "trial").where(kolmogorov_p(F.col("ks"), F.col("_m"), F.col("_window")) < F.col("_p"))
    new = F.coalesce("_fixed", F.col("mean") + F.col("_k") * F.col("std"))
    return found.select("trial", (F.col("checkpoint") * F.col("_every")).alias("row"), new.alias("threshold"))


def carried(changes: DataFrame, last_block: int, size: int) -> DataFrame:
    """``_block, trial, row, threshold``: the changes of each block, and the last one before it.

    The last change of a block holds up to the next block that has one; blocks with changes are numbered per trial for that.
    """
    placed = changes.withColumn("_block", F.floor(F.col("row") / size))
    last = placed.groupBy("trial", "_block").agg(F.max(F.struct("row", "threshold")).alias("_last"))
    numbered = ranked(last, ["_block"], ["trial"], "_n").drop("_n_total")
    following = numbered.select("trial", (F.col("_n") - 1).alias("_n"), F.col("_block").alias("_until"))
    until = F.coalesce("_until", F.lit(last_block))
    held = numbered.join(following, ["trial", "_n"], "left").where(F.col("_block") < until)
    held = held.select(F.explode(F.sequence(F.col("_block") + 1, until)).alias("_block"), "trial", "_last.row", "_last.threshold")
    return placed.select("_block", "trial", "row", "threshold").unionByName(held)


def confusion_by_trial(
    placed: DataFrame, cols: Sequence[str], label: str, settings: Mapping[int, Setting], changes: DataFrame, start: Mapping[int, float], rows: int, size: int = SIZE
) -> DataFrame:
    """``trial, part, label, pred, n``: every setting's confusion counts on both halves of a stream of ``rows`` rows.

    A row is predicted 1 if its score reaches the threshold of the last change before it, ``start`` before the first;
    a missing score does not.
    """
    i = F.col("_rn") - 1
    data = placed.select(
        F.floor(i / size).alias("_block"), i.alias("_i"), q(label).cast("int").alias("_y"), *[q(c).cast("double").alias(f"_c{n}") for n, c in enumerate(cols)]
    )
    half = rows // 2

    def run(pdf: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        place = pdf["_i"].to_numpy()
        columns = [pdf[f"_c{n}"].to_numpy(float) for n in range(len(cols))]
        code, labels = pd.factorize(pdf["_y"], use_na_sentinel=False)
        cell = 4 * code + 2 * (place >= half)
        by_trial = {t: g.sort_values("row") for t, g in seen.groupby("trial")}
        out = []
        for trial, s in settings.items():
            x, threshold = s.scores(columns), np.full(len(place), start[trial])
            if trial in by_trial:
                held = by_trial[trial]
                last = np.searchsorted(held["row"].to_numpy(), place, "left") - 1
                threshold = np.where(last < 0, start[trial], held["threshold"].to_numpy()[np.maximum(last, 0)])
            n = np.bincount(cell + (x >= threshold), minlength=4 * len(labels))
            out += [(trial, ("calibration", "evaluation")[c % 4 // 2], labels[c // 4], c % 2, n[c]) for c in np.flatnonzero(n)]
        return pd.DataFrame(out, columns=["trial", "part", "label", "pred", "n"])

    held = carried(changes, max(rows - 1, 0) // size, size)
    counted = data.groupBy("_block").cogroup(held.groupBy("_block")).applyInPandas(run, "trial int, part string, label int, pred int, n long")
    return counted.groupBy("trial", "part", "label", "pred").agg(F.sum("n").alias("n"))
