"""Windowed features over measurements and neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.columns import bucket_start
from driftloom.functions.names import feature_name, first_matching, numeric_columns, q
from driftloom.operators.clean import fill_zero
from driftloom.operators.joins import strong_edges
from driftloom.sources.schema import NAMED_FEATURES

Spec = tuple[str, str, str]  # output name, "avg" | "sum", input column


def _measure(kind: str, col: Column) -> Column:
    return F.avg(col) if kind == "avg" else F.sum(col)


def window_features(df: DataFrame, specs: Sequence[Spec], keys: Sequence[str] = ("CELL",), time: str = "DATETIME", width: str = "8 hours") -> DataFrame:
    """Tumbling-window averages and sums per key."""
    aggs = [_measure(kind, q(c)).alias(out) for out, kind, c in specs]
    return df.groupBy(F.window(q(time), width), *[q(k) for k in keys]).agg(*aggs)


def neighbour_window_features(
    facts: DataFrame,
    edges: DataFrame,
    specs: Sequence[Spec] = NAMED_FEATURES,
    min_overlap: float = 40.0,
    time: str = "DATETIME",
    width: str = "8 hours",
) -> DataFrame:
    """Features per (window, cell, neighbour), null numbers as 0.

    Equal to joining the neighbours first and grouping after, but the measurements are
    aggregated to (window, cell) before they meet the edges: only windows are fanned out,
    never raw rows, and a hot cell is already one row per window when it is joined. An edge
    listed m times would repeat each measurement m times, so its sums are taken m-fold.
    """
    per_cell = window_features(facts, specs, ["CELL"], time, width)
    pairs = strong_edges(edges, min_overlap).groupBy("CELL", "N_CELL").agg(F.count("*").alias("_m"))
    joined = per_cell.join(pairs, "CELL", "left")
    times = F.coalesce(F.col("_m"), F.lit(1))
    outs = [(F.col(o) * times).alias(o) if kind == "sum" else F.col(o) for o, kind, _ in specs]
    return fill_zero(joined.select("window", "CELL", "N_CELL", *outs))


def auto_specs(df: DataFrame, exclude: Sequence[str] = ()) -> list[Spec]:
    """An average for every measured numeric column, under a dot-free name."""
    return [(feature_name(c), "avg", c) for c in numeric_columns(df) if c not in exclude]


def floored_means(df: DataFrame, cols: Sequence[str], time: str = "DATETIME", cell: str = "CELL", width: str = "8 hours", weight: str | None = None) -> DataFrame:
    """Mean per (floored time, cell) without the neighbour in the key.

    ``weight`` is the number of times a row stands in a fanned-out table; such a mean over
    repeated rows of one cell is the plain mean, so no fan-out is needed for it.
    """
    def mean(c: str) -> Column:
        if weight is None:
            return F.avg(q(c))
        return F.sum(q(c) * q(weight)) / F.sum(F.when(q(c).isNotNull(), q(weight)))

    return df.groupBy(bucket_start(q(time), width).alias("time_window"), q(cell)).agg(*[mean(c).alias(c) for c in cols])


def table_summary(df: DataFrame, sums: dict[str, str], avgs: dict[str, str], null_as_zero: bool = False) -> DataFrame:
    """Sums and means over the whole table, one row."""
    outs = [F.sum(q(c)).alias(o) for o, c in sums.items()] + [F.avg(q(c)).alias(o) for o, c in avgs.items()]
    got = df.agg(*outs)
    return got.na.fill(0) if null_as_zero else got


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, key: str, value: str, n: int = 10, out: str = "avg_value") -> DataFrame:
    """The n keys with the largest mean; equal means go to the smaller key."""
    return df.groupBy(q(key)).agg(F.avg(q(value)).alias(out)).orderBy(F.desc(out), q(key)).limit(n)


def drift_gauges(features: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Mean over all windows of the first feature matching each name part; no match, no gauge."""
    found = {out: first_matching(features.columns, part) for out, part in parts.items()}
    aggs = [F.coalesce(F.avg(q(c)), F.lit(0.0)).alias(out) for out, c in found.items() if c]
    if not aggs:
        raise ValueError("no feature matches any gauge")
    return features.agg(*aggs)


def append_history(*batches: DataFrame) -> DataFrame:
    """All batches so far as one table, by column name."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out
