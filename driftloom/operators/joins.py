"""Joins of measurements, neighbours and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.columns import floor_second, tidy_key
from driftloom.functions.names import q
from driftloom.sources.schema import OVERLAP


def strong_edges(edges: DataFrame, min_overlap: float = 40.0) -> DataFrame:
    """Neighbour pairs whose overlap reaches the bound (inclusive)."""
    return edges.where(q(OVERLAP) >= min_overlap).select("CELL", "N_CELL")


def join_neighbours(facts: DataFrame, edges: DataFrame, min_overlap: float | None = 40.0) -> DataFrame:
    """One row per measurement and neighbour; cells without one keep a null neighbour.

    No broadcast hint: Spark broadcasts the edges when their size allows it and falls back
    to a shuffle join, split at hot cells by AQE, when they have grown.
    """
    side = edges.select("CELL", "N_CELL") if min_overlap is None else strong_edges(edges, min_overlap)
    return facts.join(side, "CELL", "left")


def neighbour_totals(facts: DataFrame, edges: DataFrame, sums: dict[str, str], avgs: dict[str, str], fanout_safe: bool = False) -> DataFrame:
    """Table-wide sums and means over the neighbour join, one row.

    By default a measurement counts once per neighbour. That is the same as weighting it
    by the number of its cell's edges, so facts are summed per cell first and the fan-out
    is never built. With ``fanout_safe`` every measurement counts once.
    """
    cols = sorted({*sums.values(), *avgs.values()})
    per_cell = facts.groupBy("CELL").agg(
        *[F.sum(q(c)).alias(f"_s_{i}") for i, c in enumerate(cols)],
        *[F.count(q(c)).alias(f"_n_{i}") for i, c in enumerate(cols)],
    )
    weight = F.lit(1)
    if not fanout_safe:
        degree = edges.groupBy("CELL").agg(F.count("*").alias("_w"))
        per_cell = per_cell.join(degree, "CELL", "left")
        weight = F.coalesce(F.col("_w"), F.lit(1))
    at = {c: i for i, c in enumerate(cols)}
    return per_cell.agg(
        *[F.sum(F.col(f"_s_{at[c]}") * weight).alias(o) for o, c in sums.items()],
        *[(F.sum(F.col(f"_s_{at[c]}") * weight) / F.sum(F.col(f"_n_{at[c]}") * weight)).alias(o) for o, c in avgs.items()],
    )


def attach_labels(windows: DataFrame, labels: DataFrame, cell: str = "CELL", time: str = "END_TIME", label: str = "label") -> DataFrame:
    """Label per (cell, second): doubled labels collapse to the largest, absent ones are 0."""
    keyed = (
        labels.select(
            tidy_key(q(cell)).alias(cell), floor_second(q(time)).alias("_sec"), q(label).cast("int").alias("_label")
        )
        .na.drop()
        .groupBy(cell, "_sec")
        .agg(F.max("_label").alias("_label"))
    )
    left = windows.drop(label).withColumn("_sec", floor_second(q(time)))
    joined = left.join(keyed, [cell, "_sec"], "left")
    return joined.withColumn(label, F.coalesce(F.col("_label"), F.lit(0))).drop("_label", "_sec")


def without(df: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys are not among ``taken``."""
    return df.join(taken.select(*keys), list(keys), "left_anti")


def pair_on_feature(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Per-feature statistics of two tables side by side."""
    r = ref.select("feature", *[F.col(c).alias(f"ref_{c}") for c in ref.columns if c != "feature"])
    c = cur.select("feature", *[F.col(c).alias(f"cur_{c}") for c in cur.columns if c != "feature"])
    return r.join(c, "feature")


def for_next_batch(models: DataFrame, batch: str = "batch") -> DataFrame:
    """Model records under the number of the batch that they are tested on: the one after their own."""
    return models.withColumn(batch, F.col(batch) + 1)


def previous_batch(batches: DataFrame, models: DataFrame, batch: str = "batch") -> DataFrame:
    """Pair every batch with the model record of the batch before it."""
    return batches.join(for_next_batch(models, batch), batch)
