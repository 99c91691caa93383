"""Distribution profiles, histograms, class shares and change reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.names import q
from driftloom.operators.joins import pair_on_feature
from driftloom.operators.ranks import exact_quantiles


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: mean, sample deviation, exact median and quartiles."""
    spark = df.sparkSession
    aggs = [f(q(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs).first()
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, row[f"m{i}"], row[f"s{i}"], qs[c][1], qs[c][0], qs[c][2]) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "feature string, mean double, std double, median double, q1 double, q3 double")


def overall_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each statistic averaged over the columns; the range is mean(q3) - mean(q1)."""
    p = column_profile(df, cols)
    means = [F.avg(c).alias(c) for c in ("mean", "std", "median", "q1", "q3")]
    return p.agg(*means).withColumn("iqr", F.col("q3") - F.col("q1"))


def class_counts(df: DataFrame, classes: Sequence[int], batch: str = "batch", label: str = "label") -> DataFrame:
    """Rows per batch and class as columns ``class_<c>``; absent classes are 0."""
    counts = [F.count(F.when(q(label) == c, 1)).alias(f"class_{c}") for c in classes]
    return df.groupBy(q(batch)).agg(*counts)


def class_shares(df: DataFrame, batch: str = "batch", label: str = "label") -> DataFrame:
    """Share of every class in its batch, long form."""
    n = df.groupBy(q(batch), q(label)).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(q(batch))))


def label_kinds(df: DataFrame, batch: str = "batch", label: str = "label") -> DataFrame:
    """Distinct labels per batch and whether that is a binary task.

    Duplicates go first, so no task ever holds more than the distinct labels of a batch.
    """
    kinds = df.select(q(batch), q(label)).distinct().groupBy(batch).agg(
        F.count(label).alias("n_labels"), F.sort_array(F.collect_set(label)).alias("labels")
    )
    return kinds.withColumn("is_binary", F.col("n_labels") == 2)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, from one aggregate pass.

    Rows count where both columns have a value; null for a constant column, on which the
    built-in correlation would fail.
    """
    x = [q(c).cast("double") for c in cols]
    aggs = []
    for i, j in combinations_with_replacement(range(len(cols)), 2):
        a, b = F.when(x[j].isNotNull(), x[i]), F.when(x[i].isNotNull(), x[j])
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        aggs.append(F.when(spread > 0, F.covar_pop(a, b) / spread).alias(f"r{i}_{j}"))
    row = df.agg(*aggs)
    cells = [
        F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"r{min(i, j)}_{max(i, j)}").alias("r"))
        for i in range(len(cols))
        for j in range(len(cols))
    ]
    return row.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Equal-width bins between a group's minimum and maximum, counts and density.

    The last bin is closed on the right; a constant column spans value +- 0.5.
    """
    keys = [q(by)] if by else []
    value = q(col).cast("double")
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        *keys,
        "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    if by:
        rows = df.where(value.isNotNull()).join(ends, by)
        lo, hi = F.col("lo"), F.col("hi")
    else:
        e = ends.first()
        rows = df.where(value.isNotNull())
        if e is None or e["lo"] is None:
            return df.sparkSession.createDataFrame([], "bin int, bin_lo double, n long, density double")
        rows = rows.withColumns({k: F.lit(e[k]) for k in ("lo", "hi", "total")})
        lo, hi = F.col("lo"), F.col("hi")
    bin_no = F.least(F.floor((value - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int").alias("bin")
    group = [*keys, bin_no, "lo", "hi", "total"]
    n = rows.groupBy(*group).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return n.select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"), "n",
        (F.col("n") / (F.col("total") * width)).alias("density"),
    )


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per column, long form, from one aggregate row."""
    aggs = [f(q(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def change_percent(ref: Column, cur: Column) -> Column:
    return F.when(ref != 0, (cur - ref) / ref * 100.0)


def change_report(ref: DataFrame, cur: DataFrame, cols: Sequence[str], flag_at: float = 10.0) -> DataFrame:
    """Mean and deviation of both tables, change in percent, flag where it is large."""
    both = pair_on_feature(feature_stats(ref, cols), feature_stats(cur, cols))
    mean_change = change_percent(F.col("ref_mean"), F.col("cur_mean"))
    std_change = change_percent(F.col("ref_std"), F.col("cur_std"))
    return both.withColumns({
        "mean_change": mean_change,
        "std_change": std_change,
        "flagged": F.coalesce((F.abs(mean_change) > flag_at).cast("int"), F.lit(0)),
    })


def batch_anomaly_rate(df: DataFrame, batch: str = "batch", pred: str = "pred") -> DataFrame:
    """Anomaly rate per batch with the running number of processed rows."""
    from driftloom.sinks.runs import cumulative_counts

    per = df.groupBy(q(batch)).agg(F.avg(q(pred).cast("double")).alias("anomaly_rate"), F.count("*").alias("n"))
    return cumulative_counts(per, batch)


def reconstruction_error(df: DataFrame, a: str, b: str, out: str = "error") -> DataFrame:
    """Mean squared difference of two equally long arrays, per row."""
    sq = F.aggregate(F.zip_with(q(a), q(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, sq / F.size(q(a)))
