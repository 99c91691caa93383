"""Column and row cleaning on whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.columns import floor_second, parse_number, row_mean, tidy_key
from driftloom.functions.names import q
from driftloom.operators.ranks import exact_quantiles


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns without a single value; one pass counts all of them."""
    counts = df.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    empty = {c for i, c in enumerate(df.columns) if counts[f"c{i}"] == 0 and c not in keep}
    return df.select(*[q(c) for c in df.columns if c not in empty])


def drop_named(df: DataFrame, part: str = "PRB") -> DataFrame:
    """Drop columns whose upper-cased name holds ``part``."""
    return df.select(*[q(c) for c in df.columns if part not in c.upper()])


def ensure_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All features as doubles: absent ones null, text that is no number null."""
    have = set(df.columns)
    return df.withColumns({c: parse_number(q(c)) if c in have else F.lit(None).cast("double") for c in features})


def fill_zero(df: DataFrame) -> DataFrame:
    """Null numbers become 0; keys and other text keep their nulls."""
    return df.na.fill(0)


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the exact median over the whole table."""
    med = exact_quantiles(df, cols, [0.5])
    return df.withColumns({c: F.coalesce(q(c), F.lit(med[c][0]).cast("double")) for c in cols})


def fill_row_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the mean over the series at the same time point (one row = one time)."""
    mean = row_mean([q(c).cast("double") for c in cols])
    return df.withColumns({c: F.coalesce(q(c).cast("double"), mean) for c in cols})


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "series", value: str = "value") -> DataFrame:
    return df.unpivot([q(c) for c in ids], [q(c) for c in cols], name, value)


def to_wide(df: DataFrame, ids: Sequence[str], names: Sequence[str], name: str = "series", value: str = "value") -> DataFrame:
    """One column per listed name; the list is given so that no extra pass is needed to find it."""
    return df.groupBy(*ids).pivot(name, list(names)).agg(F.avg(value))


def matrix_min_max(df: DataFrame, arr: str, out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min + 1e-7) with one minimum and maximum for all cells."""
    ends = df.agg(F.min(F.array_min(arr)).alias("lo"), F.max(F.array_max(arr)).alias("hi")).first()
    if ends["lo"] is None:
        return df.withColumn(out, q(arr))
    lo, span = float(ends["lo"]), float(ends["hi"]) - float(ends["lo"]) + 1e-7
    return df.withColumn(out, F.transform(q(arr), lambda x: (x.cast("double") - lo) / span))


def binarise_not_min(df: DataFrame, label: str, out: str = "label") -> DataFrame:
    """The smallest class is normal (0), all others are 1."""
    lowest = df.agg(F.min(q(label))).first()[0]
    return df.withColumn(out, F.when(q(label) != F.lit(lowest), 1).otherwise(0))


def keep_classes(df: DataFrame, classes: Sequence[int], positive: int, label: str = "label") -> DataFrame:
    """Only the listed classes, one of them as the positive one."""
    return df.where(q(label).isin(list(classes))).withColumn(label, (q(label) == positive).cast("int"))


def sensor_rows(df: DataFrame, features: Sequence[str], cell: str = "CELL", time: str = "DATETIME") -> DataFrame:
    """Everything the sliding windows need: tidy key, valid time, numeric gap-free features."""
    base = drop_named(df, "PRB")
    base = base.withColumn(cell, tidy_key(q(cell))).where(q(time).isNotNull() & q(cell).isNotNull())
    return fill_median(ensure_features(base, features), features)


def seconds(df: DataFrame, time: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or time, floor_second(q(time)))


def keep_at_least(df: DataFrame, col: str, bound: float) -> DataFrame:
    return df.where(q(col) >= bound)


def share_within(df: DataFrame, a: str, b: str, tol: float = 0.1) -> DataFrame:
    """Share of array cells that differ by less than ``tol``."""
    pair: Column = F.explode(F.arrays_zip(q(a).alias("a"), q(b).alias("b"))).alias("p")
    cells = df.select(pair)
    return cells.agg(F.avg((F.abs(F.col("p.a") - F.col("p.b")) < tol).cast("double")).alias("share"))
