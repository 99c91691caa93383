"""Column names: clean-up, quoting, discovery."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header variants that mean the same column.
HEADER_ALIASES = {
    "SectorID": "CELL",
    "SITE": "CELL",
    "Traffic Volume Gbyte": "Traffic_Volume_Gbyte",
}
# Numeric columns that describe the site and are never measured.
STATIC_COLUMNS = ("LAT", "LON", "BW", "CARRIER", "AZIMUTH", "FREQ")
HOST_MARK = "[H] "


def q(name: str) -> Column:
    """Column by literal name, also with dots or blanks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_name(name: str, anywhere: bool = False, aliases: dict[str, str] | None = None) -> str:
    text = name.strip()
    if anywhere or text.startswith(HOST_MARK):
        text = text.replace(HOST_MARK, "")
    return (HEADER_ALIASES if aliases is None else aliases).get(text, text)


def normalise_names(
    df: DataFrame,
    anywhere: bool = False,
    aliases: dict[str, str] | None = None,
    required: Iterable[str] = ("CELL",),
) -> DataFrame:
    """Trim headers, drop the host mark, map aliases; fail on a missing or doubled name."""
    names = [clean_name(c, anywhere, aliases) for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"columns collide after clean-up: {doubled}")
    missing = [r for r in required if r not in names]
    if missing:
        raise ValueError(f"required columns are absent: {missing}")
    return df.toDF(*names)


def feature_name(name: str, prefix: str = "avg", suffix: str = "8h") -> str:
    """``L.UL.Max`` -> ``avg_L_UL_Max_8h``; dots would need quoting ever after."""
    return f"{prefix}_{name.replace('.', '_')}_{suffix}"


def numeric_columns(df: DataFrame, exclude: Iterable[str] = STATIC_COLUMNS) -> list[str]:
    """Double, integer and long columns in schema order, without the excluded ones."""
    skip = set(exclude)
    kinds = (T.DoubleType, T.IntegerType, T.LongType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def first_matching(columns: Sequence[str], part: str) -> str | None:
    """First column whose name holds ``part``, or None (the metric is then skipped)."""
    return next((c for c in columns if part in c), None)
