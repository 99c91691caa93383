"""Scalar expressions used by the operators; all stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp layouts accepted when the text is not uniform.
TIME_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "dd.MM.yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "yyyy-MM-dd",
)
# Drift bands (upper bound, name) and the version advice per band.
DRIFT_BANDS = ((10.0, "very low"), (30.0, "low"), (50.0, "moderate"), (70.0, "high"), (math.inf, "very high"))
ADVICE_BANDS = ((30.0, "minor version"), (70.0, "review, then minor version"), (math.inf, "major version"))
# Names of the gas codes and the text for any other code.
GAS_NAMES = {
    1: "Etanol (Ethanol)",
    2: "Etilen (Ethylene)",
    3: "Amonyak (Ammonia)",
    4: "Asetaldehit (Acetaldehyde)",
    5: "Aseton (Acetone)",
    6: "Toluen (Toluene)",
}
OTHER_GAS = "Bilinmeyen Gaz (%d)"
PSI_BANDS = ((0.1, "slight"), (0.2, "medium"), (math.inf, "strong"))


def literal_array(values: Sequence[float], kind: str = "double") -> Column:
    """Constant array from driver numbers, parsed as one expression and folded to one literal."""
    mark = {"double": "D", "long": "L"}[kind]
    return F.expr("array(" + ", ".join(f"{int(v) if kind == 'long' else repr(float(v))}{mark}" for v in values) + ")")


def plain_zero(x: Column) -> Column:
    """-0.0 as 0.0: a bucketizer puts them into different buckets, comparisons call them equal."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def composite_key(*cols: str | Column) -> Column:
    """``SITE_FREQ`` style key; null when a part is null."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit("_"), part]
    return F.concat(*pieces)


def tidy_key(col: Column) -> Column:
    return F.trim(col.cast("string"))


def parse_time(col: Column, layouts: Sequence[str] = TIME_LAYOUTS) -> Column:
    """First layout that fits; text that fits none becomes null."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in layouts])


def parse_number(col: Column) -> Column:
    """Text to double; what is no number becomes null."""
    return col.try_cast("double")


def floor_second(col: Column) -> Column:
    return F.date_trunc("second", col)


def bucket_start(col: Column, width: str = "8 hours") -> Column:
    return F.window(col, width).getField("start")


def is_true(cond: Column) -> Column:
    """1 where the condition holds, else 0 (also for unknown)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def at_least(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def above(score: Column, threshold: Column | float | None) -> Column:
    """Strictly above; 0 as long as no threshold is set."""
    if threshold is None:
        return F.lit(0)
    return is_true(score > threshold)


def within_tolerance(a: Column, b: Column, tol: float = 0.1) -> Column:
    return F.abs(a - b) < tol


def signed_cbrt(x: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(1.0 / 3.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return x


def decode(code: Column, names: Mapping[int, str] = GAS_NAMES, fallback: str = OTHER_GAS) -> Column:
    """Name of a label code, or the fallback text with the code in it."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), F.format_string(fallback, code))


def flag_text(flag: Column, yes: str = "Anomaly", no: str = "Normal") -> Column:
    return F.when(flag == 1, yes).otherwise(no)


def band(value: Column, bands: Sequence[tuple[float, str]] = DRIFT_BANDS) -> Column:
    """Name of the first band whose upper bound is above the value."""
    out = None
    for bound, name in bands:
        if math.isinf(bound):
            return F.lit(name) if out is None else out.otherwise(name)
        cond = value < bound
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def pad_or_crop(arr: Column, width: int = 128) -> Column:
    return F.slice(F.concat(arr, F.array_repeat(F.lit(0.0), width)), 1, width)


def roll_rows(arr: Column, by: int = 2, side: int = 28) -> Column:
    """Shift a side x side picture down by ``by`` rows; the last rows come in at the top."""
    size, cut = side * side, by * side
    return F.concat(F.slice(arr, size - cut + 1, cut), F.slice(arr, 1, size - cut))


def flatten_window(win: Column) -> Column:
    return F.flatten(win)


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the values that are there in one row; null when none is."""
    present = F.filter(F.array(*cols), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(present) > 0, total / F.size(present))


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """Value in (0, 1) that depends on the row's own keys only, never on its partition."""
    keys = [F.col(c) if isinstance(c, str) else c for c in cols]
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (high.cast("double") + 0.5) / float(1 << 53)


def hash_normal(*cols: Column | str, seed: int = 0) -> Column:
    """Standard normal value per row from two hash values (Box-Muller)."""
    u1, u2 = hash_unit(*cols, seed=2 * seed + 1), hash_unit(*cols, seed=2 * seed + 2)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
