"""Total orders, running sums and exact quantiles without a single-partition sort.

``Window.orderBy`` without ``partitionBy`` moves every row to one task. Here the order
is cut into buckets first:

1. split points of the order column come from a quantile sketch (one cheap pass);
2. a row's bucket is a pure function of its own key, so a re-run of a lost task gives the
   same bucket. ``repartitionByRange`` samples anew in every job and would not;
3. per-bucket totals make a table with one row per bucket, its prefix sums are the offsets;
4. each bucket is sorted on its own and adds its offset.

A value that fills whole buckets (a third of the rows may share one time stamp) gets a
bucket of its own, cut further along the tie-break column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.columns import literal_array, plain_zero
from driftloom.functions.names import q
from driftloom.session import settle

BUCKET = "_bucket"
_FOLDS = {"sum": F.sum, "max": F.max}


#: Rows that one task may be given, whatever the size of the table.
HOT_ROWS = 1_000_000


def default_buckets(df: DataFrame) -> int:
    """As many buckets as shuffle partitions: one sort task each."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def bucket_count(df: DataFrame) -> int:
    """Buckets of a table's order: one per shuffle partition, more where these would hold too many rows."""
    return max(default_buckets(df), math.ceil(df.count() / HOT_ROWS))


def split_points(df: DataFrame, col: str, n: int) -> list[float]:
    """n-1 sketch quantiles of a column, repeats kept (they show hot values)."""
    probs = [i / n for i in range(1, n)]
    return df.approxQuantile(col, probs, 0.25 / n)


def _bucketize(df: DataFrame, col: str, points: Sequence[float], out: str) -> DataFrame:
    inner = sorted({float(p) + 0.0 for p in points if math.isfinite(p)})
    if not inner:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *inner, math.inf]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def order_buckets(df: DataFrame, order: Sequence[str], n: int | None = None, out: str = BUCKET, sketch: DataFrame | None = None) -> DataFrame:
    """Add a bucket number that never decreases along ``order`` (numbers or times).

    ``sketch`` holds the rows whose quantiles are the split points (by default all of them).
    """
    n = n or bucket_count(df if sketch is None else sketch)

    def key(frame: DataFrame, name: str, col: str) -> DataFrame:
        return frame.withColumn(name, plain_zero(q(col).cast("double")))

    keyed, seen = key(df, "_k0", order[0]), key(df if sketch is None else sketch, "_k0", order[0])
    points = split_points(seen, "_k0", n)
    hot = sorted({a for a, b in zip(points, points[1:]) if a == b})
    keyed = _bucketize(keyed, "_k0", [*points, *[math.nextafter(h, math.inf) for h in hot]], "_b0")
    bucket = F.col("_b0")
    if hot and len(order) > 1:
        is_hot = F.col("_k0").isin(hot)
        sub = split_points(key(seen.where(is_hot), "_k1", order[1]), "_k1", n)
        keyed = _bucketize(key(keyed, "_k1", order[1]), "_k1", sub, "_b1")
        bucket = F.col("_b0") * (n + 1) + F.when(is_hot, F.col("_b1")).otherwise(0.0)
    return keyed.withColumn(out, F.coalesce(bucket, F.lit(-1.0)).cast("long")).drop("_k0", "_k1", "_b0", "_b1")


def hot_groups(df: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """Groups too large for one task, or None when there are none.

    Large means more than HOT_ROWS rows, so there is one such group per that many rows at
    most. All other groups are left to plain windows.
    """
    if df.count() <= HOT_ROWS:
        return None
    keys = df.groupBy(*[q(c) for c in by]).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).drop("_n")
    rows = keys.collect()
    return df.sparkSession.createDataFrame(rows, keys.schema) if rows else None


def same_group(by: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of group columns with their prefixed copies."""
    cond = F.lit(True)
    for c in by:
        cond = cond & q(c).eqNullSafe(q(f"{prefix}{c}"))
    return cond


def prefixed(df: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in by})


def _assign(df: DataFrame, order: Sequence[str], by: Sequence[str], n: int | None, bucket: Column | None) -> tuple[DataFrame, bool]:
    """Rows with their bucket, and whether any group has more than one.

    Without groups all rows are bucketed; with groups only those of hot groups are, and the
    others stay in bucket -2 as a whole.
    """
    if not by:
        return (order_buckets(df, order, n) if bucket is None else df.withColumn(BUCKET, bucket)), True
    hot = hot_groups(df, by)
    if hot is None:
        return df.withColumn(BUCKET, F.lit(-2).cast("long")), False
    side = prefixed(hot, by, "_h_").withColumn("_hot", F.lit(True))
    marked = df.join(side, same_group(by, "_h_"), "left").drop(*[f"_h_{c}" for c in by])
    cut = order_buckets(marked, order, n, sketch=marked.where("_hot")) if bucket is None else marked.withColumn(BUCKET, bucket)
    return cut.withColumn(BUCKET, F.when(F.col("_hot"), F.col(BUCKET)).otherwise(F.lit(-2))).drop("_hot"), True


def _with_offsets(
    cut: DataFrame,
    per_bucket: DataFrame | None,
    order: Sequence[Column],
    folds: Mapping[str, tuple[str, Column]],
    by: Sequence[str],
    totals: bool,
) -> DataFrame:
    """Running values inside each (group, bucket) plus the totals of the buckets before it."""
    part = Window.partitionBy(*[q(c) for c in by], BUCKET)
    inside = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut
    if per_bucket is not None:
        before = Window.partitionBy(*[q(c) for c in by]).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*[q(c) for c in by])
        offsets = per_bucket.select(
            *[q(c).alias(f"_g_{c}") for c in by],
            F.col(BUCKET).alias("_g_bucket"),
            *[_FOLDS[k](f"_s_{o}").over(before).alias(f"_o_{o}") for o, (k, _) in folds.items()],
            *[_FOLDS[k](f"_s_{o}").over(whole).alias(f"_t_{o}") for o, (k, _) in folds.items() if totals],
        )
        # One row per bucket, of all rows or of the hot groups; whether that is little enough to broadcast is left to
        # Spark's own size check.
        joined = cut.join(offsets, (F.col(BUCKET) == F.col("_g_bucket")) & same_group(by, "_g_"), "left")
    outs = {}
    for o, (k, e) in folds.items():
        local, all_here = _FOLDS[k](e).over(inside), _FOLDS[k](e).over(part)
        if per_bucket is None:
            outs[o] = F.coalesce(local, F.lit(0)) if k == "sum" else local
            total = all_here
        else:
            off = F.col(f"_o_{o}")
            outs[o] = F.coalesce(local, F.lit(0)) + F.coalesce(off, F.lit(0)) if k == "sum" else F.greatest(local, off)
            total = F.coalesce(F.col(f"_t_{o}"), all_here) if by and totals else F.col(f"_t_{o}")
        if totals:
            outs[f"{o}_total"] = total
    drop = [BUCKET, "_g_bucket", *[f"_g_{c}" for c in by], *[f"{x}{o}" for x in ("_o_", "_t_") for o in folds]]
    return joined.withColumns(outs).drop(*drop)


def running(
    df: DataFrame,
    order: Sequence[str],
    folds: Mapping[str, tuple[str, Column]],
    by: Sequence[str] = (),
    buckets: int | None = None,
    bucket: Column | None = None,
    totals: bool = False,
) -> DataFrame:
    """Running sum or max in the total order ``order``, within ``by``.

    ``folds`` maps an output name to ``("sum" | "max", expression)``. Rows equal in all of
    ``order`` get their running values in any order, so end it with a unique column. With
    ``totals`` each output also gets ``<name>_total``. ``bucket`` replaces the sketch when
    a monotone bucket of the first order column is known beforehand (e.g. top hash bits);
    it must take a bounded number of values.
    """
    by = list(by)
    cut, split = _assign(df, order, by, buckets, bucket)
    per_bucket = None
    if split:
        rows = cut.where(F.col(BUCKET) != -2) if by else cut
        per_bucket = rows.groupBy(*[q(c) for c in by], BUCKET).agg(*[_FOLDS[k](e).alias(f"_s_{o}") for o, (k, e) in folds.items()])
    return _with_offsets(cut, per_bucket, [q(c) for c in order], folds, by, totals)


def running_by_value(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    totals: bool = False,
) -> DataFrame:
    """One row per distinct value with its sums, and ``cum_<name>`` up to and with it.

    Sketch and bucket totals are taken from the raw rows (narrow passes with partial sums);
    only the last pass shuffles, after equal values were combined on the map side.
    """
    by = list(by)
    cut, split = _assign(df.where(q(value).isNotNull()), [value], by, None, None)
    per_bucket = None
    if split:
        rows = cut.where(F.col(BUCKET) != -2) if by else cut
        per_bucket = rows.groupBy(*[q(c) for c in by], BUCKET).agg(*[F.sum(e).alias(f"_s_cum_{o}") for o, e in sums.items()])
    per_value = cut.groupBy(*[q(c) for c in by], BUCKET, q(value)).agg(*[F.sum(e).alias(o) for o, e in sums.items()])
    folds = {f"cum_{o}": ("sum", F.col(o)) for o in sums}
    return _with_offsets(per_value, per_bucket, [q(value)], folds, by, totals)


def ranked(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "rn", buckets: int | None = None
) -> DataFrame:
    """1-based position in the total order, plus ``<out>_total`` rows in the group."""
    return running(df, order, {out: ("sum", F.lit(1))}, by, buckets, totals=True)


def half_split(df: DataFrame, order: Sequence[str], out: str = "part") -> DataFrame:
    """First floor(n/2) rows in order are 'calibration', the rest 'evaluation'."""
    parted = ranked(df, order, out="_rn")
    first = F.col("_rn") <= F.floor(F.col("_rn_total") / 2)
    return parted.withColumn(out, F.when(first, "calibration").otherwise("evaluation")).drop("_rn", "_rn_total")


def first_share(df: DataFrame, order: Sequence[str], share: float = 0.7) -> DataFrame:
    """First ``share`` of the rows in order (data-removal test)."""
    parted = ranked(df, order, out="_rn")
    return parted.where(F.col("_rn") <= F.floor(F.col("_rn_total") * share)).drop("_rn", "_rn_total")


def cut_batches(df: DataFrame, order: Sequence[str], size: int = 500, out: str = "batch") -> DataFrame:
    """Number consecutive runs of ``size`` rows 0, 1, 2 ..."""
    return ranked(df, order, out="_rn").withColumn(out, F.floor((F.col("_rn") - 1) / size)).drop("_rn", "_rn_total")


def every_nth(df: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = (), start: int = 0) -> DataFrame:
    """Rows at positions divisible by ``n`` (0-based when ``start`` is 0, else 1-based)."""
    pos = F.col("_rn") - 1 + start
    return ranked(df, order, by, "_rn").where(pos % n == 0).drop("_rn", "_rn_total")


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """Rank with ties sharing the mean of their positions.

    Equal values are counted first, so a hot value is one row when the order is built;
    the small (value, count) side is then joined back.
    """
    by = list(by)
    cum = running_by_value(df, value, {"_c": F.lit(1)}, by)
    ranks = cum.select(*by, value, (F.col("cum__c") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value], "left")


def _merged(brackets: Sequence[tuple[float, float]]) -> list[float]:
    """Disjoint closed intervals as split points: lo1, just above hi1, lo2, ..."""
    out: list[float] = []
    for lo, hi in sorted(brackets):
        end = math.nextafter(hi, math.inf)
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [lo, end]
    return out


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of whole columns, exact, as driver numbers.

    The built-in exact percentile keeps all distinct values of a column in one task. Here a
    sketch brackets each wanted order statistic first (its rank error is at most
    n / accuracy). Values outside the brackets are only counted per gap; values inside,
    about 4 / accuracy of the rows per quantile, are counted one by one and put in order.
    """
    cols, probs = list(cols), list(probs)
    raw = [plain_zero(q(c).cast("double")) for c in cols]
    base = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(raw)])
    eps = 4.0 / accuracy
    sides = literal_array([max(0.0, p - eps) for p in probs] + [min(1.0, p + eps) for p in probs])
    head = base.agg(*[
        f(f"v{i}").alias(f"{name}{i}")
        for i in range(len(cols))
        for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("b", lambda c: F.percentile_approx(c, sides, accuracy)))
    ]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    splits: dict[int, list[float]] = {}
    places: dict[int, set[int]] = {}
    for i in range(len(cols)):
        n = head[f"n{i}"]
        if not n:
            continue
        whole = (head[f"lo{i}"], head[f"hi{i}"])
        if n <= accuracy:  # so few rows that a bracket would be narrower than two positions
            brackets = [whole]
        else:
            near = [(p <= eps, 1 - p <= eps) for p in probs]
            brackets = [
                (whole[0] if at_lo else head[f"b{i}"][j], whole[1] if at_hi else head[f"b{i}"][len(probs) + j])
                for j, (at_lo, at_hi) in enumerate(near)
            ]
        splits[i] = [-math.inf, *_merged(brackets), math.inf]
        floors = [min(int(math.floor(p * (n - 1) + 1e-9)), n - 1) for p in probs]
        places[i] = {k for f in floors for k in (f, min(f + 1, n - 1))}
    if not splits:
        return out
    live = sorted(splits)
    binned = Bucketizer(
        splitsArray=[splits[i] for i in live], inputCols=[f"v{i}" for i in live], outputCols=[f"b{i}" for i in live],
        handleInvalid="keep",
    ).transform(base)
    # Odd bins are brackets; the value is kept there and dropped elsewhere.
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.when(F.col(f"v{i}").isNotNull(), F.col(f"b{i}").cast("long")).alias(BUCKET),
            F.when(F.col(f"b{i}") % 2 == 1, F.col(f"v{i}")).alias("v"),
        )
        for i in live
    ])
    counts = binned.select(F.inline(cells)).where(F.col(BUCKET).isNotNull()).groupBy("i", BUCKET, "v")
    counts = settle(counts.agg(F.count("*").alias("c")))  # far smaller than the table, read twice
    per_bin = counts.groupBy("i", BUCKET).agg(F.sum("c").alias("_s_cum"))
    cum = _with_offsets(counts, per_bin, [F.col("v")], {"cum": ("sum", F.col("c"))}, ["i"], False)
    start = F.col("cum") - F.col("c")
    wanted = None
    for i in live:
        at = literal_array(sorted(places[i]), "long")
        here = (F.col("i") == i) & F.exists(at, lambda k: (k >= start) & (k < F.col("cum")))
        wanted = here if wanted is None else wanted | here
    found = cum.where(F.col("v").isNotNull() & wanted).select("i", "v", start.alias("s"), "cum").collect()
    for i in live:
        n = head[f"n{i}"]
        mine = sorted((r["s"], r["cum"], r["v"]) for r in found if r["i"] == i)
        value = {k: v for s, e, v in mine for k in places[i] if s <= k < e}
        for j, p in enumerate(probs):
            pos = p * (n - 1)
            k = min(int(math.floor(pos + 1e-9)), n - 1)
            lo, hi = value[k], value[min(k + 1, n - 1)]
            out[cols[i]][j] = lo + (hi - lo) * max(0.0, pos - k)
    return out
