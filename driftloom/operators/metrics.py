"""Classification and ranking metrics from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.columns import plain_zero
from driftloom.functions.names import q
from driftloom.operators.ranks import running_by_value


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Rows per (group, label, prediction)."""
    return df.groupBy(*by, q(label).cast("int").alias("label"), q(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def binary_counts(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn per group."""
    y, p = q(label) == 1, q(pred) == 1
    return df.groupBy(*by).agg(
        F.count(F.when(y & p, 1)).alias("tp"),
        F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(y & ~p, 1)).alias("fn"),
        F.count(F.when(~y & ~p, 1)).alias("tn"),
    )


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


def f_score(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def accuracy(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    acc = F.avg((q(label) == q(pred)).cast("double"))
    return df.groupBy(*by).agg(acc.alias("accuracy"), (1.0 - acc).alias("error_rate"))


def per_class(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted class; 0 for 0/0."""
    return class_scores(confusion(df, by, label, pred), by)


def class_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``per_class`` from counts: label, pred, n."""
    by = list(by)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = cells.select(
        *by,
        F.explode(F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"), hit.alias("tp")),
            F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"), F.lit(0).cast("long").alias("tp")),
        )).alias("c"),
    )
    sums = sides.groupBy(*by, F.col("c.cls").alias("cls")).agg(
        F.sum("c.tp").alias("tp"), F.sum("c.support").alias("support"), F.sum("c.chosen").alias("chosen")
    )
    tp, sup, cho = F.col("tp"), F.col("support"), F.col("chosen")
    return sums.select(
        *by, "cls", "support", ratio(tp, cho).alias("precision"), ratio(tp, sup).alias("recall"),
        f_score(tp, cho - tp, sup - tp).alias("f1"),
    )


def macro_scores(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Unweighted class means and the support-weighted F1."""
    return macro_means(per_class(df, by, label, pred), by)


def macro_means(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``macro_scores`` from the classes' scores."""
    return classes.groupBy(*by).agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def positive_scores(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 of class 1 and the false-alarm rate (null without negatives)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return binary_counts(df, by, label, pred).select(
        *by,
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        f_score(tp, fp, fn).alias("f1"),
        ratio(fp, fp + tn, None).alias("false_alarm_rate"),
    )


def score_counts(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Distinct scores with their positives and negatives, and running counts up to them.

    Equal scores are summed before the order is built, so ties are exact and a hot score
    costs one row.
    """
    rows = df.withColumn("score", q(score).cast("double"))
    sums = {"pos": F.when(q(label) == 1, 1).otherwise(0), "neg": F.when(q(label) != 1, 1).otherwise(0)}
    return running_by_value(rows, "score", sums, by, totals=True)


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is absent."""
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    pairs = F.max("cum_pos_total").cast("double") * F.max("cum_neg_total")
    return score_counts(df, by, score, label).groupBy(*by).agg(ratio(wins, pairs, None).alias("roc_auc"))


def pr_curve(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall of ``score >= threshold`` at every distinct score."""
    c = score_counts(df, by, score, label)
    tp = F.col("cum_pos_total") - F.col("cum_pos") + F.col("pos")
    fp = F.col("cum_neg_total") - F.col("cum_neg") + F.col("neg")
    return c.select(
        *by, F.col("score").alias("threshold"), "pos",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("cum_pos_total")).alias("recall"),
        F.col("cum_pos_total").alias("positives"),
    )


def average_precision(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Step sum of precision over recall gains (not the trapezoid)."""
    gain = ratio(F.sum(F.col("pos") * F.col("precision")), F.max("positives"), None)
    return pr_curve(df, by, score, label).groupBy(*by).agg(gain.alias("average_precision"))


def threshold_counts(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn of ``score >= t`` for every threshold of a grid.

    Each row falls into one interval between thresholds; the counts of a few hundred
    intervals are then summed from the top. No row meets more than one threshold.
    """
    by = list(by)
    grid = sorted({float(t) + 0.0 for t in thresholds})
    spark = df.sparkSession
    splits = [float("-inf"), *grid, float("inf")]
    rows = df.select(*by, plain_zero(q(score).cast("double")).alias("_score"), (q(label) == 1).alias("_y"))
    cut = Bucketizer(splits=splits, inputCol="_score", outputCol="_bin", handleInvalid="keep").transform(rows)
    counts = cut.groupBy(*by, F.col("_bin").cast("int").alias("bin")).agg(
        F.count(F.when(F.col("_y"), 1)).alias("pos"), F.count(F.when(~F.col("_y"), 1)).alias("neg")
    )
    # Every threshold is wanted, also one whose interval is empty.
    lines = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "bin int, threshold double")
    groups = counts.select(*by).distinct() if by else None
    if by:
        frame = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("bin"))
    else:
        frame = spark.range(len(grid) + 1).select(F.col("id").cast("int").alias("bin"))
    full = frame.join(counts, [*by, "bin"], "left").na.fill(0, ["pos", "neg"])
    down = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    summed = full.select(
        *by, "bin",
        F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"),
    )
    return summed.join(F.broadcast(lines), "bin").select(
        *by, "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn")
    )


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean F1 over the classes that occur as truth or prediction."""
    pos_seen, neg_seen = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    total = F.when(pos_seen, f_score(tp, fp, fn)).otherwise(0.0) + F.when(neg_seen, f_score(tn, fn, fp)).otherwise(0.0)
    return ratio(total, pos_seen.cast("int") + neg_seen.cast("int"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Macro F1 at every threshold of a grid."""
    c = threshold_counts(df, thresholds, by, score, label)
    return c.withColumn("f1_macro", macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def strategy_means(results: DataFrame, strategy: str = "strategy", acc: str = "accuracy") -> DataFrame:
    return results.groupBy(q(strategy)).agg(F.avg(q(acc)).alias("mean_accuracy"))


def strategy_gain(results: DataFrame, static: str = "static", adaptive: str = "drift", batch: str = "batch", acc: str = "accuracy") -> DataFrame:
    """Loss of the static strategy from first to last batch, and the adaptive one's lead at the end."""
    ends = results.groupBy("strategy").agg(
        F.min_by(q(acc), q(batch)).alias("first"), F.max_by(q(acc), q(batch)).alias("last")
    )
    s, a = F.col("strategy") == static, F.col("strategy") == adaptive
    return ends.agg(
        (F.max(F.when(s, F.col("first"))) - F.max(F.when(s, F.col("last")))).alias("static_loss"),
        (F.max(F.when(a, F.col("last"))) - F.max(F.when(s, F.col("last")))).alias("adaptive_gain"),
    )


def mean_history(log: DataFrame, cols: Sequence[str] = ("gmean", "recall", "specificity", "pauc"), by: Sequence[str] = ()) -> DataFrame:
    """Final scores: the mean of each per-step history."""
    return log.groupBy(*by).agg(*[F.avg(q(c)).alias(c) for c in cols])
