"""Models and batch-by-batch adaptation strategies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.names import numeric_columns, q
from driftloom.operators.forests import DEEPEST, Forest, apply_models, fit_forests, importances, predict_forests
from driftloom.operators.metrics import accuracy
from driftloom.operators.moments import ARR, Moments, Pca, fit_pca, packed_moments, residual_mse, unpack
from driftloom.operators.ranks import ranked
from driftloom.operators.sampling import stratified_folds
from driftloom.operators.sequence import adwin_resume, keyed_fold
from driftloom.session import dropped_shuffles, settle


def linear_fit(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[object, dict[str, float]]:
    """Linear regression of the last numeric column on the others; (model, RMSE and R2)."""
    cols = list(cols or numeric_columns(df, ()))
    if len(cols) < 2:
        raise ValueError("need a feature and a label column")
    data = VectorAssembler(inputCols=cols[:-1], outputCol="_v", handleInvalid="skip").transform(df)
    model = LinearRegression(featuresCol="_v", labelCol=cols[-1]).fit(data)
    return model, {"rmse": model.summary.rootMeanSquaredError, "r2": model.summary.r2}


def fit_forest(df: DataFrame, trees: int = 50, depth: int = DEEPEST, arr: str = ARR, label: str = "label", seed: int = 42, ids: Sequence[str] = ()) -> Forest:
    """One forest on all rows. Rows equal in ``ids`` (by default in vector and label) are drawn together."""
    return fit_forests(df, list(ids) or [arr, label], trees, depth, arr, label, seed=seed)


def predict(model: Forest, df: DataFrame, arr: str = ARR) -> DataFrame:
    return predict_forests(df, model, arr)


def cross_validate(
    df: DataFrame, ids: Sequence[str], folds: int = 5, trees: int = 50, arr: str = ARR, label: str = "label", seed: int = 42, depth: int = DEEPEST
) -> float:
    """Mean accuracy over stratified folds; all folds are grown together and scored together."""
    dealt = settle(stratified_folds(df, ids, label, folds, seed))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    forest = fit_forests(dealt.withColumn("_left_out", F.explode(others)), ids, trees, depth, arr, label, "_left_out", seed)
    pred = predict_forests(dealt, Forest(forest.table.withColumnRenamed("_left_out", "fold"), "fold"), arr, "fold")
    return float(accuracy(pred, ["fold"], label).agg(F.avg("accuracy")).first()[0])


def class_means(df: DataFrame, batch: str = "batch", arr: str = ARR, label: str = "label") -> DataFrame:
    """A model per batch as rows: batch, label and the mean vector of the class. Missing numbers are not in a mean."""
    cells = df.where(q(label).isNotNull()).select(q(batch), q(label).alias("label"), F.posexplode(q(arr).cast("array<double>")).alias("_i", "_x"))
    means = cells.where(~F.isnan("_x")).groupBy(q(batch), "label", "_i").agg(F.avg("_x").alias("_m"))
    return means.groupBy(q(batch), "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda c: c["_m"]).alias("mean"))


def nearest_mean(df: DataFrame, models: DataFrame, batch: str = "batch", arr: str = ARR, out: str = "pred") -> DataFrame:
    """Rows of the batches that have a model, with the label of the nearest class mean (the smallest label among equals)."""

    def score(own: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("label")
        x, centre = np.array(data[arr].tolist(), float), np.array(own["mean"].tolist(), float)
        gap = np.stack([((x - c) ** 2).sum(axis=1) for c in centre], axis=1)
        data[out] = own["label"].to_numpy()[gap.argmin(axis=1)]
        return data

    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes if c != out)
    return apply_models(df.drop(out).where(q(arr).isNotNull()), models, batch, score, f"{fields}, `{out}` int")


def importance_change(spark, old: Forest, new: Forest, n: int = 10) -> DataFrame:
    """Top-n features of the new model with their importance in both models."""
    a = importances(old).select("feature", F.col("importance").alias("old"))
    b = importances(new).select("feature", F.col("importance").alias("new"))
    table = b.join(a, "feature", "left").select("feature", F.coalesce("old", F.lit(0.0)).alias("old"), "new")
    return table.withColumn("change", F.col("new") - F.col("old")).orderBy(F.desc("new"), "feature").limit(n)


def batch_drift(pred: DataFrame, order: Sequence[str], window: Sequence[tuple] = (), label: str = "label") -> tuple[bool, list[tuple]]:
    """ADWIN on the 0/1 errors of one batch, going on from the window of the batches before."""
    errors = pred.withColumn("_err", (q(label) != F.col("pred")).cast("int"))
    return adwin_resume(errors, order, "_err", window)


def strategies(
    df: DataFrame, order: Sequence[str], trees: int = 50, batch: str = "batch", arr: str = ARR, label: str = "label", depth: int = DEEPEST
) -> DataFrame:
    """Test-then-train over ordered batches: static, cumulative, window, drift-triggered.

    Every strategy is tested on a batch before it may learn from it; the first batch, which
    all were trained on, is marked ``in_sample``. The models of all batches (of each batch alone, and of all up to it)
    are grown in one job and kept as rows, every pair of model and later batch is scored in one pass, and the driver
    only chooses which pairs a strategy used.
    """
    with dropped_shuffles(df.sparkSession):
        return _strategies(df, order, trees, batch, arr, label, depth)


def _strategies(df: DataFrame, order: Sequence[str], trees: int, batch: str, arr: str, label: str, depth: int) -> DataFrame:
    data = settle(df.select(*[q(c) for c in dict.fromkeys([*order, batch, arr, label])]))
    numbers = [r[0] for r in data.select(q(batch)).distinct().orderBy(batch).collect()]
    place = F.element_at(F.create_map(*[F.lit(v) for i, b in enumerate(numbers) for v in (b, i)]), q(batch))
    placed = data.withColumn("_at", place)
    last = len(numbers) - 1
    names = F.concat(F.array(F.concat(F.lit("own "), "_at")), F.transform(F.sequence("_at", F.lit(last)), lambda b: F.concat(F.lit("upto "), b.cast("string"))))
    forest = fit_forests(placed.withColumn("_model", F.explode(names)).where("_model != 'upto 0'"), order, trees, depth, arr, label, "_model")
    own = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_at") - 1, F.lit(0))), lambda b: F.concat(F.lit("own "), b.cast("string")))
    asked = F.when(F.col("_at") > 1, F.concat(own, F.array(F.concat(F.lit("upto "), (F.col("_at") - 1).cast("string"))))).otherwise(own)
    scored = settle(predict_forests(placed.withColumn("_model", F.explode(asked)), forest, arr, "_model").drop(*{arr} - {*order, label, batch}))
    right = {(r["_at"], r["_model"]): float(r["accuracy"]) for r in accuracy(scored, ["_at", "_model"], label).collect()}
    rows, drift_model, window = [], "own 0", []
    for i, b in enumerate(numbers):
        drifted = False
        if i:
            pairs = scored.where((F.col("_at") == i) & (F.col("_model") == drift_model))
            drifted, window = batch_drift(pairs, order, window, label)
        used = {"static": "own 0", "cumulative": f"upto {i - 1}" if i > 1 else "own 0", "window": f"own {max(i - 1, 0)}", "drift": drift_model}
        rows += [(int(b), name, right[i, model], int(name == "drift" and drifted), i == 0) for name, model in used.items()]
        if drifted:
            drift_model = f"own {i}"
    return df.sparkSession.createDataFrame(rows, "batch int, strategy string, accuracy double, drift int, in_sample boolean")


def blended(base: Moments, own: Moments, weight: float) -> Moments:
    """Moments of a mixture that takes ``weight`` of its rows from ``own``."""
    mean = (1 - weight) * base.mean + weight * own.mean
    between = [np.outer(m.mean - mean, m.mean - mean) for m in (base, own)]
    return Moments(base.n, mean, (1 - weight) * (base.cov + between[0]) + weight * (own.cov + between[1]))


#: Micro-batches that one task walks when the model is carried on.
CARRY_BLOCK = 256


def _as_vector(m: Moments, origin: np.ndarray) -> np.ndarray:
    """Mean and second moments around an origin: blending is linear in these."""
    mean = m.mean - origin
    return np.concatenate([mean, (m.cov + np.outer(mean, mean)).ravel()])


def _from_vector(v: np.ndarray, origin: np.ndarray) -> Moments:
    d = len(origin)
    return Moments(1.0, v[:d] + origin, v[d:].reshape(d, d) - np.outer(v[:d], v[:d]))


def adaptation_losses(
    df: DataFrame, base: Moments, target: float | int = 0.90, weight: float = 0.5, batch: str = "batch", arr: str = ARR, carry: bool = False
) -> DataFrame:
    """Reconstruction loss of every micro-batch before and after adapting to it.

    The components are refitted on the model's covariance blended with the batch's own
    (``weight`` is the batch's part); both losses follow from the batch's moments, which are
    summed on the executors for batches of any size. Every batch starts from the base model
    again, or, with ``carry``, from what the batch before left: blocks of batches are composed
    first, one row per block is walked, and then all blocks are walked at once.
    """
    pca: Pca = fit_pca(base, target)
    d = len(base.mean)
    kind = dict(df.dtypes)[batch]
    schema = f"`{batch}` {kind}, n long, loss_before double, loss_after double"
    names = [batch, "n", "loss_before", "loss_after"]
    per_batch = packed_moments(df, base.mean, arr, [batch])

    def own(packed: object) -> Moments:
        return unpack(np.asarray(packed, dtype=float), base.mean)

    def adapted(mixed: Moments) -> Pca:
        return fit_pca(mixed, pca.k, scale=base)

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, m in zip(pdf[batch], map(own, pdf["packed"])):
                rows.append((k, int(m.n), residual_mse(m, pca), residual_mse(m, adapted(blended(base, m, weight)))))
            yield pd.DataFrame(rows, columns=names)

    if not carry:
        return per_batch.mapInPandas(alone, schema)

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(d + d * d)
        for m in map(own, pdf.sort_values("_rn")["packed"]):
            total = (1 - weight) * total + weight * _as_vector(m, base.mean)
        return pd.DataFrame([(int(pdf["_block"].iloc[0]), (1 - weight) ** len(pdf), total.tolist())], columns=["_block", "fade", "gain"])

    def starts(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for block, fade, gain in zip(pdf["_block"], pdf["fade"], pdf["gain"]):
            rows.append((block, state["model"].tolist()))
            state["model"] = fade * state["model"] + np.asarray(gain, dtype=float)
        return pd.DataFrame(rows, columns=["_block", "model"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        model, rows = np.asarray(pdf["model"].iloc[0], dtype=float), []
        # the base model itself keeps its own components
        old = pca if int(pdf["_block"].iloc[0]) == 0 else adapted(_from_vector(model, base.mean))
        pdf = pdf.sort_values("_rn")
        for k, m in zip(pdf[batch], map(own, pdf["packed"])):
            model = (1 - weight) * model + weight * _as_vector(m, base.mean)
            new = adapted(_from_vector(model, base.mean))
            rows.append((k, int(m.n), residual_mse(m, old), residual_mse(m, new)))
            old = new
        return pd.DataFrame(rows, columns=names)

    placed = settle(ranked(per_batch, [batch], out="_rn").withColumn("_block", F.floor((F.col("_rn") - 1) / CARRY_BLOCK).cast("long")))
    blocks = placed.groupBy("_block").applyInPandas(composed, "_block long, fade double, gain array<double>").withColumn("_stream", F.lit(0))
    begun = keyed_fold(blocks, ["_stream"], ["_block"], lambda _: {"model": _as_vector(base, base.mean)}, starts, "_block long, model array<double>")
    return placed.join(begun, "_block").groupBy("_block").applyInPandas(walk, schema)
