"""Stream of batches: test on the batch, watch the errors, retrain on drift, log gauges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.adapt import DEEPEST, batch_drift, fit_forest, predict
from driftloom.operators.forests import Forest
from driftloom.operators.metrics import accuracy, macro_scores
from driftloom.session import settle, work_path
from driftloom.sinks.runs import METRIC_SCHEMA, append_gauges
from driftloom.streaming.pipelines import for_each_batch

#: What a micro-batch leaves to the next: where the model lies, and the buckets of the error window.
STATE = "model string, window array<struct<level: int, n: double, s: double, ss: double>>"


def write_state(spark: SparkSession, path: str, number: int, model: str | None, window: Sequence[tuple]) -> None:
    """The state after micro-batch ``number``, in a folder of its own: a repeated one overwrites it."""
    spark.createDataFrame([(model, [tuple(b) for b in window])], STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/part={number}")


def state_before(spark: SparkSession, path: str, number: int) -> tuple[str | None, list[tuple]]:
    """The state that the micro-batches before ``number`` left."""
    try:
        stored = spark.read.schema(f"{STATE}, part long").parquet(f"{path}/state")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, []
    last = stored.where(F.col("part") < number).orderBy(F.desc("part")).first()
    return (last["model"], [tuple(b) for b in last["window"]]) if last else (None, [])


def drift_loop(
    stream: DataFrame, order: Sequence[str], trees: int = 50, batch: str = "batch", arr: str = "features", label: str = "label", depth: int = DEEPEST,
    into: str | None = None,
) -> DataFrame:
    """Gauges (name, batch, value) of a replayed stream whose micro-batches are its batches.

    The first batch trains the model; each later one is predicted first, and replaces the
    model when ADWIN finds a change in its errors. Model, error window and gauges of a micro-batch are written below
    ``into``, beside the stream's progress, and read by the next one: nothing is held between micro-batches, so a run
    that stopped anywhere goes on when it is started again with the same folder.
    """
    spark = stream.sparkSession
    path = into or work_path(spark, "drift-loop")

    def handle(rows: DataFrame, number: int) -> None:
        cur = settle(rows)  # several jobs read the same micro-batch
        head = cur.agg(F.min(batch).alias("b"), F.count("*").alias("n")).first()
        if not head["n"]:
            return
        model, window = state_before(spark, path, number)
        gauges = {"current_batch": head["b"], "batch_samples": head["n"], "drift_detected": 0, "retrain_performed": 0}
        drifted = model is None
        if model is not None:
            pred = settle(predict(Forest.load(model), cur, arr))
            acc = accuracy(pred, label=label).first()
            macro = macro_scores(pred, label=label).first()
            drifted, window = batch_drift(pred, order, window, label)
            gauges |= {
                "model_accuracy": acc["accuracy"], "model_error_rate": acc["error_rate"],
                "model_f1_macro": macro["f1_macro"], "model_precision_macro": macro["precision_macro"],
                "model_recall_macro": macro["recall_macro"],
                "drift_detected": int(drifted), "retrain_performed": int(drifted),
            }
        if drifted:
            model = f"{path}/models/{number}"
            fit_forest(cur, trees, depth, arr, label, ids=order).save(model)
        # The micro-batch owns its folders, so a repeated one overwrites its own gauges and state only.
        append_gauges(spark, f"{path}/gauges/part={number}", int(head["b"]), gauges, "overwrite")
        write_state(spark, path, number, model, window)

    for_each_batch(stream, handle, "drift-loop", path)
    stored = spark.read.option("basePath", f"{path}/gauges").schema(METRIC_SCHEMA).parquet(f"{path}/gauges")
    return stored.select("name", "batch", "value")
