"""Run log and metric gauges as long Parquet tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, experiment string, kind string, key string, value string, step long, ts timestamp"
METRIC_SCHEMA = "name string, batch long, value double"


@dataclass
class RunLog:
    """Facts about one run; gathered on the driver, appended once at the end."""

    spark: SparkSession
    path: str
    experiment: str
    name: str = ""
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    rows: list[tuple] = field(default_factory=list)

    def _add(self, kind: str, key: str, value: object, step: int | None = None) -> None:
        now = datetime.now(timezone.utc)
        self.rows.append((self.run_id, self.experiment, kind, key, str(value), step, now))

    def param(self, key: str, value: object) -> None:
        self._add("param", key, value)

    def tag(self, key: str, value: object) -> None:
        self._add("tag", key, value)

    def metric(self, key: str, value: float, step: int | None = None) -> None:
        self._add("metric", key, repr(float(value)), step)

    def flush(self) -> None:
        self.spark.createDataFrame(self.rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.rows = []


@contextmanager
def logged_run(spark: SparkSession, path: str, experiment: str, name: str = ""):
    """A run whose success flag, error text and duration are always written."""
    run = RunLog(spark, path, experiment, name)
    if name:
        run.tag("run_name", name)
    start = time.monotonic()
    try:
        yield run
        run.param("success", "yes")
    except Exception as err:
        run.param("success", "no")
        run.param("error", err)
        raise
    finally:
        run.metric("execution_time_seconds", time.monotonic() - start)
        run.flush()


def append_gauges(spark: SparkSession, path: str, batch: int | None, values: Mapping[str, float], mode: str = "append") -> None:
    """One row per gauge; ``batch`` is None for gauges without a batch label."""
    rows = [(k, batch, float(v)) for k, v in values.items()]
    spark.createDataFrame(rows, METRIC_SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def append_metrics(report: DataFrame, path: str, run_id: str, experiment: str, key: str = "metric", value: str = "value", step: str | None = None) -> None:
    """Append a report's (metric, value) rows to the run table; ``step`` is its batch column."""
    rows = report.select(
        F.lit(run_id).alias("run_id"), F.lit(experiment).alias("experiment"), F.lit("metric").alias("kind"),
        F.col(key).alias("key"), F.col(value).cast("string").alias("value"),
        (F.col(step) if step else F.lit(None)).cast("long").alias("step"), F.current_timestamp().alias("ts"),
    )
    rows.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def best_run(runs: DataFrame, metric: str = "train_loss", lowest: bool = True) -> DataFrame:
    """Run with the best last value of a metric; equal values go to the smaller run id."""
    value = F.col("value").try_cast("double")
    last = (
        runs.where((F.col("kind") == "metric") & (F.col("key") == metric))
        .groupBy("experiment", "run_id")
        .agg(F.max_by(value, F.struct("step", "ts")).alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    order = F.struct((F.col("value") if lowest else -F.col("value")).alias("v"), F.col("run_id"))
    return last.groupBy("experiment").agg(F.min_by("run_id", order).alias("run_id"), F.min_by("value", order).alias("value"))


def compare_runs(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run, one column per metric (last value)."""
    return (
        runs.where(F.col("kind") == "metric")
        .groupBy("run_id")
        .pivot("key", metrics)
        .agg(F.max_by(F.col("value").try_cast("double"), F.struct("step", "ts")))
    )


def backfill_tag(runs: DataFrame, tag: str, by_name: Mapping[str, str]) -> DataFrame:
    """Add ``tag`` rows to runs that lack it, chosen by the run's name; other rows stay."""
    marks = (
        runs.where(F.col("kind") == "tag")
        .groupBy("run_id", "experiment")
        .agg(
            F.max(F.when(F.col("key") == "run_name", F.col("value"))).alias("name"),
            F.max(F.when(F.col("key") == tag, F.col("value"))).alias("old"),
            F.max("ts").alias("ts"),
        )
        .where(F.col("old").isNull())
    )
    chosen = F.coalesce(*[F.when(F.col("name") == n, F.lit(v)) for n, v in by_name.items()])
    added = marks.withColumn("value", chosen).where(F.col("value").isNotNull()).select(
        "run_id", "experiment", F.lit("tag").alias("kind"), F.lit(tag).alias("key"), "value",
        F.lit(None).cast("long").alias("step"), "ts",
    )
    return runs.unionByName(added)


def cumulative_counts(per_batch: DataFrame, batch: str = "batch", count: str = "n", out: str = "processed") -> DataFrame:
    """Running number of processed rows over a per-batch report (one row per batch)."""
    from driftloom.operators.ranks import running

    return running(per_batch, [batch], {out: ("sum", F.col(count))})
