"""Structured Streaming queries: replayed files, windows, keyed state, batch callbacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from driftloom.functions.names import q
from driftloom.operators.features import Spec, window_features
from driftloom.operators.ranks import prefixed, same_group
from driftloom.operators.sequence import moving, prequential
from driftloom.session import settle, work_path
from driftloom.sources.ordered import ordered_stream
from driftloom.sources.readers import BATCH_FILE, parse_libsvm_text


def parquet_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def libsvm_stream(spark: SparkSession, folder: str, width: int = 128) -> DataFrame:
    """Batch files one at a time by their number (batch10 after batch9), as (batch, label, features); other files are
    passed over. A restarted query goes on with the next number."""
    return parse_libsvm_text(ordered_stream(spark, folder, pattern=BATCH_FILE), width)


def _to_the_end(writer: DataStreamWriter) -> None:
    """Run until everything that is there is done. A source that gives one batch at a time gives them all."""
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def replay(df: DataFrame, name: str, mode: str = "append", into: str | None = None) -> DataFrame:
    """Run a streaming frame over everything that is there, in order, then stop; read the result.

    Result and progress go to the shared work folder. With a named folder ``into`` a restarted
    query goes on where the lost one stopped; without one every run starts anew.
    """
    spark = df.sparkSession
    path = into or work_path(spark, name)
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path)
    _to_the_end(writer.option("checkpointLocation", f"{path}-progress"))
    return spark.read.schema(df.schema).parquet(path)


def for_each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], name: str, into: str | None = None) -> None:
    """Give every micro-batch to ``handle`` as an ordinary frame, once all files are done stop.

    With a named folder ``into`` a restarted query goes on after the last micro-batch that ended; the one in which it
    stopped is given again, with the same number and rows. Without one every run starts anew.
    """
    path = into or work_path(df.sparkSession, name)
    _to_the_end(df.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}-progress"))


def replay_latest(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Result of an update-mode aggregate: every change is stored, the last one per key is read."""
    spark = df.sparkSession
    path = work_path(spark, name)

    def store(changes: DataFrame, number: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        changes.withColumn("_at", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    _to_the_end(df.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}-progress"))
    schema = T.StructType([*df.schema.fields, T.StructField("_at", T.LongType())])
    stored = spark.read.option("basePath", path).schema(schema).parquet(path)
    rest = [c for c in df.columns if c not in keys]
    newest = stored.groupBy(*[q(k) for k in keys]).agg(F.max_by(F.struct(*rest), "_at").alias("_last"))
    return newest.select(*[q(k) for k in keys], "_last.*")


def tumbling(stream: DataFrame, specs: Sequence[Spec], keys: Sequence[str], time: str, width: str = "8 hours", late: str = "1 day") -> DataFrame:
    """The batch window aggregate on a stream; rows later than ``late`` are dropped."""
    return window_features(stream.withWatermark(time, late), specs, keys, time, width)


#: What ``carried`` runs on a micro-batch: its rows and the state before it, giving the result and the state after it.
Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def carried(stream: DataFrame, step: Step, name: str, into: str | None = None) -> DataFrame:
    """Run ``step`` on every micro-batch, with the state that the one before it left; give all results.

    State and result of a micro-batch are tables in folders of its own below ``into``, beside the stream's progress, so
    nothing is held between micro-batches and a repeated one overwrites its own. The state is written whole by every
    micro-batch: take few large ones where it has many keys. A restarted query goes on from the last complete one.
    """
    spark = stream.sparkSession
    path = into or work_path(spark, name)
    empty = spark.createDataFrame([], stream.schema)
    result, state = (df.schema for df in step(empty, None))

    def handle(rows: DataFrame, number: int) -> None:
        before = spark.read.schema(state).parquet(f"{path}/state/part={number - 1}") if number else None
        out, after = step(settle(rows), before)
        out.write.mode("overwrite").parquet(f"{path}/rows/part={number}")
        after.write.mode("overwrite").parquet(f"{path}/state/part={number}")

    for_each_batch(stream, handle, name, path)
    try:
        return spark.read.option("basePath", f"{path}/rows").schema(result).parquet(f"{path}/rows").select(*result.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], result)


def sliding(stream: DataFrame, cell: str, time: str, cols: Sequence[str], size: int, tie: str, into: str | None = None) -> DataFrame:
    """Full windows of ``size`` rows per cell, in the order of micro-batches, then of ``time`` and ``tie``.

    The state is the last size - 1 rows of each cell. Inside a micro-batch the rows of a large cell are cut into blocks
    with the rows they look back on, so no task holds a cell as a whole. A missing cell is a cell of its own.
    """
    order = ["_at", time, tie]  # state rows come first, numbered from the back

    def step(rows: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = rows.select(q(cell), F.lit(0).alias("_at"), q(time), q(tie), F.array(*[q(c).cast("double") for c in cols]).alias("_x"))
        both = new if before is None else new.unionByName(before)
        full = moving(both, order, {"win": lambda w: F.collect_list("_x").over(w)}, [cell], back=size - 1)
        full = full.where((F.col("_at") == 0) & (F.size("win") == size))
        back = Window.partitionBy(q(cell)).orderBy(*[q(c).desc() for c in order])
        last = both.withColumn("_back", F.row_number().over(back)).where(F.col("_back") < size)
        return (
            full.select(q(cell), F.date_trunc("second", q(time)).alias("END_TIME"), q(tie), "win"),
            last.select(q(cell), (-F.col("_back")).alias("_at"), q(time), q(tie), "_x"),
        )

    return carried(stream, step, "sliding", into)


def faded_counters(
    stream: DataFrame, key: str, order: Sequence[str], fade: float = 0.99, label: str = "label", pred: str = "pred", into: str | None = None
) -> DataFrame:
    """Prequential recall, specificity, G-mean per key, in the order of micro-batches, then of ``order``.

    The state is four counters a key. Inside a micro-batch the counters are composed from blocks of rows, so no task
    holds a key as a whole. A missing key is a key of its own.
    """
    four = ["tp", "fn", "tn", "fp"]

    def step(rows: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        scored = prequential(rows.select(q(key), *[q(c) for c in order], q(label), q(pred)), order, [key], fade, label, pred, before=before, counters=True)
        scored = settle(scored)  # read for the result and for the state
        last = scored.groupBy(q(key)).agg(F.max_by(F.struct(*four), F.struct(*[q(c) for c in order])).alias("_last")).select(q(key), "_last.*")
        if before is not None:
            last = last.unionByName(before.join(prefixed(last, [key], "_h_").select(f"_h_{key}"), same_group([key], "_h_"), "left_anti"))
        return scored.select(q(key), q(order[-1]), "recall", "specificity", "gmean"), last

    return carried(stream, step, "faded", into)
