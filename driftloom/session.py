"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Parquet files written by old calendars are read as they are (no shift of dates).
REBASE_CONF = {
    "spark.sql.parquet.int96RebaseModeInRead": "CORRECTED",
    "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that it need not be installed or on their path.

    The archive lies on the driver only until Spark's file server has it.
    """
    sc = spark.sparkContext
    if any(name.startswith("driftloom-") for name in sc._python_includes):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="driftloom-"), f"driftloom-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def build_session(app: str = "driftloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect, whose executors have this package; extra ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **REBASE_CONF,
        **{k: str(v) for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """Window borders and NTZ casts depend on the session zone, so it is always UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, where the driver's disk is everybody's disk, may go
    without the setting; a cluster session must name a shared folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="driftloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, folders: Sequence[str] = ()) -> DataFrame:
    """Write a frame that several later jobs read to the shared folder and read it back.

    The lineage ends at the files: a lost executor costs a re-read and not a re-computation,
    every reader sees the very same rows, and reads only the columns it needs. ``folders``
    are columns with few values by which the files are laid out.
    """
    path = work_path(df.sparkSession, "table")
    out = df.hint("rebalance", *folders) if folders else df
    out.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_in_turn(frames: Iterable[DataFrame]) -> DataFrame:
    """``settle`` for frames of one schema, one after another into one folder."""
    path, first = "", None
    for df in frames:
        first, path = first or df, path or work_path(df.sparkSession, "table")
        df.write.mode("append").parquet(path)
    return first.sparkSession.read.schema(first.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a job go as soon as it has written or returned its rows. Otherwise they stay until the
    driver happens to collect its garbage, and those of many jobs lie beside each other."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
