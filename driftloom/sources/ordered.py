"""Batches of files as a stream in the order of their numbers, whatever the order in which they were written.

A batch is a file or a folder of files below one root, with a number in its name. The stream's offset is the number of
the last batch taken, so a micro-batch is exactly one batch, and a restarted query goes on with the next number. The
files of a batch are read side by side, one task a file, a few thousand rows at a time.
"""

from __future__ import annotations

import io
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The classes below travel whole, so a session that was built elsewhere, without this package on its workers, can run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Folders as ``partitionBy("number")`` writes them.
NUMBERED = r"number=(-?\d+)$"
#: Rows, or lines, that a task holds at once.
ROWS = 4096


class BatchFile(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _hidden(info: fs.FileInfo) -> bool:
    return info.base_name.startswith(("_", "."))


class OrderedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.root, self.pattern, self.kind = options["path"], re.compile(options.get("pattern", NUMBERED)), options.get("kind", "parquet")
        self.schema, self.at = schema, None

    def batches(self) -> dict[int, fs.FileInfo]:
        """The batches that are there; other files are passed over."""
        where, root = _located(self.root)
        found = where.get_file_info(fs.FileSelector(root))
        return {int(m[1]): f for f in found if not _hidden(f) and (m := self.pattern.search(f.base_name))}

    def initialOffset(self) -> dict:
        return {"batch": None}

    def latestOffset(self) -> dict:
        """One batch further than the last one, so a micro-batch never holds two."""
        self.at = min((n for n in self.batches() if self.at is None or n > self.at), default=self.at)
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[BatchFile]:
        first, last = start["batch"], end["batch"]
        self.at = last  # after a restart the engine begins with the batch it stopped in
        where, _ = _located(self.root)
        out = []
        for n, info in sorted(self.batches().items()):
            if last is None or n > last or (first is not None and n <= first):
                continue
            inside = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(info.path, recursive=True))
            out += [BatchFile(f.path, n) for f in inside if f.type == fs.FileType.File and f.size and not _hidden(f)]
        return out

    def commit(self, end: dict) -> None:
        self.at = end["batch"]

    def read(self, partition: BatchFile) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        where, _ = _located(self.root)
        if self.kind == "text":
            with where.open_input_stream(partition.path, compression="detect") as raw:
                yield from ((line.rstrip("\r\n"), partition.number) for line in io.TextIOWrapper(raw, encoding="utf-8", newline="\n"))
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        with where.open_input_file(partition.path) as raw:
            for b in pq.ParquetFile(raw).iter_batches(ROWS, columns=want.names):
                yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type, safe=False) for f in want], schema=want)


class OrderedBatches(DataSource):
    """Options ``path``, ``pattern`` (its first group is the number) and ``kind`` (``parquet`` or ``text``)."""

    @classmethod
    def name(cls) -> str:
        return "ordered_batches"

    def schema(self) -> str:
        return "value string, batch int"

    def streamReader(self, schema: T.StructType) -> OrderedReader:
        return OrderedReader(dict(self.options), schema)


def ordered_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, pattern: str = NUMBERED) -> DataFrame:
    """The batches below ``path`` as a stream, one a micro-batch, by number: Parquet files with ``schema``, or without one
    the lines of text files as (value, batch)."""
    spark.dataSource.register(OrderedBatches)
    reader = spark.readStream.format(OrderedBatches.name()).option("path", path).option("pattern", pattern)
    return reader.schema(schema).load() if schema is not None else reader.option("kind", "text").load()
