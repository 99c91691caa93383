"""Helpers shared by the corpus operators: input columns, words, hashes and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: A word is a run of anything but these six ASCII characters; ``bytes.split()`` cuts at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a pattern for Spark and for SQL.
WORD = "[^\\x20\\x09-\\x0D]+"

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns of the input can't clash with an operator's own."""
    return df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))


def utf8(array: pa.Array) -> list[bytes]:
    """The texts of a batch as UTF-8; null is the empty text."""
    return [b"" if t is None else t for t in array.cast(pa.binary()).to_pylist()]


#: Rows that a task turns into Python objects at once.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, which bounds what a task holds beside Spark's own batch."""
    for b in batches:
        for s in range(0, b.num_rows, ROWS):
            yield b.slice(s, ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, slices(batches))

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix of ``x`` (uint64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash; keeps the words it has seen, up to a bound, so that frequent ones are hashed once."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def lower_ascii(text: bytes) -> bytes:
    """A-Z only; ``bytes.lower`` leaves all bytes above 127 alone."""
    return text.lower()


def hashed_batches(df: DataFrame, fn: Callable[[pa.RecordBatch, WordHashes], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch of ``df``, with the word hashes of the whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            yield fn(batch, hashes)

    return df.mapInArrow(run, schema)
