"""Packing token pieces into sequences by minimum bin slack.

Only lengths matter for the plan: a histogram of piece lengths (at most as many rows as a sequence has tokens) goes to
the driver. For each bin the longest length left is the seed, and a bitset of reachable sums over the lengths left finds
the fullest combination with it; the combination is removed as often as the histogram allows at once. The pieces then
find their place on the executors: the n-th piece of a length goes to the n-th place that the plan has for that length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.text import column, two_columns
from driftloom.session import settle

SEQUENCE = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


@cache
def encoder(path: str):
    """Text to ids of the tokenizer file ``path``.

    Where the same vocabulary lies beside it as ranks, the faster library reads those and gives the same ids; texts with
    the string of a special token always go to the tokenizer itself.
    """
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    whole = Tokenizer.from_file(path)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than ``longest``."""
    first = n % longest or min(n, longest)
    return [(0, first), *((s, longest) for s in range(first, n, longest))]


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document. ``part`` and ``nth`` number the pieces of a length within the task that wrote them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer), np.zeros(longest + 1, dtype=np.int64), TaskContext.get().partitionId()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), longest)):
                    out.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in PIECES.split(", ")])

    return two_columns(df, id_col, text_col).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of lengths left, with the longest among them, whose sum is the largest up to ``capacity``."""
    seed = max(counts)
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach = [1]  # bit s: the lengths so far can fill s
    used = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        for _ in range(left):
            new = (reach[-1] | reach[-1] << length) & mask
            if new == reach[-1]:
                break
            reach.append(new)
            used.append(length)
        if reach[-1] >> room & 1:
            break
    chosen = {seed: 1}
    at = reach[-1].bit_length() - 1
    for k in range(len(used), 0, -1):
        if not reach[k - 1] >> at & 1:
            chosen[used[k - 1]] = chosen.get(used[k - 1], 0) + 1
            at -= used[k - 1]
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) until no length is left. Each entry uses up a length or all but a few of it, so the plan
    grows with the number of lengths and not with the number of pieces."""
    left = {k: n for k, n in histogram.items() if n}
    plan = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[k] // n for k, n in chosen.items())
        plan.append((times, chosen))
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces per bin, first bin, offset in the bin) for each length of each entry, by rank."""
    rank: dict[int, int] = {}
    out, first_bin = [], 0
    for times, chosen in plan:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            out.append((length, rank.get(length, 0), n, first_bin, offset))
            rank[length] = rank.get(length, 0) + times * n
            offset += length * n
        first_bin += times
    return sorted(out)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    A null or empty text is one piece that holds the end id only; rows with equal or null ids are packed as any others; an empty table gives an empty
    result.
    """
    pieces = settle(token_pieces(df, tokenizer, id_col, text_col, longest, end_id))
    counts = settle(pieces.groupBy("part", "length").count())
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `longest` rows
    spots = places(plan_bins(histogram, longest))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    offsets = counts.select(F.col("part").alias("of_part"), F.col("length").alias("of_length"), before.alias("before"))
    ranked = pieces.join(offsets, (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length")))
    table = np.array(spots, dtype=np.int64).reshape(-1, 5)  # a few rows for each length
    key = table[:, 0] << 48 | table[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
                at = np.searchsorted(key, length << 48 | rank, side="right") - 1
                _, first, n, first_bin, offset = table[at].T
                sequence = first_bin + (rank - first) // n
                place = offset + (rank - first) % n * length
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(place)], names)

    rows = ranked.select(*[column(c) for c in names[:5]], (F.col("nth") + F.col("before")).alias("rank"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
