"""Removal of repeated byte strings with a run-length compressed index.

A bucket's strings become one text with a Burrows-Wheeler transform that is kept as runs of equal characters, with the
suffix array sampled at both ends of every run and nowhere else. Where a run starts, the suffix's common prefix with the
suffix before it is compared character by character; where a run ends, with the one after it. All other positions follow
by streaming over the text: inside a run the match of a position is the match of the position before it, one shorter. So
matching statistics of the whole text cost as many comparisons as there are runs, which in a repetitive corpus are few.
A position whose match is as long as a window is a repeated window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm.repeats import NO_ID, PIECE, by_document, covered, cut_pieces, keyed, piece_batch, repeated_spans
from driftloom.llm.text import mix, slices, utf8

WINDOW = 200
K = 32
#: Windows per cut where a minimiser has very many surroundings.
CUT = 8
#: Bytes of text hashed at once; a longer text is cut with an overlap of a window.
STRETCH = 1 << 17
#: Bytes of strings per index.
INDEX_BYTES = 1 << 17

_BYTE = mix(np.arange(256, dtype=np.uint64), 51)
_BYTE_2 = mix(np.arange(256, dtype=np.uint64), 52)
_FACTOR = 0xD6E8FEB86659FD93


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to the stretch: bytes, and per part its text's number, its place in the text, and its length."""
    parts, size = [], 0

    def joined():
        which, offset, data = zip(*parts)
        return np.frombuffer(b"".join(data), np.uint8), np.array(which), np.array(offset), np.array([len(d) for d in data])

    for i, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, STRETCH):
            part = text[at : at + STRETCH + WINDOW - 1]
            parts.append((i, at, part))
            size += len(part)
            if size >= STRETCH:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def byte_pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimiser, digest, number of the text, start, windows, place of the minimiser in the piece)."""
    for data, which, offset, length in stretches(texts):
        h, width, factor = _BYTE[data], 1, _FACTOR
        while width < K:
            h = h[:-width] * np.uint64(factor) + h[width:]
            width, factor = 2 * width, (factor * factor + 2) & ((1 << 64) - 1)
        key, digest, part, start, windows, at = cut_pieces(mix(h, 53), _BYTE_2[data], length, WINDOW, K)
        yield key, digest, which[part], start + offset[part], windows, at


def document_pieces(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column(0).to_numpy()
            for key, digest, which, start, windows, at in byte_pieces(utf8(b.column(1))):
                yield piece_batch([key, digest, ids[which], start, windows, at])

    return docs.mapInArrow(run, PIECE)


def cut_out(text: bytes, asked: list[tuple[int, int]]) -> list[bytes]:
    return [text[s : s + n + WINDOW - 1] for s, n in asked]


@dataclass
class RunLengthIndex:
    """Runs of the transform: their characters, and the suffixes at their first and last rows."""

    text: np.ndarray
    heads: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``; a separator ends every match."""
        out = np.zeros(len(a), np.int64)
        open_, n = np.arange(len(a)), len(self.text)
        k = 0
        while len(open_):
            x, y = a[open_] + k, b[open_] + k
            ok = np.maximum(x, y) < n
            ok[ok] = (self.text[x[ok]] == self.text[y[ok]]) & (self.text[x[ok]] > 0)
            out[open_[~ok]] = k
            open_ = open_[ok]
            k += 1
        return out

    def matches(self) -> np.ndarray:
        """For every position of the text the longest match that also starts elsewhere, by streaming over the text."""
        n = len(self.text)
        met = self.common_prefix(self.last[:-1], self.first[1:])
        best = np.zeros(n, np.int64)
        for sample, value in ((self.first, np.concatenate([[0], met])), (self.last, np.concatenate([met, [0]]))):
            reach = np.zeros(n, np.int64)
            reach[sample] = sample + value
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(n))
        return best


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: ranks by the first characters decide ranks by twice as many."""
    n = len(text)
    width, key = 7, np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(width, np.int64)])
    for j in range(width):
        key = key << 9 | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 1) + after
        width *= 2


def build_index(strings: list[bytes]) -> RunLengthIndex:
    """Index of the strings, each followed by a separator (0; a byte b is b + 1)."""
    text = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    text = np.insert(text, np.cumsum([len(s) for s in strings]), 0)
    order = suffix_order(text)
    before = np.where(order > 0, text[order - 1], -1)  # the transform; the whole text's own row stands alone
    # a separator before a suffix says nothing about the suffix before it, so these rows are runs of their own
    edge = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] <= 0)])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(order)) - 1
    return RunLengthIndex(text, before[first], order[first], order[last])


def long_matches(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Runs of windows of the strings that also start elsewhere in them."""
    index = build_index([string for *_, string in rows])
    hit = index.matches() >= WINDOW
    at = 0
    for _, doc, start, string in rows:
        own = np.concatenate([[0], hit[at : at + len(string)], [0]]).astype(np.int8)
        turn = np.flatnonzero(np.diff(own))
        for a, b in zip(turn[::2], turn[1::2]):
            yield doc, start + int(a), int(b - a)
        at += len(string) + 1


def remove_long_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (bytes), one row for each input row.

    Texts are UTF-8 bytes (null: empty). A byte goes if a 200-byte string that covers it also starts anywhere else, in
    another document or in the same one; overlapping occurrences count, matches never cross documents, and strings are
    judged as given. Rows with equal ids are copies of each other: what is found in one of them goes in all. Null ids are
    told apart by their texts. An empty table gives an empty result.
    """
    docs = keyed(df, id_col, text_col)
    spans = repeated_spans(document_pieces(docs), docs, cut_out, long_matches, WINDOW, CUT, first_stays=False, chunk=INDEX_BYTES)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, spans in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()):
            gone = covered(len(text), spans, WINDOW)
            runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            rows.append((None if doc >= NO_ID else doc, len(text), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return by_document(docs, spans, batch, schema)
