"""Removal of repeated word windows by super-k-mers.

Consecutive windows of a document that share a minimiser travel as one packed string of words to the minimiser's bucket,
where their windows are sorted and the equal ones counted exactly. The first occurrence of a window stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm.repeats import NO_ID, PIECE, covered, cut_pieces, keyed, piece_batch, repeated_spans, with_spans
from driftloom.llm.text import WordHashes, map_batches, mix, slices, utf8

WINDOW = 20
K = 4
#: Windows per cut where a minimiser has very many surroundings.
CUT = 4
#: Words cut into pieces at once; a longer text is cut with an overlap of a window.
STRETCH = 1 << 16


def pieces_of(w: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimiser, digest, text, start, windows, place of the minimiser in the piece) of the super-k-mers of texts that lie
    one behind the other, given as word hashes."""
    n = max(len(w) - K + 1, 0)
    h = mix(w[:n], 31)
    for j in range(1, K):
        h = mix(h ^ w[j : n + j], 31 + j)
    return cut_pieces(h, mix(w, 41), length, WINDOW, K)


def word_pieces(docs: DataFrame) -> DataFrame:
    def cut(held: list[tuple[int, int, list[bytes]]], hashes: WordHashes) -> pa.RecordBatch:
        length = np.array([len(words) for *_, words in held])
        w = hashes.of([word for *_, words in held for word in words])
        key, digest, part, start, windows, at = pieces_of(w, length)
        doc, offset = (np.array(c, dtype=np.int64) for c in zip(*[(doc, offset) for doc, offset, _ in held]))
        return piece_batch([key, digest, doc[part], start + offset[part], windows, at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                words = text.split()
                for at in range(0, len(words) - WINDOW + 1, STRETCH):
                    held.append((doc, at, words[at : at + STRETCH + WINDOW - 1]))
                    size += len(held[-1][2])
                    if size >= STRETCH:
                        yield cut(held, hashes)
                        held, size = [], 0
        if held:
            yield cut(held, hashes)

    return docs.mapInArrow(run, PIECE)


def packed(text: bytes, asked: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[s : s + n + WINDOW - 1]) for s, n in asked]


def sorted_windows(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Windows that equal an earlier one: sort all windows of the strings; in each run of equal ones the first stays."""
    windows = []
    for _, doc, start, string in rows:
        words = string.split(b" ")
        windows += [(b" ".join(words[j : j + WINDOW]), doc, start + j) for j in range(len(words) - WINDOW + 1)]
    windows.sort()
    for before, this in zip(windows, windows[1:]):
        if before[0] == this[0] and before[1:] != this[1:]:
            yield this[1], this[2], 1


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text``, one row for each input row.

    A word goes if a window of 20 words that covers it also starts earlier: in a document with a smaller id, or before
    it in the same one. Texts are judged as given, not by what is left. Null and short texts lose nothing; null ids
    come last; rows with equal ids (or with null ids and equal texts) count as one document, so that what goes in one of
    them goes in all. An empty table gives an empty result.
    """
    docs = keyed(df, id_col, text_col)
    spans = repeated_spans(
        word_pieces(docs), docs, packed, sorted_windows, WINDOW, CUT, first_stays=True, units=lambda s: s.split(b" "), glue=lambda u: b" ".join(u)
    )

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, spans in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()):
            words = text.split()
            gone = covered(len(words), spans, WINDOW)
            kept = b" ".join(w for w, out in zip(words, gone) if not out) if spans else b" ".join(words)
            rows.append((None if doc >= NO_ID else doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    some, none = with_spans(docs, spans)
    columns = ["doc", "text", "spans"]
    return map_batches(some.select(columns), batch, schema).unionByName(map_batches(none.select(columns), batch, schema))
