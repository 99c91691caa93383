"""Repeated byte strings against brute force; the index against all-pairs comparison."""

import hashlib
import random
from collections import Counter

import pytest

from driftloom.llm import repeats, rlindex
from driftloom.llm.queries import QUERIES
from driftloom.llm.rlindex import WINDOW, build_index, byte_pieces, remove_long_repeats

SF = "/root/testdata/sf0.001"


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(t[i : i + WINDOW] for _, t in texts for i in range(len(t) - WINDOW + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - WINDOW + 1):
            if times[t[i : i + WINDOW]] > 1:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force_on_its_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = sorted((tuple(r) for r in QUERIES["op1_long_repeats"](spark, SF).collect()), key=str)
    assert out == brute(rows) and sum(r[2] > 0 for r in out) > 5


@pytest.mark.parametrize("most", [1000, 3])
def test_passages_in_many_surroundings(spark, monkeypatch, most):
    """With a small bucket bound every shared minimiser is dealt anew."""
    monkeypatch.setattr(repeats, "BUCKET", most)
    rng = random.Random(8)
    letters = "abcdefghij é"
    passage = "".join(rng.choices(letters, k=420))
    texts = []
    for _ in range(40):
        cut = passage[rng.randint(0, 80) : rng.randint(240, 420)]
        texts.append("".join(rng.choices(letters, k=rng.randint(0, 150))) + cut + "".join(rng.choices(letters, k=rng.randint(0, 150))))
    texts += ["x" * 700, "xy" * 300, "abc" * 67, "x" * 199, "tail " * 90 + passage]
    rows = list(enumerate(texts))
    out = remove_long_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("kept").collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows)


def test_edges(spark):
    long = " ".join(str(i) for i in range(20_000))
    schema = "doc_id long, text string, key string, spans string"
    rows = [(1, None), (2, ""), (3, "a"), (4, long), (5, "é" * 150), (6, "q" * 200)]
    out = remove_long_repeats(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).drop("kept").collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows)
    same = [(9, long), (9, long), (None, "n" + long[:500]), (None, "other"), (None, "other")]
    out = remove_long_repeats(spark.createDataFrame(same, "doc_id long, text string")).drop("kept").collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(same)
    assert remove_long_repeats(spark.createDataFrame([], schema)).collect() == []


def all_pairs(strings):
    text = [c for s in strings for c in [*(b + 1 for b in s), 0]]
    n, out = len(text), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while j != i and i + k < n and j + k < n and text[i + k] == text[j + k] > 0:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_index_gives_the_longest_match_elsewhere():
    rng = random.Random(1)
    for _ in range(150):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 8))]
        assert build_index(strings).matches().tolist() == all_pairs(strings)


def test_runs_shrink_in_repetitive_text():
    rng = random.Random(2)
    copy = bytes(rng.choices(b"abcdefgh", k=240))
    strings = [bytes(rng.choices(b"xyz", k=4)) + copy for _ in range(200)]
    index = build_index(strings)
    assert len(index.heads) < len(index.text) / 20


def test_pieces_cover_every_window_once(monkeypatch):
    rng = random.Random(3)
    for stretch in (rlindex.STRETCH, 700):
        monkeypatch.setattr(rlindex, "STRETCH", stretch)
        texts = [bytes(rng.choices(b"abcd", k=n)) for n in (0, 199, 200, 201, 5000, 899, 900, 2000)]
        seen = []
        for _, _, which, start, windows, at in byte_pieces(texts):
            seen += [(w, j) for w, s, c in zip(which, start, windows) for j in range(s, s + c)]
            assert ((at >= windows - 1) & (at <= WINDOW - rlindex.K)).all()
        assert sorted(seen) == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - WINDOW + 1)]
