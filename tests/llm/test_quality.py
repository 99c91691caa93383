"""Measures against brute force, estimation on planted votes, edge cases."""

import re

import numpy as np
import pytest

from driftloom.llm import quality
from driftloom.llm.quality import RULES, estimate, measure, measure_documents, quality_verdicts
from driftloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(hit)


TEXTS = [
    None, "", " \n\t ", "a", "a b c a b c", "x\nx\n\n x\nx", "é ü ñ\x0bβ 😀 é ü ñ\x0bβ", "#*$%&|<> a|b", "a b " * 40, "no break space here",
    "one two three four " * 30 + "\n" + "tail",
]


@pytest.mark.parametrize("text", TEXTS)
def test_measures_equal_brute_force(text):
    assert measure((text or "").encode())[:5] == brute(text)


def test_query_equals_brute_force_on_its_table(spark):
    out = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        r = out[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(d.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_verdicts_follow_the_labels(spark):
    out = QUERIES["op3_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r for r in out if r.quality == 1 and not r.base_failed]
    bad = [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_estimation_finds_planted_accuracies():
    rng = np.random.default_rng(5)
    n, k = 20_000, len(RULES)
    truth = rng.random(n) < 0.7
    right = rng.random((n, k)) < 0.85
    silent = rng.random((n, k)) < 0.2
    votes = np.where(silent, "0", np.where(right == truth[:, None], "+", "-"))
    patterns, at, counts = np.unique(["".join(v) for v in votes], return_inverse=True, return_counts=True)
    posterior, on_good, on_bad, share = estimate(list(patterns), counts.astype(float))
    assert abs(share - 0.7) < 0.02
    assert np.abs(on_good[:, 0] - 0.8 * 0.85).max() < 0.03 and np.abs(on_bad[:, 1] - 0.8 * 0.85).max() < 0.03
    assert ((posterior[at] > 0.5) == truth).mean() > 0.98


def test_edges(spark):
    schema = "doc_id long, text string, votes string, p_good double, kept string"
    rows = [(1, t, "x", 0.1, "y") for t in TEXTS] + [(None, "a b", None, None, None), (2, "word " * 9000, "", 0.0, ""), (2, "word " * 9000, "", 0.0, "")]
    out = quality_verdicts(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 1
    assert len({tuple(r) for r in out if r.doc_id == 2}) == 1
    assert quality_verdicts(spark.createDataFrame([], schema)).collect() == []
    assert measure_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().votes == quality.ABSTAIN * len(RULES)
