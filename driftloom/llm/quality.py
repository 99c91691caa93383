"""Quality rules as weak supervision.

Every rule votes good, votes bad or abstains. Expectation-maximisation over the vote patterns estimates how each rule
votes on good and on bad documents, with no labels, and the posterior probability of "good" replaces a filter in
which one failed rule is enough. A document's votes are one of at most 3^10 patterns, so the estimation works on a table
of pattern counts, however many documents there are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftloom.llm.text import column, map_batches, two_columns, utf8
from driftloom.session import settle

SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
PUNCTUATION = np.frombuffer(b".,;:", dtype=np.uint8)
#: ASCII that is neither a letter, a digit, white space nor everyday punctuation.
ODD = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"], dtype=np.uint8)

#: (rule, measured ratio, vote good between these, vote bad below, vote bad above); in between it abstains.
RULES = [
    ("length", "words", (100, np.inf), 50, np.inf),
    ("word_length", "chars_per_word", (2.5, 11), 1.5, 16),
    ("symbols", "symbols_per_word", (0, 0.02), -1, 0.1),
    ("odd_characters", "odd_per_word", (0, 0.05), -1, 0.15),
    ("capitals", "capital_share", (0, 0.2), -1, 0.5),
    ("line_copies", "copied_line_share", (0, 0.05), -1, 0.5),
    ("repeats", "repeat_share", (0, 0.1), -1, 0.45),
    ("exclaiming", "exclaims_per_word", (0, 0.1), -1, 0.3),
    ("sentences", "stops_per_word", (0.02, 0.6), -1, 1.5),
    ("variety", "distinct_share", (0.3, 1), 0.1, np.inf),
]
GOOD, BAD, ABSTAIN = "+", "-", "0"
#: Start of the estimation: probability of (good vote, bad vote, abstention) on a good and on a bad document.
START_GOOD, START_BAD = (0.85, 0.01, 0.14), (0.55, 0.25, 0.20)
#: The start counts as so many documents, which keeps small tables sane.
START_WEIGHT = 20.0
START_SHARE_GOOD = 0.8
ROUNDS = 200

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    hit = np.fromiter((times[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def copied_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines)), len(lines)


def vote(value: float, good: tuple[float, float], low: float, high: float) -> str:
    if value < low or value > high:
        return BAD
    return GOOD if good[0] <= value <= good[1] else ABSTAIN


def measure(text: bytes) -> tuple[int, int, int, int, int, str]:
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    points = len(text) - int(counts[128:192].sum())
    chars = points - int(counts[32] + counts[9:14].sum())
    symbols = int(counts[SYMBOLS].sum())
    copies, lines = copied_lines(text)
    repeats = repeated_words(words)
    if not n:
        return 0, 0, symbols, copies, repeats, ABSTAIN * len(RULES)
    capitals = int(counts[65:91].sum())
    letters = capitals + int(counts[97:123].sum()) + int(counts[192:].sum())
    ratios = {
        "words": n,
        "chars_per_word": chars / n,
        "symbols_per_word": symbols / n,
        "odd_per_word": int(counts[ODD].sum()) / n,
        "capital_share": capitals / max(letters, 1),
        "copied_line_share": copies / max(lines, 1),
        "repeat_share": repeats / n,
        "exclaims_per_word": int(counts[33]) / n,
        "stops_per_word": int(counts[PUNCTUATION].sum()) / n,
        "distinct_share": len(set(words)) / n,
    }
    return n, chars, symbols, copies, repeats, "".join(vote(ratios[of], good, low, high) for _, of, good, low, high in RULES)


def measure_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and votes per document, one row for each input row.

    A null or empty text has no words and every rule abstains.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in utf8(b.column(1))]
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]] + [pa.array([r[5] for r in rows])]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], [f.split()[0] for f in MEASURES.split(", ")])

    return map_batches(two_columns(df, id_col, text_col), batch, MEASURES)


def estimate(patterns: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """EM for two classes whose rules vote independently of each other given the class.

    Returns the posterior of "good" per pattern, how each rule votes on good and on bad documents (rules x votes), and
    the share of good documents.
    """
    k = len(RULES)
    start = np.array([START_GOOD, START_BAD])
    vote_of = np.array([[(GOOD, BAD, ABSTAIN).index(v) for v in p] for p in patterns], dtype=int).reshape(-1, k)
    share, table = START_SHARE_GOOD, np.repeat(start[:, None, :], k, axis=1)
    posterior = np.zeros(0)
    for _ in range(ROUNDS):
        odds = np.array([np.log(table[y][np.arange(k), vote_of]).sum(axis=1) for y in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(odds[1] + np.log(1 - share) - odds[0] - np.log(share), -700, 700)))
        done = len(posterior) == len(new) and np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
        weight = np.array([counts * posterior, counts * (1 - posterior)])
        for y in (0, 1):
            for v in range(3):
                table[y, :, v] = START_WEIGHT * start[y, v] + (weight[y][:, None] * (vote_of == v)).sum(axis=0)
            table[y] /= table[y].sum(axis=1, keepdims=True)
        total = weight.sum() + START_WEIGHT
        share = (weight[0].sum() + START_WEIGHT * START_SHARE_GOOD) / total
    return posterior, table[0], table[1], float(share)


def pattern_posteriors(rows: DataFrame) -> dict[str, float]:
    """Posterior probability of "good" per vote pattern of measured rows."""
    table = sorted((r[0], r[1]) for r in rows.groupBy("votes").count().collect())  # at most 3^10 rows
    patterns = [p for p, _ in table]
    return dict(zip(patterns, map(float, estimate(patterns, np.array([n for _, n in table], dtype=float))[0])))


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that pass the base rules and are probably good; only a verdict per text leaves Python."""
    texts = df.select(F.lit(0).alias("doc_id"), column(text_col).alias("text"))
    posteriors = pattern_posteriors(settle(measure_documents(texts).select("votes")))

    @pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            n, *_, repeats, votes = measure((text or "").encode())
            out.append(n >= 50 and 100 * repeats <= 50 * n and posteriors[votes] >= threshold)
        return pd.Series(out, dtype=bool)

    return df.filter(good(column(text_col)))


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, votes, posterior probability of good quality, and the verdict.

    Repeated rows get equal answers. Texts that are null or empty fail the base rules and are not kept; a null id stays
    null. An empty table gives an empty result.
    """
    rows = settle(measure_documents(df, id_col, text_col))
    # at most 3^10 rows, so the broadcast is bounded
    known = df.sparkSession.createDataFrame(list(pattern_posteriors(rows).items()), "votes string, p_good double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.join(F.broadcast(known), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", "votes")
    )
