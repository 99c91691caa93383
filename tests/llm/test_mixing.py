"""Targets by repeated sharing, copies near their targets, inclusion probabilities, edge cases."""

from collections import defaultdict

import duckdb
import pytest

from driftloom.llm import mixing
from driftloom.llm.mixing import mix_sources, source_targets
from driftloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 3}, {"x": 0, "y": 7}, {"x": 0}, {chr(65 + i): i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in source_targets(df).collect()} == pytest.approx(shared(sizes))


def test_query_equals_sql_and_meets_its_targets(spark):
    out = QUERIES["op9_source_mix"](spark, SF).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, out)) == sorted(con.execute(SQL["op9_source_mix"]).fetchall())


def test_taken_words_are_near_the_targets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mix_sources(docs, seed=4).collect()), key=str)
    for rows in (want,):
        taken, target, largest = defaultdict(int), {}, defaultdict(int)
        for _, source, size, _, goal, copies, words in rows:
            taken[source] += words
            target[source], largest[source] = goal, max(largest[source], size)
            assert 0 <= copies <= 3 and words == copies * size
        assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    monkeypatch.setattr(mixing, "BUCKETS", 3)  # the buckets change the plan and not the result
    assert sorted(map(tuple, mix_sources(docs.repartition(5), seed=4).collect()), key=str) == want


def test_odds_favour_some_documents(spark):
    rows = [(i, "w " * 10, "s" if i < 3000 else "t", 4.0 if i % 2 else 1.0) for i in range(6000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, odds double"), weights=(3, 1), odds_col="odds").collect()
    extra = defaultdict(int)
    for r in out:
        if r.source == "t":
            extra[r.doc_id % 2] += r.copies
    assert extra[0] + extra[1] == 1500 and extra[1] > 1.5 * extra[0]


def test_documents_without_an_id_are_drawn_one_by_one(spark):
    """A third of the ids is null: their share among the extra copies is that of all documents of their size."""
    rows = [(None if i % 3 == 0 else i, f"{i} " + "w " * 9, "s" if i < 3000 else "t") for i in range(6000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3, 1)).collect()
    extra = [r for r in out if r.source == "t" and r.copies]
    assert len(extra) == 1500 and 430 < sum(r.doc_id is None for r in extra) < 570


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (300 if i % 2 else 20), "s" if i < 3000 else "t") for i in range(6000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3, 1), by_size=True).collect()
    chosen = [r.size for r in out if r.source == "t" and r.copies]
    assert chosen.count(300) > 1.2 * chosen.count(20)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, target int"
    rows = [(1, None, "a", "", 1), (2, "", "a", "", 1), (3, "one two", None, "", 1), (None, "x y z", "a", "", 1), (4, "w " * 9000, "b", "", 1), (5, "p q", "b", "", 1), (5, "p q", "b", "", 1)]
    df = spark.createDataFrame(rows, schema)
    out = mix_sources(df).collect()
    assert len(out) == len(rows) and all(r.taken == 0 for r in out if r.size == 0)
    assert sorted(map(str, mix_sources(df.repartition(3)).collect())) == sorted(map(str, out))
    assert mix_sources(df.limit(0)).collect() == []
    assert [r.taken for r in mix_sources(df.filter("doc_id = 1")).collect()] == [0]
