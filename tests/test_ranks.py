import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import ranks


def numbers(spark, n, seed=0, parts=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), float(v)) for i, v in enumerate(rng.integers(0, 50, n))]
    return spark.createDataFrame(rows, "id long, v double").repartition(parts), rows


@pytest.mark.parametrize("parts", [1, 8])
def test_ranked_is_the_total_order(spark, parts):
    df, rows = numbers(spark, 500, parts=parts)
    got = {r["id"]: r["rn"] for r in ranks.ranked(df, ["v", "id"]).collect()}
    want = {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert got == want


def test_hot_value_is_cut_along_the_tie_break(spark):
    rows = [(i, 7.0) for i in range(4000)] + [(4000 + i, float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double")
    cut = ranks.order_buckets(df, ["v", "id"], 16)
    sizes = [r["count"] for r in cut.groupBy(ranks.BUCKET).count().collect()]
    assert max(sizes) <= 6000 / 16 * 2.5
    got = {r["id"]: r["rn"] for r in ranks.ranked(df, ["v", "id"], buckets=16).collect()}
    assert got == {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}


def test_running_sum_per_group_with_null_group(spark):
    rows = [(g, i, float(i)) for i in range(60) for g in ("a", None)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    out = ranks.running(df, ["i"], {"s": ("sum", F.col("x"))}, ["g"], totals=True).collect()
    assert len(out) == 120
    for r in out:
        assert r["s"] == sum(range(r["i"] + 1)) and r["s_total"] == sum(range(60))


def test_running_max(spark):
    rows = [(i, i if i % 7 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, m int")
    out = {r["i"]: r["top"] for r in ranks.running(df, ["i"], {"top": ("max", F.col("m"))}).collect()}
    assert all(out[i] == i - i % 7 for i in range(200))


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert ranks.ranked(empty, ["v", "id"]).count() == 0
    assert ranks.half_split(empty, ["v", "id"]).count() == 0
    one = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert ranks.ranked(one, ["v", "id"]).first()["rn"] == 1
    assert ranks.exact_quantiles(empty, ["v"], [0.5]) == {"v": [None]}
    assert ranks.exact_quantiles(one, ["v"], [0.0, 0.5, 1.0]) == {"v": [2.0, 2.0, 2.0]}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_quantiles_match_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=700), np.full(600, 0.25), rng.normal(50, 1, 200)])
    y = rng.integers(0, 3, len(x)).astype(float)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, None), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 0.999, 1.0]
    got = ranks.exact_quantiles(df, ["x", "y"], probs, accuracy)
    np.testing.assert_allclose(got["x"], np.quantile(x, probs), rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(got["y"], np.quantile(np.append(y, 1.0), probs), atol=1e-12)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "id int, v double")
    got = {r["id"]: r["avg_rank"] for r in ranks.average_rank(df, "v").collect()}
    assert got == {3: 1.0, 1: 2.5, 2: 2.5, 4: 4.0}


def test_half_split_batches_and_periods(spark):
    df = spark.range(7).withColumn("t", F.col("id").cast("double"))
    parts = {r["id"]: r["part"] for r in ranks.half_split(df, ["t", "id"]).collect()}
    assert [parts[i] for i in range(7)] == ["calibration"] * 3 + ["evaluation"] * 4
    sizes = {r["batch"]: r["count"] for r in ranks.cut_batches(df, ["t"], 3).groupBy("batch").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 1}
    assert sorted(r["id"] for r in ranks.every_nth(df, ["t"], 3).collect()) == [0, 3, 6]
    assert sorted(r["id"] for r in ranks.every_nth(df, ["t"], 3, start=1).collect()) == [2, 5]


def test_order_never_uses_one_partition_for_rows(spark):
    df = spark.range(1000).withColumn("t", F.col("id").cast("double"))
    plan = ranks.ranked(df, ["t", "id"])._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [k for k, line in enumerate(plan) if "Exchange SinglePartition" in line]
    # what goes to one partition are the totals of the buckets, one row each
    assert all(any("HashAggregate(keys=[_bucket" in line for line in plan[k + 1 : k + 4]) for k in single)


def test_rows_per_task_are_bounded(spark, monkeypatch):
    df = spark.range(1000).withColumn("t", F.col("id").cast("double"))
    assert ranks.bucket_count(df) == 4
    monkeypatch.setattr(ranks, "HOT_ROWS", 50)
    assert ranks.bucket_count(df) == 20
    sizes = [r["count"] for r in ranks.order_buckets(df, ["t"]).groupBy(ranks.BUCKET).count().collect()]
    assert len(sizes) >= 18 and max(sizes) < 100
    assert [r["rn"] for r in ranks.ranked(df, ["t", "id"]).orderBy("id").collect()] == list(range(1, 1001))


@pytest.fixture
def tiny_groups(monkeypatch):
    """Groups above 100 rows count as hot."""
    monkeypatch.setattr(ranks, "HOT_ROWS", 100)


def test_hot_groups_are_split_and_agree(spark, tiny_groups):
    rng = np.random.default_rng(1)
    rows = [(None if k == 0 else f"g{k}", i, float(v)) for i, (k, v) in enumerate(zip(rng.choice(6, 600, p=[.4, .4, .05, .05, .05, .05]), rng.integers(0, 9, 600)))]
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(5)
    hot = ranks.hot_groups(df, ["g"]).collect()
    assert {r["g"] for r in hot} == {None, "g1"}
    got = {r["id"]: (r["rn"], r["rn_total"]) for r in ranks.ranked(df, ["v", "id"], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((v, i) for k, i, v in rows if k == g)
        assert all(got[i] == (p + 1, len(mine)) for p, (_, i) in enumerate(mine))
    cum = ranks.running_by_value(df, "v", {"n": F.lit(1)}, ["g"], totals=True).collect()
    for r in cum:
        mine = [v for k, _, v in rows if k == r["g"]]
        assert r["n"] == mine.count(r["v"]) and r["cum_n"] == sum(v <= r["v"] for v in mine) and r["cum_n_total"] == len(mine)


def test_moving_windows_over_hot_groups(spark, tiny_groups):
    from driftloom.operators.sequence import moving

    rows = [("hot", i, float(i)) for i in range(300)] + [("cold", i, float(i)) for i in range(15)]
    df = spark.createDataFrame(rows, "g string, id long, v double").repartition(5)
    out = moving(df, ["id"], {"s": lambda w: F.sum("v").over(w)}, ["g"], back=4, size=16).collect()
    assert len(out) == 315
    assert all(r["s"] == sum(range(max(0, r["id"] - 4), r["id"] + 1)) for r in out)
