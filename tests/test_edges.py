"""Inputs without rows, without values, with one row, with one value."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import clean, drift, metrics, moments, profile, ranks, scaling, sequence, threshold

SCHEMA = "id long, t double, k string, score double, label int, pred int"
ORDER = ["t", "id"]
ROWS = {
    "empty": [],
    "one": [(1, 1.0, "a", 0.5, 1, 0)],
    "nulls": [(i, float(i), None, None, i % 2, i % 2) for i in range(6)],
    "constant": [(i, 1.0, "a", 2.0, 1, 1) for i in range(6)],
}


@pytest.fixture(params=list(ROWS))
def named(request, spark):
    return request.param, spark.createDataFrame(ROWS[request.param], SCHEMA)


def test_orders_keep_every_row(named):
    name, df = named
    n = len(ROWS[name])
    got = ranks.ranked(df, ORDER).collect()
    assert sorted(r["rn"] for r in got) == list(range(1, n + 1))
    assert sequence.trailing_mean(df, "score", ORDER, ["k"]).count() == n
    assert sequence.prequential(df, ORDER).count() == n
    assert sum(r["n"] for r in sequence.block_sums(df, ORDER, "label").collect()) == n


def test_statistics(named):
    name, df = named
    has = name in ("one", "constant")
    assert (ranks.exact_quantiles(df, ["score"], [0.5])["score"][0] is not None) == has
    ks = drift.ks_two_sample(df, df, "score").first()
    assert ks["drift"] == 0 and ks["p_value"] == (1.0 if has else None)
    assert metrics.roc_auc(df).first()["roc_auc"] is None
    cells = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df, ["t", "score"]).collect()}
    assert cells["t", "score"] is None and cells["t", "t"] == (pytest.approx(1.0) if name == "nulls" else None)
    scaled = scaling.fit_robust(df, ["score"]).apply(df)
    assert scaled.where(F.col("score") != 0).count() == 0 and scaled.count() == len(ROWS[name])
    assert clean.fill_median(df, ["score"]).where(F.col("score").isNull()).count() == (6 if name == "nulls" else 0)


def test_nothing_to_choose_from_is_an_error(named):
    name, df = named
    if name in ("one", "constant"):
        assert threshold.best_f1_threshold(df)[0] == ROWS[name][0][3]
        return
    for act in (
        lambda: threshold.best_f1_threshold(df), lambda: threshold.sweep_points(df), lambda: drift.psi(df, df, "score"),
        lambda: threshold.adapt_on_drift(df, df, ORDER, ["id"]),
    ):
        with pytest.raises(ValueError):
            act()
    if name == "empty":
        with pytest.raises(ValueError):
            moments.covariance_frame(df, ["t"])


def test_correlation_uses_rows_with_both_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (None, 100.0), (50.0, None)], "a double, b double")
    want = df.na.drop().agg(F.corr("a", "b")).first()[0]
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df, ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(want)
