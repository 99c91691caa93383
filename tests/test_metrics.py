import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import metrics, profile, threshold


def scored(spark, n=400, seed=1, parts=4):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.2).astype(int)
    s = np.round(rng.normal(size=n) + y, 1)  # one decimal: many ties
    rows = [(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "id long, label int, score double").repartition(parts), y, s


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return np.mean((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :]))


def brute_ap(y, s):
    total, last, ap = y.sum(), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        r, p = y[hit].sum() / total, y[hit].mean()
        ap, last = ap + (r - last) * p, r
    return ap


@pytest.mark.parametrize("parts", [1, 8])
def test_auc_and_ap(spark, parts):
    df, y, s = scored(spark, parts=parts)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert metrics.average_precision(df).first()[0] == pytest.approx(brute_ap(y, s), abs=1e-12)
    # Monotone maps of the score change nothing.
    assert metrics.roc_auc(df.withColumn("score", F.exp("score"))).first()[0] == pytest.approx(brute_auc(y, s), abs=1e-12)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "score double, label int")
    assert metrics.roc_auc(df).first()[0] is None
    assert metrics.average_precision(df).first()[0] is None
    row = metrics.positive_scores(df.withColumn("pred", F.lit(0))).first()
    assert (row["precision"], row["recall"], row["f1"], row["false_alarm_rate"]) == (0.0, 0.0, 0.0, 0.0)
    all_pos = spark.createDataFrame([(1, 1)], "label int, pred int")
    assert metrics.positive_scores(all_pos).first()["false_alarm_rate"] is None


def test_macro_over_union_of_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 2)], "label int, pred int")
    r = metrics.macro_scores(df).first()
    # class 1: p 1 r .5 f 2/3; class 2: p .5 r .5 f .5; class 3: all 0
    assert r["precision_macro"] == pytest.approx(0.5)
    assert r["recall_macro"] == pytest.approx(1 / 3)
    assert r["f1_macro"] == pytest.approx((2 / 3 + 0.5) / 3)
    assert r["f1_weighted"] == pytest.approx((2 / 3 + 0.5) / 2)


def brute_macro_f1(y, p):
    out = []
    for c in sorted(set(y) | set(p)):
        tp, fp, fn = ((y == c) & (p == c)).sum(), ((y != c) & (p == c)).sum(), ((y == c) & (p != c)).sum()
        out.append(2 * tp / (2 * tp + fp + fn))
    return np.mean(out)


def test_threshold_sweep_and_best(spark):
    df, y, s = scored(spark)
    grid = [-5.0, -0.5, 0.0, 0.7, 1.3, 9.0]
    got = {r["threshold"]: r["f1_macro"] for r in metrics.threshold_sweep(df, grid).collect()}
    assert sorted(got) == grid
    for t in grid:
        assert got[t] == pytest.approx(brute_macro_f1(y, (s >= t).astype(int)), abs=1e-12)
    cand = np.unique(np.quantile(s, np.linspace(0.5, 0.999, 400)))
    f1 = [brute_macro_f1(y, (s >= t).astype(int)) for t in cand]
    best = threshold.best_f1_threshold(df)
    assert best == pytest.approx((cand[int(np.argmax(f1))], max(f1)), abs=1e-9)


def test_sweep_per_group_has_every_threshold(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 0), ("b", 5.0, 1)], "g string, score double, label int")
    out = metrics.threshold_counts(df, [0.0, 1.5, 9.0], ["g"]).collect()
    assert len(out) == 6
    row = next(r for r in out if r["g"] == "a" and r["threshold"] == 1.5)
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 1, 1, 0)


def test_leak_free_uses_later_half_only(spark):
    df, y, s = scored(spark)
    rows = threshold.leak_free(df, ["id"], factory=99.0).collect()
    for r in rows:
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 200
    after = next(r for r in rows if r["mode"] == "after")
    cal = np.unique(np.quantile(s[:200], np.linspace(0.5, 0.999, 400)))
    f1 = [brute_macro_f1(y[:200], (s[:200] >= t).astype(int)) for t in cal]
    assert after["threshold"] == pytest.approx(cal[int(np.argmax(f1))])
    assert after["f1_macro"] == pytest.approx(brute_macro_f1(y[200:], (s[200:] >= after["threshold"]).astype(int)))


def test_histogram_and_constant(spark):
    x = [0.0, 0.1, 0.5, 1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = {r["bin"]: (r["n"], r["density"]) for r in profile.histogram(df, "x", 4).collect()}
    n, edges = np.histogram(x, 4)
    assert got == {i: (c, pytest.approx(c / (len(x) * (edges[1] - edges[0])))) for i, c in enumerate(n) if c}
    flat = profile.histogram(df.select(F.lit(3.0).alias("x")), "x", 10).collect()
    assert len(flat) == 1 and flat[0]["n"] == 5
    assert profile.histogram(df.limit(0), "x", 10).count() == 0


def test_profiles(spark):
    rows = [(1.0, 10.0), (2.0, 10.0), (4.0, 10.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    p = {r["feature"]: r for r in profile.column_profile(df, ["a", "b"]).collect()}
    assert p["a"]["median"] == 2.0 and p["a"]["q3"] == 3.0 and p["b"]["std"] == 0.0
    assert profile.overall_profile(df, ["a", "b"]).first()["iqr"] == pytest.approx(0.75)
    rep = {r["feature"]: r for r in profile.change_report(df, df.withColumn("a", F.col("a") * 2), ["a", "b"]).collect()}
    assert rep["a"]["mean_change"] == pytest.approx(100.0) and rep["a"]["flagged"] == 1 and rep["b"]["flagged"] == 0
