import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import adapt, drift, sampling, scaling
from driftloom.operators.adapt import adaptation_losses
from driftloom.operators.moments import (
    Moments, as_features, ensemble_vote, fit_members, fit_pca, label_scores, moments, packed_moments, residual_mse, row_errors, score_rows, unpack, weighted_score,
)

COLS = ["a", "b", "c", "d"]


def matrix(n=400, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + rng.normal(0, 0.1, n), base[:, 1], base[:, 1] - base[:, 0] + rng.normal(0, 0.1, n)])
    return x * [1, 10, 100, 1] + 1000 + shift


def frame(spark, x, parts=4):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COLS)).repartition(parts)


def sk_pca(x, target):
    """Plain centred PCA by singular values."""
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    ratio = np.cumsum(s**2) / np.sum(s**2)
    k = int(np.searchsorted(ratio, target, side="right")) + 1
    return vt[:k], s[:k] ** 2 / (len(x) - 1)


@pytest.mark.parametrize("parts", [1, 8])
def test_moments_match_numpy(spark, parts):
    x = matrix()
    m = moments(as_features(frame(spark, x, parts), COLS))
    assert m.n == len(x)
    np.testing.assert_allclose(m.mean, x.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(m.cov, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)


def test_grouped_moments(spark):
    x = matrix()
    df = as_features(frame(spark, x), COLS).withColumn("g", (F.col("id") % 3).cast("int"))
    shift = x[0]
    for r in packed_moments(df, shift, by=["g"]).collect():
        part = x[r["g"]::3]
        np.testing.assert_allclose(unpack(np.array(r["packed"]), shift).cov, np.cov(part.T, bias=True), rtol=1e-9, atol=1e-9)


def test_dp_and_reconstruction_match_direct_computation(spark):
    ref, cur = matrix(seed=0), matrix(seed=1, shift=3.0) * [1, -1, 1, 3]
    mu, sd = ref.mean(axis=0), ref.std(axis=0)
    zr, zc = (ref - mu) / sd, (cur - mu) / sd
    pr, lam = sk_pca(zr, 0.9)
    pc, _ = sk_pca(zc, 0.9)
    k = min(len(pr), len(pc))
    cos = [abs(pr[i] @ pc[i]) for i in range(k)]
    want_dp = 100 * (1 - np.dot(lam[:k], cos) / lam[:k].sum())
    want_mse = np.mean((zc - zc @ pr.T @ pr) ** 2)
    model = drift.DriftModel.fit(as_features(frame(spark, ref), COLS), calibrate=False)
    got = model.score(as_features(frame(spark, cur), COLS))
    assert got["dP"] == pytest.approx(want_dp, abs=1e-8)
    assert got["mse"] == pytest.approx(want_mse, rel=1e-9)
    scored = score_rows(as_features(frame(spark, cur), COLS), {"e": model.pca})
    assert scored.agg(F.avg("e")).first()[0] == pytest.approx(want_mse, rel=1e-9)
    same = model.score(as_features(frame(spark, ref), COLS))
    assert same["dP"] == pytest.approx(0.0, abs=1e-9)


def test_curve_interpolates_a_cubic():
    x = np.array([3.0, 0.5, 1.0, 2.0, 2.5, 4.0])
    cubic = lambda v: 2 * v**3 - v**2 + 5
    c = drift.Curve.through(x, cubic(x))
    for v in (0.1, 0.5, 0.77, 3.3, 4.5):  # also outside the knots
        assert c(v) == pytest.approx(cubic(v), rel=1e-9)
    assert drift.Curve.through([1.0, 2.0, 2.0], [0.0, 10.0, 20.0])(1.5) == pytest.approx(7.5)
    assert drift.error_percent(99.0, [drift.Curve.through([0.0, 1.0], [0.0, 50.0])]) == 100.0


@pytest.mark.parametrize("k", [1, 2, 3])
def test_permutation_errors_are_the_mean_over_permutations(spark, k):
    x = matrix(4000)
    m = moments(as_features(frame(spark, x), COLS))
    pca = fit_pca(m, k)
    got = drift.permutation_errors(m, pca)
    assert len(got) == 10 and all(a[1] < b[1] for a, b in zip(got, got[1:]))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    rng = np.random.default_rng(0)
    for percent, want in got[::3]:
        seen = []
        for _ in range(40):
            flat = z.ravel().copy()
            picked = rng.choice(flat.size, int(flat.size * percent / 100), replace=False)
            flat[picked] = flat[rng.permutation(picked)]
            seen.append(np.mean((z - flat.reshape(z.shape) @ pca.components.T @ pca.components) ** 2))
        assert want == pytest.approx(np.mean(seen), rel=0.03)


def test_incomplete_rows_are_left_out(spark):
    rows = [(i, [float(i), None if i == 3 else 2.0 * i, float("nan") if i == 4 else 1.0]) for i in range(8)]
    m = moments(spark.createDataFrame(rows, "id long, features array<double>"))
    x = np.array([r[1] for r in rows if r[0] not in (3, 4)], dtype=float)
    assert m.n == 6
    np.testing.assert_allclose(m.cov, np.cov(x.T, bias=True), atol=1e-12)


def test_scenarios_have_the_expected_order(spark):
    rng = np.random.default_rng(0)
    t = np.arange(500) / 50
    x = np.column_stack([np.sin(t + i) * 3 + 0.02 * i * np.arange(500) + rng.normal(0, 0.3, 500) for i in range(8)])
    cols = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *cols])
    model = drift.DriftModel.fit(as_features(df, cols))
    got = {r["scenario"]: r for r in drift.scenario_matrix(df, ["id"], cols, model).collect()}
    assert got["no drift"]["dP"] == pytest.approx(0, abs=1e-9) and got["mean shift"]["dP"] == pytest.approx(0, abs=1e-9)
    assert got["added noise"]["dP"] > got["20% deleted"]["dP"]
    assert got["mean shift"]["dE_PCA"] > got["no drift"]["dE_PCA"]


def test_drift_by_group_equals_single_scores(spark):
    ref, cur = matrix(seed=0), matrix(seed=1)
    model = drift.DriftModel.fit(as_features(frame(spark, ref), COLS))
    df = as_features(frame(spark, cur), COLS).withColumn("month", (F.col("id") % 2).cast("int"))
    got = {(r["month"], r["metric"]): r["value"] for r in model.by_group(df, "month").collect()}
    for m in (0, 1):
        one = model.score(df.where(F.col("month") == m))
        for k, v in one.items():
            assert got[(m, k)] == pytest.approx(v, rel=1e-9, abs=1e-9)


def values(spark, x):
    return spark.createDataFrame([(float(v),) for v in x], "v double")


def test_ks_psi_rank_sum(spark):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.4, 1, 200), 1)
    k = drift.ks_two_sample(values(spark, a), values(spark, b), "v").first()
    pts = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in pts)
    lam = math.sqrt(300 * 200 / 500) * d
    p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101))
    assert k["ks"] == pytest.approx(d) and k["p_value"] == pytest.approx(p) and k["drift"] == int(p < 0.05)
    assert k["ref_std"] == pytest.approx(a.std())
    edges = np.quantile(a, np.linspace(0, 1, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    e, c = np.histogram(a, edges)[0] / 300, np.histogram(b, edges)[0] / 200
    e, c = np.clip(e, 1e-6, None), np.clip(c, 1e-6, None)
    assert drift.psi(values(spark, a), values(spark, b), "v").first()["psi"] == pytest.approx(np.sum((c - e) * np.log(c / e)))
    same = drift.psi(values(spark, a), values(spark, a), "v").first()
    assert same["psi"] == pytest.approx(0) and same["band"] == "slight"
    zero = drift.ks_two_sample(values(spark, a), values(spark, a), "v").first()
    assert (zero["ks"], zero["p_value"], zero["drift"]) == (0.0, 1.0, 0)
    u = np.sum((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :]))
    u = min(u, 60000 - u)
    z = (u - 30000) / math.sqrt(300 * 200 * 501 / 12)
    r = drift.mann_whitney(values(spark, a), values(spark, b), "v").first()
    assert r["u"] == pytest.approx(u) and r["z"] == pytest.approx(z) and r["p_value"] == pytest.approx(math.erfc(-z / math.sqrt(2)))


def test_psi_with_constant_reference(spark):
    got = drift.psi(values(spark, [1.0] * 50), values(spark, [1.0] * 20 + [2.0] * 20), "v").first()
    assert got["psi"] == pytest.approx(0.0)


def test_reconstruction_alarm(spark):
    ref = matrix()
    broken = ref.copy()
    broken[:, 1] = broken[::-1, 1]
    got = drift.reconstruction_alarm(as_features(frame(spark, ref), COLS), as_features(frame(spark, broken), COLS), 2)
    assert got["alarm"] and got["adapted_mse"] < got["cur_mse"]
    calm = drift.reconstruction_alarm(as_features(frame(spark, ref), COLS), as_features(frame(spark, ref), COLS), 2)
    assert not calm["alarm"] and calm["adapted_mse"] == calm["cur_mse"]


def test_scalers(spark):
    x = matrix(50)
    x[:, 3] = 7.0
    df = frame(spark, x)
    med, q1, q3 = np.median(x, axis=0), np.quantile(x, 0.25, axis=0), np.quantile(x, 0.75, axis=0)
    iqr = np.where(q3 > q1, q3 - q1, 1.0)
    got = np.array([[r[c] for c in COLS] for r in scaling.fit_robust(df, COLS).apply(df).orderBy("id").collect()])
    np.testing.assert_allclose(got, (x - med) / iqr, atol=1e-9)
    sd = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    got = np.array([[r[c] for c in COLS] for r in scaling.fit_standard(df, COLS).apply(df, squash=True).orderBy("id").collect()])
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-(x - x.mean(axis=0)) / sd)), atol=1e-9)
    mm = scaling.fit_min_max(df, COLS).apply(frame(spark, x + 1000)).agg(F.max("a")).first()[0]
    assert mm > 1
    vec = scaling.assemble(df, COLS, "scaled_features")
    kept_frame, kept = scaling.drop_constant(vec, COLS)
    assert kept == COLS[:3]
    model, projected = scaling.project_pca(kept_frame, 2)
    assert projected.count() == 50 and len(model.explainedVariance) == 2


def test_scorer_contract_and_vote(spark):
    x = matrix(120)
    df = as_features(frame(spark, x), COLS)
    m = moments(df)
    p1, p2 = fit_pca(m, 1), fit_pca(m, 2)
    assert residual_mse(m, p2) <= residual_mse(m, p1)
    s = label_scores(weighted_score(score_rows(df, {"e1": p1, "e2": p2}), "e1", "e2", out="anomaly_score"), 0.2)
    for r in s.collect():
        want = 0.3 * row_errors(np.array([r["features"]]), p1)[0] + 0.7 * row_errors(np.array([r["features"]]), p2)[0]
        assert r["anomaly_score"] == pytest.approx(want) and r["prediction"] == int(want >= 0.2)
        assert r["label_text"] == ("Anomaly" if r["prediction"] else "Normal")
    members = fit_members(df, ["id"], members=3, target=2)
    votes = ensemble_vote(score_rows(df, {f"m{i}": m for i, m in enumerate(members)}), ["m0", "m1", "m2"], [0.0, 9e9, 9e9])
    assert len(members) == 3 and votes.agg(F.min("pred")).first()[0] == 1


def test_micro_batch_losses(spark):
    base = moments(as_features(frame(spark, matrix()), COLS))
    live = as_features(frame(spark, matrix(60, seed=9) * [1, -1, 1, 1]), COLS).withColumn("batch", F.floor(F.col("id") / 10))
    out = adaptation_losses(live, base, 2).collect()
    assert len(out) == 6 and all(r["n"] == 10 for r in out)
    assert np.mean([r["loss_after"] for r in out]) < np.mean([r["loss_before"] for r in out])
    pca = fit_pca(base, 2)
    rows = (matrix(60, seed=9) * [1, -1, 1, 1]).reshape(6, 10, 4)
    for r in out:
        assert r["loss_before"] == pytest.approx(row_errors(rows[r["batch"]], pca).mean(), rel=1e-7)


@pytest.mark.parametrize("short", [False, True])
def test_carried_adaptation_blends_batch_after_batch(spark, monkeypatch, short):
    x = matrix(300)
    base = moments(as_features(frame(spark, x[:60]), COLS))
    live = as_features(frame(spark, x[60:] + np.linspace(0, 3, 240)[:, None]), COLS).withColumn("batch", F.floor(F.col("id") / 6))
    if short:  # several blocks of batches
        monkeypatch.setattr(adapt, "CARRY_BLOCK", 7)
    out = {r["batch"]: r for r in adaptation_losses(live, base, 2, weight=0.25, carry=True).collect()}
    assert sorted(out) == list(range(40))
    mean, second = base.mean, base.cov + np.outer(base.mean, base.mean)
    pca = fit_pca(base, 2)
    rows = x[60:] + np.linspace(0, 3, 240)[:, None]
    for b in range(40):
        part = rows[6 * b : 6 * b + 6]
        assert out[b]["loss_before"] == pytest.approx(row_errors(part, pca).mean(), rel=1e-4, abs=1e-6)
        mean = 0.75 * mean + 0.25 * part.mean(axis=0)
        second = 0.75 * second + 0.25 * part.T @ part / 6
        pca = fit_pca(Moments(60, mean, second - np.outer(mean, mean)), 2, scale=base)
        assert out[b]["loss_after"] == pytest.approx(row_errors(part, pca).mean(), rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("parts", [1, 6])
def test_hash_samples_are_exact_and_stable(spark, parts, monkeypatch):
    monkeypatch.setattr(sampling, "FINE_ENOUGH", 3)
    df = spark.range(1000).repartition(parts)
    for k in (0, 1, 17, 999, 1000, 5000):
        assert sampling.hash_sample(df, ["id"], k).count() == min(k, 1000)
    got = sorted(r["id"] for r in sampling.hash_sample(df, ["id"], 50, seed=3).collect())
    want = sorted(r["id"] for r in sampling.hash_sample(spark.range(1000).coalesce(1), ["id"], 50, seed=3).collect())
    assert got == want


def test_samples_of_repeated_ids_are_exact(spark):
    df = spark.createDataFrame([(i // 4, i % 2) for i in range(400)], "id long, label int")
    for k in (1, 10, 37, 400):
        assert sampling.hash_sample(df, ["id"], k).count() == k
    out = sampling.rebalance(df, ["id"], 0.1).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {0: 200, 1: 22}


def test_permuted_cells(spark):
    df = frame(spark, matrix(100))
    out = sampling.permute_cells(df, ["id"], COLS, 0.31).collect()
    assert len(out) == 400 and sum(r["chosen"] for r in out) == 124
    assert sorted(r["value"] for r in out) == sorted(r["permuted"] for r in out)
    assert all(r["value"] == r["permuted"] for r in out if not r["chosen"])
    assert sum(r["value"] != r["permuted"] for r in out) > 100


def test_splits_and_rebalance(spark):
    rows = [(i, int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(3)
    folds = sampling.stratified_folds(df, ["id"]).groupBy("label", "fold").count().collect()
    assert sorted((r["label"], r["count"]) for r in folds) == [(0, 60)] * 5 + [(1, 20)] * 5
    re = {r["label"]: r["count"] for r in sampling.rebalance(df, ["id"], 0.1).groupBy("label").count().collect()}
    assert re == {0: 300, 1: 33}
    none = sampling.rebalance(df, ["id"], 0.001, at_least_one=False)
    assert none.where("label = 1").count() == 0
    assert sampling.rebalance(df, ["id"], 0.001).where("label = 1").count() == 1
    assert sampling.rebalance(df, ["id"], 0.9).where("label = 1").count() == 100
    init, stream = sampling.init_and_stream(df, ["id"], 50)
    assert init.count() == 50 and stream.count() == 350 and init.where("label = 1").count() == 0
    share = sampling.train_test(df, ["id"]).where("is_train").count() / 400
    assert 0.7 < share < 0.9


def test_injected_drift(spark):
    x = matrix(200)
    df = frame(spark, x)
    hit = sampling.affected_columns(COLS, 0.5)
    assert len(hit) == 2 and sampling.affected_columns(COLS, 0.0, 1)[0] in COLS
    shifted = sampling.inject_drift(df, COLS, ["id"], "shift", 0.5).agg(*[F.avg(c).alias(c) for c in COLS]).first()
    for j, c in enumerate(COLS):
        assert shifted[c] == pytest.approx(x[:, j].mean() + (2 * x[:, j].std(ddof=1) if c in hit else 0))
    noisy = sampling.inject_drift(df, COLS, ["id"], "noise", 0.5).agg(*[F.stddev_samp(c).alias(c) for c in COLS]).first()
    for j, c in enumerate(COLS):
        ratio = noisy[c] / x[:, j].std(ddof=1)
        assert (1.2 < ratio < 1.65) if c in hit else ratio == pytest.approx(1)
    assert sampling.inject_drift(df, COLS, ["id"], "missing", 0.2).count() == 160
    with pytest.raises(ValueError):
        sampling.inject_drift(df, COLS, ["id"], "other", 0.2)


def test_damped_segments(spark):
    df = spark.range(60).withColumn("x", F.lit(1.0)).repartition(3)
    got = {r["id"]: r["x"] for r in sampling.damp_segments(df, ["id"], ["x"]).collect()}
    low = [i for i in range(60) if got[i] == pytest.approx(0.1)]
    assert low == list(range(20, 30)) + list(range(40, 50))
