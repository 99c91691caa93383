import datetime as dt
import math
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import ranks, sequence, threshold
from driftloom.operators.sequence import Adwin, DetectorEnsemble

T0 = dt.datetime(2024, 1, 1)


def stream(spark, n=300, seed=5, parts=4, keys=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "id": np.arange(n), "t": rng.integers(0, n // 2, n).astype(float), "k": rng.integers(0, keys, n),
        "score": np.round(rng.normal(size=n), 1), "label": (rng.random(n) < 0.3).astype(int), "pred": (rng.random(n) < 0.4).astype(int),
    })
    return spark.createDataFrame(pdf).repartition(parts), pdf.sort_values(["t", "id"]).reset_index(drop=True)


def test_sliding_windows(spark):
    rows = [(c, T0 + dt.timedelta(seconds=i), float(i), float(-i)) for c, n in (("a", 7), ("b", 2), ("c", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "CELL string, DATETIME timestamp, x double, y double")
    got = sequence.sliding_windows(df, ["x", "y"], 3).collect()
    assert len(got) == 5 + 0 + 1
    last = max((r for r in got if r["CELL"] == "a"), key=lambda r: r["END_TIME"])
    assert last["win"] == [[4.0, -4.0], [5.0, -5.0], [6.0, -6.0]] and last["END_TIME"] == T0 + dt.timedelta(seconds=6)


@pytest.mark.parametrize("size", [1, 5, 4096])
def test_moving_sums_cross_block_borders(spark, size):
    df, pdf = stream(spark)
    out = sequence.moving(df, ["t", "id"], {"s": lambda w: F.sum("score").over(w)}, back=6, ahead=4, size=size).collect()
    x = pdf["score"].to_numpy()
    want = {int(i): x[max(0, p - 6): p + 5].sum() for p, i in enumerate(pdf["id"])}
    assert len(out) == len(pdf)
    for r in out:
        assert r["s"] == pytest.approx(want[r["id"]])


def test_centred_mean_is_the_same_convolution(spark):
    df, pdf = stream(spark, 700)
    got = {r["id"]: r["centred_mean"] for r in sequence.centred_mean(df, "score", ["t", "id"], n=300).collect()}
    want = np.convolve(pdf["score"], np.ones(300) / 300, "same")
    np.testing.assert_allclose([got[i] for i in pdf["id"]], want, atol=1e-12)


def naive_prequential(pdf, f):
    tp = fn = tn = fp = 0.0
    out = {}
    for i, y, p in zip(pdf["id"], pdf["label"], pdf["pred"]):
        if y == 1:
            tp, fn = f * tp + (p == 1), f * fn + (p != 1)
        else:
            tn, fp = f * tn + (p == 0), f * fp + (p != 0)
        r, s = tp / (tp + fn + 1e-9), tn / (tn + fp + 1e-9)
        out[int(i)] = (r, s, math.sqrt(r * s))
    return out


@pytest.mark.parametrize("fade,size,chunk", [(0.99, 7, 3), (0.5, 4, 2), (1.0, 16, 4), (0.99, 4096, 4096)])
def test_prequential_blocks_link_exactly(spark, fade, size, chunk):
    df, pdf = stream(spark)
    got = sequence.prequential(df, ["t", "id"], fade=fade, size=size, chunk=chunk)
    assert set(got.columns) == {*df.columns, "recall", "specificity", "gmean"}
    want = naive_prequential(pdf, fade)
    for r in got.collect():
        np.testing.assert_allclose((r["recall"], r["specificity"], r["gmean"]), want[r["id"]], atol=1e-10)


def test_prequential_per_key(spark):
    df, pdf = stream(spark, keys=3)
    got = {r["id"]: r["gmean"] for r in sequence.prequential(df, ["t", "id"], ["k"], size=16, chunk=2).collect()}
    for _, part in pdf.groupby("k"):
        for i, v in naive_prequential(part, 0.99).items():
            assert got[i] == pytest.approx(v[2], abs=1e-10)


@pytest.mark.parametrize("size", [20, 4096])
def test_prequential_auc(spark, size):
    df, pdf = stream(spark)
    got = {r["id"]: r["pauc"] for r in sequence.prequential_auc(df, ["t", "id"], n=50, size=size).collect()}
    y, s = pdf["label"].to_numpy(), pdf["score"].to_numpy()
    for p, i in enumerate(pdf["id"]):
        yy, ss = y[max(0, p - 49): p + 1], s[max(0, p - 49): p + 1]
        pos, neg = ss[yy == 1], ss[yy == 0]
        want = 0.5
        if len(pos) and len(neg):
            want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
        assert got[i] == pytest.approx(want, abs=1e-9)


def rank_sum(ref, mov):
    both = pd.Series(np.concatenate([ref, mov])).rank().to_numpy()
    n, m = len(ref), len(mov)
    u_ref = n * m + n * (n + 1) / 2 - both[:n].sum()
    u = min(u_ref, n * m - u_ref)
    return u, (u - n * m / 2) / math.sqrt(n * m * (n + m + 1) / 12)


def test_rolling_mann_whitney(spark):
    df, pdf = stream(spark)
    ref = np.round(np.random.default_rng(0).normal(0.3, 1, 40), 1).tolist()
    got = {r["id"]: r for r in sequence.rolling_mann_whitney(df, ["t", "id"], ref).collect()}
    s = pdf["score"].to_numpy()
    for p, i in enumerate(pdf["id"]):
        if p < 39:
            assert got[i]["u"] is None and got[i]["verdict"] == "normal"
            continue
        u, z = rank_sum(ref, s[p - 39: p + 1])
        assert got[i]["u"] == pytest.approx(u) and got[i]["z"] == pytest.approx(z)
        p_val = math.erfc(-z / math.sqrt(2))
        assert got[i]["verdict"] == ("alarm" if p_val < 0.001 else "warn" if p_val < 0.01 else "normal")


def test_rolling_ks_checkpoints(spark):
    df, pdf = stream(spark)
    ref = np.round(np.random.default_rng(0).normal(0.3, 1, 60), 1)
    got = {r["row"]: r for r in sequence.rolling_ks(df, ["t", "id"], ref.tolist(), window=50, every=20).collect()}
    s = pdf["score"].to_numpy()
    assert sorted(got) == [i for i in range(0, 300, 20) if i >= 49]
    for i, r in got.items():
        buf = s[i - 49: i + 1]
        pts = np.concatenate([ref, buf])
        ks = max(abs((ref <= v).mean() - (buf <= v).mean()) for v in pts)
        assert r["ks"] == pytest.approx(ks) and r["mean"] == pytest.approx(buf.mean()) and r["std"] == pytest.approx(buf.std())


@pytest.mark.parametrize("mode", ["recent", "reference"])
def test_threshold_follows_alarms(spark, mode):
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.normal(0, 1, 200), rng.normal(3, 1, 200)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "id long, score double").repartition(3)
    r = rng.normal(0, 1, 500)
    ref = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "id long, score double")
    out, checks = threshold.adapt_on_drift(df, ref, ["id"], ["id"], window=50, every=25, p=0.001, k=2.0, mode=mode)
    alarms = {c["row"] for c in checks.where("alarm = 1").collect()}
    cur = start = r.mean() + 2 * r.std()
    got = {x["id"]: x for x in out.collect()}
    assert alarms and len(got) == 400
    for i in range(400):
        assert got[i]["threshold"] == pytest.approx(cur) and got[i]["pred"] == int(s[i] >= cur)
        if i in alarms:
            buf = s[i - 49: i + 1]
            cur = buf.mean() + 2 * buf.std() if mode == "recent" else start


def test_adwin_finds_a_jump_and_stays_calm(spark):
    rng = np.random.default_rng(4)
    calm, jump = rng.random(3000) < 0.2, np.concatenate([rng.random(1500) < 0.1, rng.random(1500) < 0.6])
    rows = [(k, i, int(v)) for k, x in (("calm", calm), ("jump", jump)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i long, e int").repartition(5)
    out = sequence.adwin(df, ["i"], "e", ["k"])
    hits = [(r["k"], r["end_row"]) for r in out.where("drift = 1").collect()]
    assert hits and all(k == "jump" and 1500 < e < 2200 for k, e in hits)
    ends = {r["k"]: r for r in out.groupBy("k").agg(F.max("end_row").alias("n"), F.max_by("width", "end_row").alias("w")).collect()}
    assert ends["calm"]["n"] == 3000 and ends["calm"]["w"] == 3000 and ends["jump"]["w"] < 2000


def test_adwin_window_keeps_sums():
    w = Adwin()
    for i in range(500):
        w.update(1, i % 2, i % 2)
    assert sum(b[1] for b in w.buckets) == 500 and sum(b[2] for b in w.buckets) == 250
    assert len(w.buckets) < 60


class SlowEnsemble:
    """Literal re-computation with whole windows, for comparison only."""

    def __init__(self, refs, sizes, votes, expiry, refit_min):
        self.ref = [np.array(r)[-n:] for r, n in zip(refs, sizes)]
        self.theta = [np.mean(r) + np.std(r) for r in refs]
        self.sizes, self.votes, self.expiry, self.refit_min = sizes, votes, expiry, refit_min
        self.mov = [deque(maxlen=n) for n in sizes]
        self.buf, self.t, self.warn_at = deque(maxlen=max(sizes)), 0, 0

    def step(self, scores):
        self.t += 1
        warn = alarms = hits = 0
        for i, s in enumerate(scores):
            hits += self.theta[i] is not None and s > self.theta[i]
            self.mov[i].append(s)
            if len(self.mov[i]) == self.sizes[i]:
                p = math.erfc(-rank_sum(self.ref[i], np.array(self.mov[i]))[1] / math.sqrt(2))
                warn, alarms = warn or p < 0.01, alarms + (p < 0.001)
        if warn and not self.warn_at:
            self.warn_at = self.t
        if self.warn_at:
            self.buf.append(scores)
            if self.t - self.warn_at > self.expiry:
                self.warn_at = 0
                self.buf.clear()
        alarm = alarms >= self.votes
        if alarm:
            for i, n in enumerate(self.sizes):
                self.mov[i].clear()
                self.theta[i] = None
                if len(self.buf) >= self.refit_min:
                    new = [b[i] for b in self.buf]
                    self.theta[i], self.ref[i] = np.mean(new) + np.std(new), np.array(new[-n:])
            self.buf.clear()
            self.warn_at = 0
        return int(hits >= 1), float(np.mean(scores)), int(warn), int(alarm)


def test_detector_ensemble(spark):
    rng = np.random.default_rng(8)
    sizes = [30, 36, 42]
    refs = [np.round(rng.normal(0, 1, 100), 1).tolist() for _ in sizes]
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(1.5, 1, 250)])
    scores = [[float(np.round(v + rng.normal(0, 0.2), 1)) for _ in sizes] for v in x]
    settings = dict(votes_drift=3, expiry=40, refit_min=10)
    slow = SlowEnsemble(refs, sizes, 3, 40, 10)
    want = [slow.step(s) for s in scores]
    fast = DetectorEnsemble(refs, sizes, **settings)
    assert [fast.step(s) for s in scores] == [(a, pytest.approx(b), c, d) for a, b, c, d in want]
    assert sum(w[3] for w in want) >= 1
    rows = [(k, i, s) for k in ("a", "b") for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "k string, i long, scores array<double>").repartition(6)
    out = sequence.detector_ensemble(df, "k", ["i"], "scores", refs, sizes, **settings).collect()
    for k in ("a", "b"):
        got = [(r["pred"], r["score"], r["warn"], r["alarm"]) for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["i"])]
        assert got == [(a, pytest.approx(b), c, d) for a, b, c, d in want]


@pytest.fixture
def short_tasks(monkeypatch):
    """Keys above 75 rows are too long for one task."""
    monkeypatch.setattr(ranks, "HOT_ROWS", 75)


def test_long_keys_are_walked_in_segments(spark, short_tasks):
    rng = np.random.default_rng(8)
    sizes = [10, 12, 14]
    refs = [np.round(rng.normal(0, 1, 60), 1).tolist() for _ in sizes]
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(2.5, 1, 120), rng.normal(0, 1, 100)])
    scores = [[float(np.round(v + rng.normal(0, 0.2), 1)) for _ in sizes] for v in x]
    settings = dict(votes_drift=3, expiry=20, refit_min=8, train_sizes=[25, 30, 35], train_max=50)
    walker = DetectorEnsemble(refs, sizes, **settings)
    want = [walker.step(s) for s in scores]
    assert sum(w[3] for w in want) >= 1
    rows = [(k, i, s) for k, n in ((None, 300), ("short", 15)) for i, s in enumerate(scores[:n])]
    df = spark.createDataFrame(rows, "k string, i long, scores array<double>").repartition(6)
    out = sequence.detector_ensemble(df, "k", ["i"], "scores", refs, sizes, **settings).collect()
    assert len(out) == 315
    for k, n in ((None, 300), ("short", 15)):
        got = [(r["pred"], r["score"], r["warn"], r["alarm"]) for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["i"])]
        assert got == [(a, pytest.approx(b), c, d) for a, b, c, d in want[:n]]


def test_adwin_in_segments_equals_one_walk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.random(900) < 0.1, rng.random(900) < 0.7, rng.random(500) < 0.2]).astype(int)
    df = spark.createDataFrame([("a", i, int(v)) for i, v in enumerate(values)], "k string, i long, e int").repartition(3)
    def run():
        out = sequence.adwin(df, ["i"], "e", ["k"], restart=True)
        return [tuple(r) for r in out.orderBy("block").collect()]

    whole = run()
    monkeypatch.setattr(ranks, "HOT_ROWS", 18)
    assert run() == whole and sum(r[-1] for r in whole) >= 1 and whole[-1][2] == 2300


def test_tuning_reports_both_halves(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal() + (i % 5 == 0)), float(rng.normal()), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, e1 double, e2 double, label int")
    grid = [{"w1": w, "window": 50, "every": 25, "p": 0.001, "k": k} for w in (0.2, 1.0) for k in (0.5, 1.0)]
    out = threshold.tune(df, df, ["id"], ["id"], grid).collect()
    assert len(out) == 4 and sum(r["best"] for r in out) == 1
    best = next(r for r in out if r["best"])
    assert best["f1_calibration"] == max(r["f1_calibration"] for r in out) and best["w1"] == 1.0


def test_sweep_equals_one_set_at_a_time(spark):
    """All sets in the same passes, over blocks shorter than the stream, against a walk row by row."""
    rng = np.random.default_rng(6)
    n = 700
    e1 = np.round(np.concatenate([rng.normal(0, 1, 300), rng.normal(1.5, 1, 400)]), 1)
    e2, y = np.round(rng.normal(0, 1, n), 1), (rng.random(n) < 0.2).astype(int)
    ref = np.round(rng.normal(0, 1, (150, 2)), 1)
    df = spark.createDataFrame([(i, float(e1[i]), float(e2[i]), int(y[i])) for i in range(n)], "id long, e1 double, e2 double, label int").repartition(4)
    early = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ref)], "id long, e1 double, e2 double")
    grid = [{"w1": w, "window": a, "every": b, "p": 0.01, "k": 0.8} for w in (0.3, 1.0) for a, b in ((40, 20), (70, 30), (55, 7), (20, 90), (900, 10))]
    out = threshold.tune(df, early, ["id"], ["id"], grid, size=100).collect()
    assert [r["trial"] for r in out] == list(range(len(grid)))
    changed = 0
    for g, r in zip(grid, out):
        s, base = g["w1"] * e1 + (1 - g["w1"]) * e2, g["w1"] * ref[:, 0] + (1 - g["w1"]) * ref[:, 1]
        current, pred = base.mean() + g["k"] * base.std(), np.zeros(n, int)
        for i in range(n):
            pred[i] = s[i] >= current
            if i % g["every"] == 0 and i >= g["window"] - 1:
                buf = s[i - g["window"] + 1 : i + 1]
                ks = max(abs((base <= v).mean() - (buf <= v).mean()) for v in [*base, *buf])
                lam = math.sqrt(len(base) * len(buf) / (len(base) + len(buf))) * ks
                if lam >= 0.2 and 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101)) < g["p"]:
                    current, changed = buf.mean() + g["k"] * buf.std(), changed + 1
        for half, name in ((slice(0, n // 2), "f1_calibration"), (slice(n // 2, n), "f1_evaluation")):
            f1 = [2 * ((y[half] == c) & (pred[half] == c)).sum() / max(1, (y[half] == c).sum() + (pred[half] == c).sum()) for c in (0, 1) if (y[half] == c).any() or (pred[half] == c).any()]
            assert r[name] == pytest.approx(np.mean(f1))
    assert changed > 20


def test_sweep_on_odd_streams(spark):
    schema = "id long, e1 double, e2 double, label int"
    rows = [(0, None, 1.0, 1), (1, float("nan"), 1.0, None), (2, 1.0, 1.0, 0), (3, 1.0, 1.0, 1)]
    df = spark.createDataFrame([(i, a, b, c) for i, (_, a, b, c) in enumerate(rows * 20)], schema)
    good = spark.createDataFrame([(i, float(i % 3), 1.0) for i in range(30)], "id long, e1 double, e2 double")
    grid = [{"w1": 0.5, "window": 8, "every": 4, "p": 0.5, "k": 1.0}]
    assert len(threshold.tune(df, good, ["id"], ["id"], grid, size=10).collect()) == 1
    empty = threshold.tune(df.limit(0), good, ["id"], ["id"], grid).collect()
    assert [(r["f1_calibration"], r["best"]) for r in empty] == [(None, 1)]
    with pytest.raises(ValueError):
        threshold.tune(df, good.limit(0), ["id"], ["id"], grid)


def test_registered_search_and_ensemble_do_the_whole_job(spark, monkeypatch):
    from driftloom.catalog import sequences as catalog

    seen = {}
    monkeypatch.setattr(catalog.threshold, "tune", lambda *args: seen.update(grid=args[-1]) or args[0].select(F.lit(0.0).alias("f1_calibration"), F.lit(0.0).alias("f1_evaluation")))
    monkeypatch.setattr(catalog.sequence, "detector_ensemble", lambda df, *args, **kw: seen.update(kw, refs=args[3]) or df)
    catalog.threshold_tuning(spark, "/root/testdata/sf0.001")
    assert len(seen["grid"]) == 60 and all(len({g[c] for g in seen["grid"]}) >= 9 for c in ("w1", "window", "every", "p", "k"))
    assert all(0.1 <= g["w1"] <= 0.9 and 200 <= g["window"] <= 1000 and 20 <= g["every"] <= 200 and 1e-4 <= g["p"] <= 1e-2 and 1 <= g["k"] <= 3 for g in seen["grid"])
    catalog.ensemble_verdicts(spark, "/root/testdata/sf0.001", init_size=50)
    assert len(seen["train_sizes"]) == 10 and min(seen["train_sizes"]) >= 1000 and [len(r) for r in seen["refs"]] == [50] * 10
