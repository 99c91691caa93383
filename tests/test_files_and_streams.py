import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import adapt, ranks
from driftloom.operators.forests import unpacked
from driftloom.operators.sequence import prequential, sliding_windows
from driftloom.sinks import runs, writers
from driftloom.sources import readers
from driftloom.sources.ordered import ordered_stream
from driftloom.sources.schema import kpi_schema
from driftloom.streaming import drift_loop, pipelines


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_kpi_and_edge_csv(spark, folder):
    names = [f.name for f in kpi_schema().fields]
    row = ["2024-01-01 08:00:00", "C1", "3"] + [""] * (len(names) - 3)
    write(f"{folder}/kpi.csv", ",".join(names) + "\n" + ",".join(row) + "\n")
    df = readers.read_kpi_csv(spark, f"{folder}/kpi.csv")
    r = df.first()
    assert len(df.columns) == 145 and r["DATETIME"].hour == 8 and r["CARRIER"] == 3 and r["LAT"] is None
    write(f"{folder}/e.csv", "Unnamed: 0,CELL,N_CELL,Overlap_Alan%\n0,A,B,41.5\n")
    assert readers.read_edges_csv(spark, f"{folder}/e.csv").columns == ["CELL", "N_CELL", "Overlap_Alan%"]


def test_libsvm_files_in_number_order(spark, folder):
    for n in (1, 2, 9, 10):
        write(f"{folder}/batch{n}.dat", f"{n % 6 + 1} 1:0.5 3:{n}.25\n2 128:1.0\n")
    a = readers.read_libsvm_batches(spark, f"{folder}/batch*.dat")
    b = readers.read_libsvm_text(spark, f"{folder}/batch*.dat")
    assert readers.list_batches(a) == [1, 2, 9, 10]
    key = lambda r: (r["batch"], r["label"], r["features"])
    rows = sorted(map(key, a.collect()))
    assert rows == sorted(map(key, b.collect()))
    assert len(rows[0][2]) == 128 and {r[2][2] for r in rows if r[2][0] == 0.5} == {1.25, 2.25, 9.25, 10.25}
    other = spark.createDataFrame([("/x/notes.txt",)], ["p"]).select(readers.batch_number(F.col("p"))).first()[0]
    assert other == 10**9


def test_labelled_csv_by_name_and_position(spark, folder):
    write(f"{folder}/card.csv", "Time,V1,V2,Class\n0,1.5,2.5,0\n1,3.5,4.5,1\n")
    df = readers.read_labelled_csv(spark, f"{folder}/card.csv", "Class", drop=["Time"])
    assert df.columns == ["f0", "f1", "label"] and df.agg(F.sum("f1")).first()[0] == 7.0
    write(f"{folder}/ecg.csv", "0.1,0.2,0\n0.3,0.4,3\n")
    ecg = readers.read_labelled_csv(spark, f"{folder}/ecg.csv", -1, header=False, positive=lambda y: y > 0)
    assert sorted(r["label"] for r in ecg.collect()) == [0, 1]


def test_parquet_and_csv_sinks(spark, folder):
    df = readers.frame_from_matrix(spark, np.arange(6).reshape(3, 2), [0, 1, 0])
    writers.write_parquet(df, folder)
    writers.write_parquet(df, folder)
    assert readers.read_parquet(spark, folder).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.read_parquet(spark, folder + "-none")
    writers.write_result_csv(df, folder + "-csv")
    assert len([f for f in os.listdir(folder + "-csv") if f.endswith(".csv")]) == 1


def test_score_cache(spark, folder):
    df = spark.range(5)
    calls = []

    def score(d):
        calls.append(1)
        return d.withColumn("score", F.col("id") * 2.0)

    for n in (5, 5, 6):
        assert readers.scores_or_compute(spark.range(n), folder, score).count() == n
    assert len(calls) == 2 and df.count() == 5
    other = spark.range(1, 6)  # as many rows, other ones
    assert {r["score"] for r in readers.scores_or_compute(other, folder, score).collect()} == {2.0, 4.0, 6.0, 8.0, 10.0}
    readers.scores_or_compute(other.repartition(3).orderBy(F.desc("id")), folder, score)
    assert len(calls) == 3
    readers.scores_or_compute(other, folder, score, model="second")
    assert len(calls) == 4
    assert readers.content_key(spark.range(0)) != readers.content_key(spark.range(1)) != readers.content_key(spark.range(1).union(spark.range(1)))


def test_unfinished_scores_are_computed_anew(spark, folder):
    df = spark.range(4)

    def broken(d):
        return d.withColumn("score", F.raise_error(F.lit("the executor is gone")).cast("double"))

    with pytest.raises(Exception):
        readers.scores_or_compute(df, folder, broken).collect()
    assert readers.scores_or_compute(df, folder, lambda d: d.withColumn("score", F.lit(1.0))).count() == 4


def test_run_log(spark, folder):
    for loss in (0.5, 0.3):
        with runs.logged_run(spark, folder, "exp", f"run {loss}") as run:
            run.param("k", 2)
            run.metric("train_loss", 9.0, 0)
            run.metric("train_loss", loss, 1)
    with pytest.raises(ZeroDivisionError):
        with runs.logged_run(spark, folder, "exp", "bad"):
            1 / 0
    log = runs.read_runs(spark, folder)
    assert runs.best_run(log).first()["value"] == 0.3
    flags = sorted(r["value"] for r in log.where("key = 'success'").collect())
    assert flags == ["no", "yes", "yes"] and log.where("key = 'error'").count() == 1
    assert runs.compare_runs(log, ["train_loss"]).where("train_loss = 0.5").count() == 1
    full = runs.backfill_tag(log, "mode", {"run 0.5": "static"})
    assert full.where("key = 'mode'").first()["value"] == "static"
    assert runs.backfill_tag(full, "mode", {"run 0.5": "other"}).where("key = 'mode'").count() == 1


def slices(spark, folder, df, borders):
    low = -1
    for high in borders:
        df.where((F.col("id") > low) & (F.col("id") <= high)).coalesce(1).write.mode("append").parquet(folder)
        low = high
    return pipelines.parquet_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)


def sensor(spark):
    return spark.range(90).select(
        "id", (F.col("id") % 3).cast("string").alias("CELL"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("DATETIME"),
        (F.col("id") * 1.5).alias("x"), (F.col("id") % 5 == 0).cast("int").alias("label"), (F.col("id") % 7 == 0).cast("int").alias("pred"),
    )


def test_stream_equals_batch(spark, folder):
    df = sensor(spark)
    s = slices(spark, folder, df, [20, 50, 89])
    got = pipelines.sliding(s, "CELL", "DATETIME", ["x"], 4, "id")
    want = sliding_windows(df, ["x"], 4, tie=["id"])
    pick = lambda d: sorted((r["CELL"], r["id"], str(r["END_TIME"]), str(r["win"])) for r in d.collect())
    assert pick(got) == pick(want)
    faded = {r["id"]: r["gmean"] for r in pipelines.faded_counters(s, "CELL", ["DATETIME", "id"]).collect()}
    for r in prequential(df, ["DATETIME", "id"], ["CELL"]).collect():
        assert faded[r["id"]] == pytest.approx(r["gmean"], abs=1e-10)
    agg = pipelines.tumbling(s, [("sum_x", "sum", "x")], ["CELL"], "DATETIME")
    flat = agg.select(F.col("window.start").alias("w"), "CELL", "sum_x")
    late = {(r["w"], r["CELL"]): r["sum_x"] for r in pipelines.replay_latest(flat, ["w", "CELL"], "tw").collect()}
    batch = df.groupBy(F.window("DATETIME", "8 hours").start.alias("w"), "CELL").agg(F.sum("x").alias("s")).collect()
    assert late == {(r["w"], r["CELL"]): r["s"] for r in batch}


def blobs(spark, n=60, batches=4):
    rng = np.random.default_rng(0)
    rows = []
    for b in range(batches):
        for i in range(n):
            y = i % 2
            sign = 1 if b < 2 else -1  # the classes swap places half way
            rows.append((b * n + i, b, y, [float(sign * (2 * y - 1) * 3 + rng.normal()), float(rng.normal())]))
    return spark.createDataFrame(rows, "id long, batch int, label int, features array<double>")


def test_strategies_test_before_training(spark):
    out = {(r["batch"], r["strategy"]): r for r in adapt.strategies(blobs(spark), ["id"], trees=5).collect()}
    assert len(out) == 16
    assert all(out[(0, s)]["in_sample"] for s in ("static", "cumulative", "window", "drift"))
    assert out[(1, "static")]["accuracy"] > 0.9 and out[(2, "window")]["accuracy"] < 0.2
    assert out[(2, "drift")]["drift"] in (0, 1) and out[(3, "window")]["accuracy"] > 0.9
    assert out[(3, "static")]["accuracy"] < 0.2


def test_drift_loop_gauges(spark, folder):
    df = blobs(spark, n=300)
    for b in range(4):
        df.where(F.col("batch") == b).coalesce(1).write.mode("append").parquet(folder)
    s = pipelines.parquet_stream(spark, folder, "*.parquet", df.schema)
    g = {(r["batch"], r["name"]): r["value"] for r in drift_loop.drift_loop(s, ["id"], trees=5).collect()}
    assert (0, "model_accuracy") not in g and g[(0, "drift_detected")] == 0
    assert g[(1, "model_accuracy")] > 0.9 and g[(2, "model_accuracy")] < 0.2
    assert g[(2, "retrain_performed")] == 1 and g[(3, "model_accuracy")] > 0.9


def gauges_of(df):
    return sorted((r["name"], r["batch"], round(r["value"], 9)) for r in df.collect())


def test_drift_loop_goes_on_after_a_stop_and_after_a_failure(spark, tmp_path, monkeypatch):
    """Model, window and batch number lie beside the progress: a new run, and a repeated micro-batch, continue from them."""
    df = blobs(spark, n=300)

    def add(folder, batches):
        for b in batches:
            df.where(F.col("batch") == b).coalesce(1).write.mode("append").parquet(folder)
        return pipelines.parquet_stream(spark, folder, "*.parquet", df.schema)

    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    want = gauges_of(drift_loop.drift_loop(add(whole, range(4)), ["id"], trees=5))
    into = str(tmp_path / "loop")
    drift_loop.drift_loop(add(cut, [0, 1]), ["id"], trees=5, into=into)
    add(cut, [2, 3])
    append = runs.append_gauges

    def broken(spark, path, *args):
        append(spark, path, *args)
        if path.endswith("part=2"):
            raise OSError("the driver is gone")

    stream = pipelines.parquet_stream(spark, cut, "*.parquet", df.schema)
    monkeypatch.setattr(drift_loop, "append_gauges", broken)
    with pytest.raises(Exception):
        drift_loop.drift_loop(stream, ["id"], trees=5, into=into)
    monkeypatch.setattr(drift_loop, "append_gauges", append)
    assert gauges_of(drift_loop.drift_loop(stream, ["id"], trees=5, into=into)) == want
    assert any(name == "retrain_performed" and value for name, _, value in want)


def test_previous_batch_models_are_paired_by_rows(spark):
    df = blobs(spark, n=40)
    means = adapt.class_means(df)
    pred = adapt.nearest_mean(df, means.withColumn("batch", F.col("batch") + 1)).collect()
    centre = {(r["batch"], r["label"]): np.array(r["mean"]) for r in means.collect()}
    rows = {r["id"]: r for r in df.collect()}
    assert len(pred) == 120 and {r["batch"] for r in pred} == {1, 2, 3}
    for r in pred:
        x, b = np.array(rows[r["id"]]["features"]), r["batch"] - 1
        assert r["pred"] == min((0, 1), key=lambda c: (((x - centre[b, c]) ** 2).sum(), c))


def test_linear_forest_and_importance(spark, folder):
    lin = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    _, m = adapt.linear_fit(lin)
    assert m["rmse"] == pytest.approx(0, abs=1e-6) and m["r2"] == pytest.approx(1)
    df = blobs(spark, batches=1)
    model = adapt.fit_forest(df, 5)
    writers.save_model(model, folder)
    top = adapt.importance_change(spark, model, type(model).load(folder)).collect()
    assert top[0]["feature"] == 0 and top[0]["change"] == 0
    assert adapt.cross_validate(df, ["id"], folds=3, trees=5) > 0.9


def test_trees_grow_past_five_levels(spark):
    """Stripes of two classes along one feature need more than 32 leaves."""
    df = spark.createDataFrame([(i, [float(i // 4)], i // 4 % 2) for i in range(80)], "id long, features array<double>, label int")
    def depth(raw):
        _, feature, child, *_ = unpacked(raw)
        deep = np.zeros(len(feature), int)
        for n in np.flatnonzero(feature >= 0):  # children come after their parents
            deep[child[n]] = deep[child[n] + 1] = deep[n] + 1
        return deep.max()

    assert max(depth(r["nodes"]) for r in adapt.fit_forest(df, 5).table.collect()) > 5
    wide = spark.createDataFrame([(i, [float(i % 100)], i % 100 % 2) for i in range(2000)], "id long, features array<double>, label int")
    deep, cut = (adapt.cross_validate(wide, ["id"], folds=2, trees=5, depth=d) for d in (30, 5))
    assert adapt.cross_validate(wide, ["id"], folds=2, trees=5) == deep and deep > cut


def test_ordered_batches_restart_and_repeat(spark, tmp_path):
    """Micro-batches follow the numbers; a failed one is given again with the same number and rows, later files come next."""
    root, into = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(120).select("id", F.timestamp_seconds("id").alias("ts"), (11 - F.col("id") % 12).cast("int").alias("number"))
    df.where("number between 2 and 8").write.partitionBy("number").parquet(root)
    (tmp_path / "in" / "notes").mkdir()
    seen, fail = [], [4]

    def handle(rows, step):
        got = rows.agg(F.collect_list("id").alias("ids"), F.min("ts").alias("t")).first()
        seen.append((step, sorted(got["ids"]), got["t"].second))
        if fail and step == fail[0]:
            fail.pop()
            raise OSError("the driver is gone")

    def run():
        pipelines.for_each_batch(ordered_stream(spark, root, df.drop("number").schema), handle, "n", into)

    with pytest.raises(Exception):
        run()
    assert [s for s, *_ in seen] == [0, 1, 2, 3, 4]
    run()
    df.where("number > 8").write.mode("append").partitionBy("number").parquet(root)
    run()
    run()
    assert [s for s, *_ in seen] == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    assert seen[4] == seen[5]
    for step, ids, t in seen:
        assert ids == [i for i in range(120) if 11 - i % 12 == step + 2] and t == min(ids)


def test_libsvm_stream_takes_batches_by_number(spark, tmp_path):
    for n in (10, 2, 9, 1):
        (tmp_path / f"batch{n}.dat").write_text(f"{n % 6} 1:{n}.5 3:2\n\n1 2:-1\n")
    (tmp_path / "notes.dat").write_text("4 1:9\n")
    seen = []
    pipelines.for_each_batch(pipelines.libsvm_stream(spark, str(tmp_path), 3), lambda rows, step: seen.append(rows.collect()), "libsvm", str(tmp_path / "out"))
    assert [{r["batch"] for r in rows} for rows in seen] == [{1}, {2}, {9}, {10}]
    assert sorted((r["label"], r["features"]) for r in seen[3]) == [(1, [0.0, -1.0, 0.0]), (4, [10.5, 0.0, 2.0])]


def test_keyed_streams_go_on_after_a_stop(spark, tmp_path, monkeypatch):
    """Hot keys are cut into blocks; keys that a micro-batch does not hold keep their state, null keys too."""
    monkeypatch.setattr(ranks, "HOT_ROWS", 20)
    df = sensor(spark).withColumn("CELL", F.when(F.col("id") % 8 == 1, None).when(F.col("id").between(20, 60), "0").otherwise(F.col("CELL")))
    root = str(tmp_path / "in")
    numbered = df.withColumn("number", (F.col("id") / 30).cast("int"))
    numbered.where("number < 2").write.partitionBy("number").parquet(root)

    def run():
        s = ordered_stream(spark, root, df.schema)
        win = pipelines.sliding(s, "CELL", "DATETIME", ["x"], 4, "id", str(tmp_path / "win"))
        faded = pipelines.faded_counters(s, "CELL", ["DATETIME", "id"], into=str(tmp_path / "faded"))
        return sorted((str(r["CELL"]), r["id"], r["END_TIME"], str(r["win"])) for r in win.collect()), {r["id"]: r for r in faded.collect()}

    run()
    numbered.where("number = 2").write.mode("append").partitionBy("number").parquet(root)
    windows, faded = run()
    want = sliding_windows(df, ["x"], 4, tie=["id"]).collect()
    assert windows == sorted((str(r["CELL"]), r["id"], r["END_TIME"], str(r["win"])) for r in want)
    rows = prequential(df, ["DATETIME", "id"], ["CELL"]).collect()
    assert len(faded) == len(rows) == 90
    for r in rows:
        for c in ("recall", "specificity", "gmean"):
            assert faded[r["id"]][c] == pytest.approx(r[c], abs=1e-10)


def test_keyed_stream_without_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = pipelines.sliding(ordered_stream(spark, str(tmp_path / "in"), sensor(spark).schema), "CELL", "DATETIME", ["x"], 4, "id")
    assert got.columns == ["CELL", "END_TIME", "id", "win"] and got.count() == 0


def test_sparse_lines_are_split_once(spark):
    """Odd pieces of a line, and time that grows with the line and not with its length times the width."""
    lines = [("1 1:2.5 3:4",), (" 2  7:1 2:x 200:3 0:5 -1:2 128:9",), ("x",), ("  ",), (None,), ("6 127:1",)]
    got = readers.parse_libsvm_text(spark.createDataFrame(lines, "value string")).collect()
    assert [(r.label, len(r.features), {i: v for i, v in enumerate(r.features, 1) if v}) for r in got] == [
        (1, 128, {1: 2.5, 3: 4.0}), (2, 128, {7: 1.0, 128: 9.0}), (None, 128, {}), (6, 128, {127: 1.0}),
    ]
    pairs = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.concat(i.cast("string"), F.lit(":1.5")))
    many = spark.range(20_000).select(F.concat_ws(" ", F.lit("1"), F.array_join(pairs, " ")).alias("value"))
    start = time.monotonic()
    assert readers.parse_libsvm_text(many).agg(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x))).first()[0] == 20_000 * 64 * 1.5
    assert time.monotonic() - start < 30  # 100 and more when every number split its line anew
