import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftloom.functions import columns as C
from driftloom.functions.names import feature_name, first_matching, normalise_names, numeric_columns, q
from driftloom.operators import clean, features, joins
from driftloom.sources.schema import OVERLAP, FeatureConfig, edge_schema, kpi_schema


def test_normalise_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], [" SITE ", "[H] Traffic Volume Gbyte", "a [H] b"])
    assert normalise_names(df).columns == ["CELL", "Traffic_Volume_Gbyte", "a [H] b"]
    assert normalise_names(df, anywhere=True).columns[2] == "a b"
    both = spark.createDataFrame([(1, 2)], ["SITE", "SectorID"])
    with pytest.raises(ValueError, match="collide"):
        normalise_names(both)
    with pytest.raises(ValueError, match="absent"):
        normalise_names(spark.createDataFrame([(1,)], ["x"]))


def test_schema_and_names(spark):
    s = kpi_schema()
    assert len(s) == 145 and s[-1].name == "L.UL.Interference.Avg.PRB99" and all(f.nullable for f in s)
    df = spark.createDataFrame([], s)
    nums = numeric_columns(df)
    assert "LAT" not in nums and "L.UL.Interference.Max" in nums and "CELL" not in nums
    assert feature_name("L.UL.Interference.Max") == "avg_L_UL_Interference_Max_8h"
    assert first_matching(["a_b", "b_c"], "b_") == "b_c" and first_matching(["a"], "z") is None
    assert FeatureConfig().check(spark.createDataFrame([(1.0,)], ["avg_cqi_8h"])) == ["avg_cqi_8h"]
    with pytest.raises(ValueError):
        FeatureConfig(skip_missing=False).check(df)


def test_time_and_number_parsing(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("02.01.2024 03:04:05",), ("rubbish",), (None,)], ["t"])
    got = [r[0] for r in df.select(C.parse_time(F.col("t"))).collect()]
    assert got[0] == got[1] == dt.datetime(2024, 1, 2, 3, 4, 5) and got[2] is None and got[3] is None
    nums = spark.createDataFrame([("1.5",), ("x",)], ["n"]).select(C.parse_number(F.col("n"))).collect()
    assert [r[0] for r in nums] == [1.5, None]


def test_clean_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, "a"), (None, None, 4.0, None)], "x double, gone double, `L.prb1` double, N_CELL string")
    kept = clean.drop_named(clean.drop_empty_columns(df))
    assert kept.columns == ["x", "N_CELL"]
    assert [tuple(r) for r in clean.fill_zero(kept).collect()] == [(1.0, "a"), (0.0, None)]
    full = clean.ensure_features(kept, ["x", "new"])
    assert full.schema["new"].dataType.simpleString() == "double"
    assert [r["x"] for r in clean.fill_median(full, ["x", "new"]).collect()] == [1.0, 1.0]


def test_row_mean_and_transpose(spark):
    df = spark.createDataFrame([(1, 1.0, None, 3.0), (2, None, None, None)], "t int, a double, b double, c double")
    out = clean.fill_row_mean(df, ["a", "b", "c"]).orderBy("t").collect()
    assert out[0]["b"] == 2.0 and out[1]["a"] is None
    long = clean.to_long(df, ["t"], ["a", "b", "c"])
    back = clean.to_wide(long, ["t"], ["a", "b", "c"]).orderBy("t").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("t").collect()]


def test_min_max_of_constant_and_empty(spark):
    df = spark.createDataFrame([([2.0, 2.0],)], "m array<double>")
    assert clean.matrix_min_max(df, "m").first()["scaled"] == [0.0, 0.0]
    assert clean.matrix_min_max(df.limit(0), "m").count() == 0


def test_roll_pad_band(spark):
    pic = list(range(9))
    row = spark.createDataFrame([(list(map(float, pic)),)], "p array<double>").select(
        C.roll_rows(F.col("p"), 1, 3).alias("r"), C.pad_or_crop(F.col("p"), 12).alias("pad"), C.pad_or_crop(F.col("p"), 2).alias("crop")
    ).first()
    assert row["r"] == [6, 7, 8, 0, 1, 2, 3, 4, 5] and row["pad"] == pic + [0, 0, 0] and row["crop"] == [0, 1]
    b = spark.createDataFrame([(v,) for v in (9.9, 10.0, 49.0, 70.0)], "v double").select(C.band(F.col("v")).alias("b"))
    assert [r["b"] for r in b.collect()] == ["very low", "low", "moderate", "very high"]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, edge_schema())


def test_neighbour_windows_equal_join_then_group(spark):
    t = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame(
        [("A", t, 1.0), ("A", t + dt.timedelta(hours=1), 4.0), ("A", t + dt.timedelta(hours=9), None), ("B", t, 5.0)],
        "CELL string, DATETIME timestamp, v double",
    )
    # A-X is listed twice: its measurements count twice in sums, A-Y is below the bound.
    edges = edges_of(spark, [("A", "X", 40.0), ("A", "X", 90.0), ("A", "Z", 41.0), ("A", "Y", 39.9)])
    specs = [("avg_v", "avg", "v"), ("sum_v", "sum", "v")]
    got = features.neighbour_window_features(facts, edges, specs)
    plain = joins.join_neighbours(facts, edges)
    want = clean.fill_zero(features.window_features(plain, specs, ["CELL", "N_CELL"])).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("N_CELL is null").first()["CELL"] == "B"


def test_neighbour_totals(spark):
    facts = spark.createDataFrame([("A", 1.0, 2.0), ("A", 3.0, None), ("B", 10.0, 4.0)], "CELL string, v double, w double")
    edges = edges_of(spark, [("A", "X", 1.0), ("A", "Y", 1.0), ("C", "X", 1.0)])
    one = joins.neighbour_totals(facts, edges, {"s": "v"}, {"m": "w"}).first()
    plain = facts.join(edges, "CELL", "left").agg(F.sum("v").alias("s"), F.avg("w").alias("m")).first()
    assert (one["s"], one["m"]) == (plain["s"], plain["m"])
    assert joins.neighbour_totals(facts, edges, {"s": "v"}, {"m": "w"}, fanout_safe=True).first()["s"] == 14.0


def test_labels_collapse_by_max(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 5, 300000)
    wins = spark.createDataFrame([("1", t), ("2", t)], "CELL string, END_TIME timestamp")
    labels = spark.createDataFrame([(" 1 ", t, 0), ("1", t.replace(microsecond=0), 1), ("1", t, None)], "CELL string, END_TIME timestamp, label int")
    got = {r["CELL"]: r["label"] for r in joins.attach_labels(wins, labels).collect()}
    assert got == {"1": 1, "2": 0}


def test_dotted_and_percent_names(spark):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0, 2.0)], ["CELL", "DATETIME", "L.UL.Max", "Util_%"])
    specs = features.auto_specs(df)
    row = features.window_features(df, specs).first()
    assert row["avg_L_UL_Max_8h"] == 1.0 and row["avg_Util_%_8h"] == 2.0
    assert q("L.UL.Max") is not None and OVERLAP == "Overlap_Alan%"
