"""Sources and sinks: tables written to files in the formats of the readers and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.catalog.inputs import EDGES, EVENTS, FACTS, VECTORS, edges, events, facts, query, r6, scratch, table, vectors
from driftloom.functions.names import q
from driftloom.operators import adapt
from driftloom.operators.forests import Forest
from driftloom.operators.moments import fit_pca, moments, score_rows
from driftloom.operators.scaling import fit_standard
from driftloom.sinks import runs, writers
from driftloom.sources import readers
from driftloom.sources.schema import OVERLAP, kpi_schema


@query("csv_table", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(date_trunc('second', ts)) AS first_time FROM events GROUP BY event_type""")
def csv_table(spark, sf):
    path = scratch(spark, "csv")
    e = events(spark, sf).select("event_id", F.date_format("ts", readers.TIME_FORMAT).alias("DATETIME"), "event_type", "value")
    writers.write_result_csv(e, path, one_file=False)
    back = readers.read_csv(spark, path)
    return back.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("DATETIME").alias("first_time")
    )


@query("kpi_csv_table", f"""SELECT CELL, count(*) AS n, round(sum(Traffic_Volume_Gbyte), 4) AS traffic, round(avg(ERAB_Drop_PC), 6) AS drop_rate,
  CAST(145 AS INTEGER) AS width FROM ({FACTS}) GROUP BY CELL""")
def kpi_csv_table(spark, sf):
    path = scratch(spark, "kpi")
    f = facts(spark, sf)
    known = {"CELL", "Traffic_Volume_Gbyte", "ERAB_Drop_PC"}
    cols = [
        F.date_format("DATETIME", readers.TIME_FORMAT).alias("DATETIME") if s.name == "DATETIME"
        else q(s.name) if s.name in known else F.lit(None).cast("string").alias(s.name)
        for s in kpi_schema().fields
    ]
    writers.write_result_csv(f.select(*cols), path, one_file=False)
    back = readers.read_kpi_csv(spark, path)
    return back.groupBy("CELL").agg(
        F.count("DATETIME").alias("n"), F.round(F.sum("Traffic_Volume_Gbyte"), 4).alias("traffic"),
        r6(F.avg("ERAB_Drop_PC"), "drop_rate"), F.lit(len(back.columns)).alias("width"),
    )


@query("edges_csv_table", f"SELECT CELL, N_CELL, round(overlap, 6) AS overlap FROM ({EDGES})")
def edges_csv_table(spark, sf):
    path = scratch(spark, "edges")
    e = edges(spark, sf).select(F.xxhash64("CELL", "N_CELL").alias("Unnamed: 0"), "CELL", "N_CELL", q(OVERLAP))
    writers.write_result_csv(e, path)
    back = readers.read_edges_csv(spark, path)
    return back.select(F.col("CELL").cast("string").alias("CELL"), F.col("N_CELL").cast("string").alias("N_CELL"), r6(q(OVERLAP), "overlap"))


FOLDER = r"batch=(\d+)/"  # Spark names the files itself, so the folder carries the number
SPARSE = f"""SELECT batch + 1 AS batch, label, count(*) AS n, round(sum(list_sum(features)), 4) AS total, 128 AS width FROM ({VECTORS}) GROUP BY ALL"""


def sparse_lines(spark, sf):
    cells = F.transform("features", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))
    return vectors(spark, sf).select(
        (F.col("batch") + 1).alias("batch"), F.concat_ws(" ", F.col("label").cast("string"), F.array_join(cells, " ")).alias("value")
    )


def sparse_summary(df):
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return df.groupBy("batch", "label").agg(
        F.count("*").alias("n"), F.round(F.sum(total), 4).alias("total"), F.max(F.size("features")).alias("width")
    )


@query("libsvm_batches", SPARSE)
def libsvm_batches(spark, sf):
    path = scratch(spark, "libsvm")
    sparse_lines(spark, sf).write.partitionBy("batch").text(path)
    return sparse_summary(readers.read_libsvm_batches(spark, f"{path}/batch=*", 128, FOLDER))


@query("libsvm_text_batches", SPARSE)
def libsvm_text_batches(spark, sf):
    path = scratch(spark, "libsvm-text")
    sparse_lines(spark, sf).write.partitionBy("batch").text(path)
    return sparse_summary(readers.read_libsvm_text(spark, f"{path}/batch=*", 128, FOLDER))


@query("natural_batch_order", """SELECT CAST(p_size AS INTEGER) AS batch, count(*) AS n, row_number() OVER (ORDER BY p_size) AS place FROM part GROUP BY p_size
  UNION ALL SELECT 1000000000, count(*), (SELECT count(DISTINCT p_size) FROM part) + 1 FROM part""")
def natural_batch_order(spark, sf):
    """Lines written to files of a batch's name and to others, and read back in the order of the numbers."""
    path = scratch(spark, "named")
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("value"), "p_size")
    names = F.array(F.format_string("batch%d.dat", "p_size"), F.format_string("notes%d.txt", "p_size"))
    p.select("value", F.explode(names).alias("file")).write.partitionBy("file").text(path)
    lines = spark.read.text(path).select(readers.batch_number(F.col("_metadata.file_path"), r"batch(\d+)\.dat/").alias("batch"))
    counts = lines.groupBy("batch").agg(F.count("*").alias("n"))  # one row per batch
    return counts.withColumn("place", F.row_number().over(Window.orderBy("batch")).cast("long"))


@query("labelled_csv", """SELECT CAST(label > 2 AS INTEGER) AS label, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS f0,
  round(sum(CAST(embedding[64] AS DOUBLE)), 4) AS f63 FROM embeddings GROUP BY 1""")
def labelled_csv(spark, sf):
    path = scratch(spark, "labelled")
    v = vectors(spark, sf)
    wide = v.select(*[q("features")[i].alias(f"c{i}") for i in range(64)], "label")
    wide.write.option("header", False).csv(path)
    back = readers.read_labelled_csv(spark, path, label=-1, header=False, positive=lambda y: y > 2)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("f0"), 4).alias("f0"), F.round(F.sum("f63"), 4).alias("f63"))


@query("stored_scores", f"""WITH v AS (SELECT vec_id, features[1] AS x, features[2] AS y FROM ({VECTORS})),
  m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, sign(corr(x, y)) AS s FROM v)
  SELECT vec_id, round(power((x - mx) / sx - s * (y - my) / sy, 2) / 4, 6) AS score FROM v, m""")
def stored_scores(spark, sf):
    """Reconstruction errors of two columns, for which one component has a closed form."""
    v = vectors(spark, sf).withColumn("features", F.slice("features", 1, 2))
    pca = fit_pca(moments(v), 1)
    path = scratch(spark, "scores")

    def score(df):
        return score_rows(df, {"score": pca}).select("vec_id", "score")

    readers.scores_or_compute(v, path, score)  # computed and stored
    again = readers.scores_or_compute(v, path, lambda df: score(df).limit(0))  # found, not computed
    return again.select("vec_id", r6("score"))


@query("numeric_scaled_labels", f"""SELECT label, count(*) AS n, round(avg((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)), 6) AS value
  FROM ({EVENTS}) GROUP BY label""")
def numeric_scaled_labels(spark, sf):
    e = readers.split_label(events(spark, sf).select("value", "k", "label"), "label")
    s = fit_standard(e, ["f0"]).apply(e)
    return s.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("f0"), "value"))


# A run table in the shape of the log: one run per event type, the daily means are its metric.
RUNS = """SELECT event_type AS run_id, CAST(extract(day FROM ts) AS BIGINT) AS step, avg(value) AS v FROM events GROUP BY ALL"""


def run_table(spark, sf):
    e = events(spark, sf)
    when = F.lit("2024-02-01").cast("timestamp")
    daily = e.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").cast("long").alias("step")).agg(F.avg("value").alias("v"))
    rows = daily.select(
        "run_id", F.lit("daily").alias("experiment"), F.lit("metric").alias("kind"),
        F.explode(F.array(F.lit("train_loss"), F.lit("f1_macro"))).alias("key"), F.col("v").cast("string").alias("value"), "step", when.alias("ts"),
    )
    tags = daily.select("run_id").distinct().select(
        "run_id", F.lit("daily").alias("experiment"), F.lit("tag").alias("kind"), F.lit("run_name").alias("key"),
        F.concat(F.lit("run-"), "run_id").alias("value"), F.lit(None).cast("long").alias("step"), when.alias("ts"),
    )
    path = scratch(spark, "runs")
    rows.unionByName(tags).write.mode("append").parquet(path)
    return runs.read_runs(spark, path)


LAST = f"SELECT run_id, arg_max(v, step) AS v FROM ({RUNS}) GROUP BY run_id"


@query("best_run", f"SELECT 'daily' AS experiment, run_id, round(v, 6) AS value FROM ({LAST}) ORDER BY v, run_id LIMIT 1")
def best_run(spark, sf):
    return runs.best_run(run_table(spark, sf)).select("experiment", "run_id", r6("value"))


@query("run_comparison", f"SELECT run_id, round(v, 6) AS train_loss, round(v, 6) AS f1_macro FROM ({LAST})")
def run_comparison(spark, sf):
    return runs.compare_runs(run_table(spark, sf), ["train_loss", "f1_macro"]).select("run_id", r6("train_loss"), r6("f1_macro"))


@query("backfilled_labels", """SELECT DISTINCT event_type AS run_id, CASE event_type WHEN 'view' THEN 'static' ELSE 'adaptive' END AS mode
  FROM events WHERE event_type IN ('view', 'error')""")
def backfilled_labels(spark, sf):
    full = runs.backfill_tag(run_table(spark, sf), "mode", {"run-view": "static", "run-error": "adaptive"})
    return full.where("key = 'mode'").select("run_id", F.col("value").alias("mode"))


@query("batch_gauges", f"""WITH b AS (SELECT CAST(batch AS BIGINT) AS batch, CAST(count(*) AS DOUBLE) AS n, avg(CAST(label = 0 AS DOUBLE)) AS normal,
  CAST(max(label) AS DOUBLE) AS top FROM ({VECTORS}) GROUP BY batch)
  SELECT 'batch_samples' AS name, batch, n AS value FROM b UNION ALL SELECT 'normal_share', batch, round(normal, 6) FROM b UNION ALL SELECT 'top_label', batch, top FROM b""")
def batch_gauges(spark, sf):
    path = scratch(spark, "gauges")
    per_batch = vectors(spark, sf).groupBy("batch").agg(
        F.count("*").alias("batch_samples"), F.avg((F.col("label") == 0).cast("double")).alias("normal_share"), F.max("label").alias("top_label")
    )
    for row in per_batch.orderBy("batch").collect():  # ten batches
        runs.append_gauges(spark, path, row["batch"], {k: row[k] for k in ("batch_samples", "normal_share", "top_label")})
    return spark.read.schema(runs.METRIC_SCHEMA).parquet(path).select("name", "batch", r6("value"))


@query("saved_model")
def saved_model(spark, sf):
    v = vectors(spark, sf)
    path = scratch(spark, "forest")
    writers.save_model(adapt.fit_forest(v, ids=["vec_id"]), path)
    scored = adapt.predict(Forest.load(path), v)
    return scored.groupBy("pred").agg(F.count("*").alias("n"))
