"""Profiles, class counts, metrics, ranks, quantiles, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.inputs import (
    EARLY, EVENTS, LATE, MEASURES, VECTORS, early_late, events, measures, query, r6, table, vectors,
)
from driftloom.operators import metrics, profile, ranks, threshold
from driftloom.operators.moments import covariance_frame
from driftloom.session import settle

CUT = 40.0
# Events with a prediction, and the day as the batch.
PRED = f"""SELECT *, CAST(score >= {CUT} AS INTEGER) AS pred, CAST(ts AS DATE) AS day FROM ({EVENTS})"""


def predicted(spark, sf):
    return events(spark, sf).withColumns({"pred": (F.col("score") >= CUT).cast("int"), "day": F.to_date("ts")})


def unpivoted(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM ({source})" for c in MEASURES)


PROFILE = f"""SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM ({unpivoted('SELECT * FROM lineitem')}) GROUP BY feature"""
STATS = ("mean", "std", "median", "q1", "q3")


@query("column_profile", "SELECT feature, " + ", ".join(f"round({c}, 6) AS {c}" for c in STATS) + f" FROM ({PROFILE})")
def column_profile(spark, sf):
    return profile.column_profile(measures(spark, sf), MEASURES).select("feature", *[r6(c) for c in STATS])


@query("overall_profile", "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in STATS) + f", round(avg(q3) - avg(q1), 6) AS iqr FROM ({PROFILE})")
def overall_profile(spark, sf):
    return profile.overall_profile(measures(spark, sf), MEASURES).select(*[r6(c) for c in (*STATS, "iqr")])


@query("class_counts", f"SELECT batch, " + ", ".join(f"count(*) FILTER (label = {c}) AS class_{c}" for c in range(10)) + f" FROM ({VECTORS}) GROUP BY batch")
def class_counts(spark, sf):
    return profile.class_counts(vectors(spark, sf), range(10))


@query("class_shares", f"""SELECT batch, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY batch), 6) AS share
  FROM ({VECTORS}) GROUP BY batch, label""")
def class_shares(spark, sf):
    return profile.class_shares(vectors(spark, sf)).select("batch", "label", "n", r6("share"))


@query("label_kinds", f"""SELECT batch, count(DISTINCT label) AS n_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
  count(DISTINCT label) = 2 AS is_binary FROM ({VECTORS}) GROUP BY batch""")
def label_kinds(spark, sf):
    k = profile.label_kinds(vectors(spark, sf))
    return k.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query("correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in MEASURES for b in MEASURES))
def correlations(spark, sf):
    return profile.correlations(measures(spark, sf), MEASURES).select("a", "b", r6("r"))


@query("moment_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 4) AS cov, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in MEASURES for b in MEASURES))
def moment_matrix(spark, sf):
    c = covariance_frame(measures(spark, sf), MEASURES)
    return c.select("a", "b", F.round("cov", 4).alias("cov"), r6("corr"))


@query("confusion", f"SELECT label, pred, count(*) AS n FROM ({PRED}) GROUP BY ALL")
def confusion(spark, sf):
    return metrics.confusion(predicted(spark, sf))


@query("binary_confusion", f"""SELECT day, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM ({PRED}) GROUP BY day""")
def binary_confusion(spark, sf):
    return metrics.binary_counts(predicted(spark, sf), ["day"])


@query("accuracy_per_batch", f"""SELECT day, round(avg(CAST(label = pred AS DOUBLE)), 6) AS accuracy,
  round(1 - avg(CAST(label = pred AS DOUBLE)), 6) AS error_rate FROM ({PRED}) GROUP BY day""")
def accuracy_per_batch(spark, sf):
    return metrics.accuracy(predicted(spark, sf), ["day"]).select("day", r6("accuracy"), r6("error_rate"))


# Multiclass prediction: the class of a vector is guessed from its largest leading component.
GUESS = f"""SELECT *, CAST(CASE WHEN features[1] > 0.1 THEN 3 WHEN features[2] > 0.1 THEN 5 ELSE 11 END AS INTEGER) AS pred FROM ({VECTORS})"""
PER_CLASS = f"""WITH g AS ({GUESS}), n AS (SELECT batch, label, pred, count(*) AS n FROM g GROUP BY ALL),
  k AS (SELECT batch, label AS cls FROM n UNION SELECT batch, pred FROM n),
  s AS (SELECT k.batch, k.cls, coalesce(sum(n.n) FILTER (n.label = k.cls AND n.pred = k.cls), 0) AS tp,
    coalesce(sum(n.n) FILTER (n.label = k.cls), 0) AS sup, coalesce(sum(n.n) FILTER (n.pred = k.cls), 0) AS cho
    FROM k JOIN n USING (batch) GROUP BY ALL),
  c AS (SELECT batch, cls, sup, CASE WHEN cho > 0 THEN tp / cho ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r,
    CASE WHEN sup + cho > 0 THEN 2 * tp / (sup + cho) ELSE 0 END AS f FROM s)"""


@query("macro_scores", f"""{PER_CLASS} SELECT batch, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro,
  round(avg(f), 6) AS f1_macro, round(sum(f * sup) / sum(sup), 6) AS f1_weighted FROM c GROUP BY batch""")
def macro_scores(spark, sf):
    f = F.col("features")
    g = vectors(spark, sf).withColumn("pred", F.when(f[0] > 0.1, 3).when(f[1] > 0.1, 5).otherwise(11))
    m = metrics.macro_scores(g, ["batch"])
    return m.select("batch", *[r6(c) for c in ("precision_macro", "recall_macro", "f1_macro", "f1_weighted")])


@query("positive_scores", f"""WITH c AS (SELECT day, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM ({PRED}) GROUP BY day)
  SELECT day, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS false_alarm_rate FROM c""")
def positive_scores(spark, sf):
    p = metrics.positive_scores(predicted(spark, sf), ["day"])
    return p.select("day", *[r6(c) for c in ("precision", "recall", "f1", "false_alarm_rate")])


AUC = """WITH r AS (SELECT {g} AS g, label, rank() OVER (PARTITION BY {g} ORDER BY score)
    + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0 AS rk FROM ({src})),
  s AS (SELECT g, sum(rk) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY g)"""


@query("roc_auc", AUC.format(g="1", src=EVENTS) + " SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc FROM s")
def roc_auc(spark, sf):
    return metrics.roc_auc(events(spark, sf)).select(r6("roc_auc"))


@query("roc_auc_per_batch", AUC.format(g="day", src=PRED) + " SELECT g AS day, round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc FROM s")
def roc_auc_per_batch(spark, sf):
    return metrics.roc_auc(predicted(spark, sf), ["day"]).select("day", r6("roc_auc"))


CURVE = f"""WITH v AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM ({EVENTS}) GROUP BY score),
  c AS (SELECT score, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM v WINDOW w AS (ORDER BY score DESC))"""


@query("average_precision", CURVE + " SELECT round(sum(pos * (tp / (tp + fp))) / max(p), 6) AS average_precision FROM c")
def average_precision(spark, sf):
    return metrics.average_precision(events(spark, sf)).select(r6("average_precision"))


@query("pr_curve", CURVE + " SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM c")
def pr_curve(spark, sf):
    return metrics.pr_curve(events(spark, sf)).select("threshold", r6("precision"), r6("recall"))


@query("score_histogram", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS t FROM events)
  SELECT CAST(least(floor((value - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS n,
  round(count(*) / (max(t) * (max(hi) - max(lo)) / 50), 6) AS density FROM events, e GROUP BY bin""")
def score_histogram(spark, sf):
    return profile.histogram(events(spark, sf), "value", 50).select("bin", "n", r6("density"))


@query("score_histogram_by_label", f"""WITH e AS (SELECT label, min(value) AS lo, max(value) AS hi, count(*) AS t FROM ({EVENTS}) GROUP BY label)
  SELECT label, CAST(least(floor((value - lo) * 60 / (hi - lo)), 59) AS INTEGER) AS bin, count(*) AS n,
  round(count(*) / (max(t) * (max(hi) - max(lo)) / 60), 6) AS density FROM ({EVENTS}) JOIN e USING (label) GROUP BY label, bin""")
def score_histogram_by_label(spark, sf):
    return profile.histogram(events(spark, sf), "value", 60, "label").select("label", "bin", "n", r6("density"))


@query("change_report", f"""WITH r AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS s FROM ({unpivoted(EARLY)}) GROUP BY feature),
  c AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS s FROM ({unpivoted(LATE)}) GROUP BY feature)
  SELECT feature, round(r.m, 6) AS ref_mean, round(c.m, 6) AS cur_mean, round(r.s, 6) AS ref_std, round(c.s, 6) AS cur_std,
  round((c.m - r.m) / r.m * 100, 6) AS mean_change, round((c.s - r.s) / r.s * 100, 6) AS std_change,
  CAST(abs((c.m - r.m) / r.m * 100) > 10 AS INTEGER) AS flagged FROM r JOIN c USING (feature)""")
def change_report(spark, sf):
    ref, cur = early_late(spark, sf)
    cols = ("ref_mean", "cur_mean", "ref_std", "cur_std", "mean_change", "std_change")
    return profile.change_report(ref, cur, MEASURES).select("feature", *[r6(c) for c in cols], "flagged")


@query("batch_anomaly_rate", f"""SELECT batch, round(avg(pred), 6) AS anomaly_rate, count(*) AS n,
  CAST(sum(count(*)) OVER (ORDER BY batch) AS BIGINT) AS processed FROM (SELECT pred, CAST(extract(day FROM ts) AS INTEGER) AS batch FROM ({PRED})) GROUP BY batch""")
def batch_anomaly_rate(spark, sf):
    p = predicted(spark, sf).withColumn("batch", F.dayofmonth("ts"))
    return profile.batch_anomaly_rate(p).select("batch", r6("anomaly_rate"), "n", "processed")


# Strategy results: one strategy per event type, its daily mean measurement as the accuracy.
NAMES = {"click": "static", "view": "drift", "error": "window", "signup": "cumulative", "purchase": "other"}
RESULTS = "SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + \
    " END AS strategy, CAST(extract(day FROM ts) AS INTEGER) AS batch, avg(value) / 100 AS accuracy FROM events GROUP BY ALL"


def results(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    e = events(spark, sf).withColumn("strategy", F.element_at(names, F.col("event_type")))
    return e.groupBy("strategy", F.dayofmonth("ts").alias("batch")).agg((F.avg("value") / 100).alias("accuracy"))


@query("strategy_means", f"SELECT strategy, round(avg(accuracy), 6) AS mean_accuracy FROM ({RESULTS}) GROUP BY strategy")
def strategy_means(spark, sf):
    return metrics.strategy_means(results(spark, sf)).select("strategy", r6("mean_accuracy"))


@query("strategy_gain", f"""WITH r AS ({RESULTS}), e AS (SELECT strategy, arg_min(accuracy, batch) AS f, arg_max(accuracy, batch) AS l FROM r GROUP BY strategy)
  SELECT round(max(f) FILTER (strategy = 'static') - max(l) FILTER (strategy = 'static'), 6) AS static_loss,
  round(max(l) FILTER (strategy = 'drift') - max(l) FILTER (strategy = 'static'), 6) AS adaptive_gain FROM e""")
def strategy_gain(spark, sf):
    return metrics.strategy_gain(results(spark, sf)).select(r6("static_loss"), r6("adaptive_gain"))


@query("score_quantiles", """SELECT DISTINCT round(unnest(quantile_cont(value, [0.5 + i * 0.499 / 399 FOR i IN range(400)])), 6) AS candidate FROM events""")
def score_quantiles(spark, sf):
    rows = [(v,) for v in threshold.candidates(events(spark, sf))]
    return spark.createDataFrame(rows, "candidate double").select(r6("candidate")).distinct()


@query("row_errors", f"""WITH v AS ({VECTORS}), c AS (SELECT vec_id, unnest(features) AS a, unnest(list_reverse(features)) AS b FROM v)
  SELECT vec_id, round(avg((a - b) * (a - b)), 6) AS error FROM c GROUP BY vec_id""")
def row_errors(spark, sf):
    v = vectors(spark, sf).withColumn("other", F.reverse("features"))
    return profile.reconstruction_error(v, "features", "other").select("vec_id", r6("error"))


@query("mean_error", f"""WITH v AS ({VECTORS}), c AS (SELECT unnest(features) AS a, unnest(list_reverse(features)) AS b FROM v)
  SELECT round(avg((a - b) * (a - b)), 6) AS mean_error FROM c""")
def mean_error(spark, sf):
    v = vectors(spark, sf).withColumn("other", F.reverse("features"))
    return profile.reconstruction_error(v, "features", "other").agg(r6(F.avg("error"), "mean_error"))


@query("global_rank", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS rn_total FROM events")
def global_rank(spark, sf):
    return ranks.ranked(events(spark, sf).select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query("average_rank", """SELECT event_id, event_type, rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS avg_rank
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def average_rank(spark, sf):
    return ranks.average_rank(events(spark, sf).select("event_id", "event_type", "value"), "value", ["event_type"]).drop("value")


HALVES = f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor((SELECT count(*) FROM events) / 2)
  THEN 'calibration' ELSE 'evaluation' END AS part FROM ({EVENTS})"""
ORDER = ["ts", "event_id"]


@query("half_split", f"SELECT event_id, part FROM ({HALVES})")
def half_split(spark, sf):
    return ranks.half_split(events(spark, sf).select("event_id", "ts"), ORDER).select("event_id", "part")


@query("stream_batches", """SELECT CAST(floor((rn - 1) / 500) AS BIGINT) AS batch, count(*) AS n, round(avg(value), 6) AS mean
  FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) GROUP BY batch""")
def stream_batches(spark, sf):
    b = ranks.cut_batches(events(spark, sf).select("event_id", "ts", "value"), ORDER, 500)
    return b.groupBy("batch").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))


@query("periodic_rows", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
  WHERE rn % 200 = 0""")
def periodic_rows(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "event_type")
    return ranks.every_nth(e, ORDER, 200, ["event_type"], start=1).select("event_id")


@query("mean_std_threshold", "SELECT event_type, round(avg(value) + stddev_pop(value), 6) AS theta FROM events GROUP BY event_type")
def mean_std_threshold(spark, sf):
    return threshold.mean_std_threshold(events(spark, sf), by=["event_type"]).select("event_type", r6("threshold", "theta"))


@query("mean_k_std_threshold", "SELECT round(avg(value) + 1.7872 * stddev_pop(value), 6) AS theta FROM events")
def mean_k_std_threshold(spark, sf):
    return threshold.mean_std_threshold(events(spark, sf), k=1.7872).select(r6("threshold", "theta"))


@query("q95_threshold", "SELECT round(quantile_cont(value, 0.95), 6) AS theta FROM events")
def q95_threshold(spark, sf):
    return spark.createDataFrame([(threshold.quantile_threshold(events(spark, sf)),)], "theta double").select(r6("theta"))


def sweep_sql(grid: str, source: str) -> str:
    """Counts and macro F1 of every threshold t of a grid over a source with (score, label)."""
    return f"""g AS ({grid}), s AS (SELECT t, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp,
    count(*) FILTER (label = 1 AND score < t) AS fn, count(*) FILTER (label = 0 AND score < t) AS tn FROM g, ({source}) GROUP BY t),
  m AS (SELECT *, (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END
    + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END)
    / (CAST(tp + fp + fn > 0 AS INTEGER) + CAST(tn + fp + fn > 0 AS INTEGER)) AS f1 FROM s)"""


@query("threshold_sweep", "WITH e AS (SELECT min(value) AS lo, quantile_cont(value, 0.999) AS hi FROM events), " + sweep_sql(
    "SELECT lo + i * (hi - lo) / 299 AS t FROM e, range(300) r(i)", EVENTS) + " SELECT round(t, 4) AS threshold, round(f1, 6) AS f1_macro FROM m")
def threshold_sweep(spark, sf):
    e = events(spark, sf)
    s = metrics.threshold_sweep(e, threshold.sweep_points(e))
    return s.select(F.round("threshold", 4).alias("threshold"), r6("f1_macro"))


BEST = f"""WITH h AS ({HALVES}), """ + sweep_sql(
    "SELECT DISTINCT unnest(quantile_cont(score, [0.5 + i * 0.499 / 399 FOR i IN range(400)])) AS t FROM h WHERE part = 'calibration'",
    "SELECT * FROM h WHERE part = 'calibration'") + ", b AS (SELECT t, f1 FROM m ORDER BY round(f1, 12) DESC, t LIMIT 1)"


@query("best_f1_threshold", BEST + " SELECT round(t, 6) AS threshold, round(f1, 6) AS f1_macro FROM b")
def best_f1(spark, sf):
    parts = settle(ranks.half_split(events(spark, sf).select("event_id", "ts", "score", "label"), ORDER))
    got = threshold.best_f1_threshold(parts.where(F.col("part") == "calibration"))
    return spark.createDataFrame([got], "threshold double, f1_macro double").select(r6("threshold"), r6("f1_macro"))


@query("leak_free_report", BEST + """, x AS (SELECT 'before' AS mode, 60.0 AS t UNION ALL SELECT 'after', t FROM b),
  c AS (SELECT mode, t, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp,
    count(*) FILTER (label = 1 AND score < t) AS fn, count(*) FILTER (label = 0 AND score < t) AS tn
    FROM x, (SELECT * FROM h WHERE part = 'evaluation') GROUP BY mode, t)
  SELECT mode, round(t, 6) AS threshold, tp, fp, fn, tn,
  round((coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tn / nullif(tn + fn, 0), 0)) / 2, 6) AS precision_macro,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS recall_macro,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1_macro FROM c""")
def leak_free_report(spark, sf):
    rep = threshold.leak_free(events(spark, sf), ORDER, 60.0)
    return rep.select("mode", r6("threshold"), "tp", "fp", "fn", "tn", *[r6(c) for c in ("precision_macro", "recall_macro", "f1_macro")])


@query("order_value_quantiles", "SELECT round(unnest(quantile_cont(o_totalprice, [0.0, 0.01, 0.25, 0.5, 0.9, 1.0])), 6) AS value, unnest([0.0, 0.01, 0.25, 0.5, 0.9, 1.0]::DOUBLE[]) AS p FROM orders")
def order_value_quantiles(spark, sf):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = ranks.exact_quantiles(table(spark, sf, "orders"), ["o_totalprice"], probs)["o_totalprice"]
    return spark.createDataFrame(list(zip(probs, got)), "p double, value double").select("p", r6("value"))
