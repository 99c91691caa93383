"""Scalers, PCA, samples, drift measures, models and adaptation strategies."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftloom.catalog.inputs import (
    EARLY, EV_CUT, EVENTS, LATE, MEASURES, early_late, events, halves, measures, query, r6, scratch, vectors,
)
from driftloom.catalog.shape import SPECS, windowed
from driftloom.functions.names import q
from driftloom.operators import adapt, drift, sampling, scaling
from driftloom.operators.moments import (
    ARR, as_features, ensemble_vote, fit_members, fit_pca, label_scores, moments, residual_mse, score_rows, weighted_score,
)
from driftloom.plans import jobs
from driftloom.sinks import runs

KEY = ("l_orderkey", "l_linenumber")


def scaled_sql(centre: str, scale: str, wrap: str = "{}") -> str:
    """Every measure scaled with numbers of the early half, summed per order."""
    fits = ", ".join(f"{centre.format(c=c)} AS m_{c}, {scale.format(c=c)} AS s_{c}" for c in MEASURES)
    outs = ", ".join("round(sum(" + wrap.format(f"({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)") + f"), 6) AS {c}" for c in MEASURES)
    return f"WITH f AS (SELECT {fits} FROM ({EARLY})) SELECT l_orderkey, {outs} FROM lineitem, f GROUP BY l_orderkey"


def per_order(df):
    return df.groupBy("l_orderkey").agg(*[r6(F.sum(c), c) for c in MEASURES])


@query("standard_scaled", scaled_sql("avg({c})", "stddev_pop({c})"))
def standard_scaled(spark, sf):
    ref, _ = early_late(spark, sf)
    return per_order(scaling.fit_standard(ref, MEASURES).apply(measures(spark, sf)))


@query("sigmoid_scaled", scaled_sql("avg({c})", "stddev_pop({c})", "1 / (1 + exp(-({})))"))
def sigmoid_scaled(spark, sf):
    ref, _ = early_late(spark, sf)
    return per_order(scaling.fit_standard(ref, MEASURES).apply(measures(spark, sf), squash=True))


@query("min_max_scaled", scaled_sql("min({c})", "max({c}) - min({c})"))
def min_max_scaled(spark, sf):
    ref, _ = early_late(spark, sf)
    return per_order(scaling.fit_min_max(ref, MEASURES).apply(measures(spark, sf)))


@query("robust_scaled", scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def robust_scaled(spark, sf):
    ref, _ = early_late(spark, sf)
    return per_order(scaling.fit_robust(ref, MEASURES).apply(measures(spark, sf)))


@query("robust_scaled_vector")
def robust_scaled_vector(spark, sf):
    names = [s[0] for s in SPECS]
    _, scaled = scaling.robust_scale_vector(scaling.assemble(windowed(spark, sf), names))
    flat = scaling.spread_vector(scaled.select(F.col("window.start").alias("window_start"), "CELL", "N_CELL", "scaled_features"), "scaled_features", names)
    return flat.drop("scaled_features").select("window_start", "CELL", "N_CELL", *[r6(n) for n in names])


@query("constant_columns_dropped", "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS kept, (SELECT count(*) FROM lineitem) AS n")
def constant_columns_dropped(spark, sf):
    m = measures(spark, sf).withColumn("constant", F.lit(7.0))
    names = ["l_quantity", "constant", *MEASURES[1:]]
    frame, kept = scaling.drop_constant(scaling.assemble(m, names, "scaled_features"), names)
    rows = frame.select(F.size(vector_to_array("vt_features")).alias("width")).where(F.col("width") == len(kept))
    return rows.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(k) for k in kept])).alias("kept"), "n")


@query("pca_projection")
def pca_projection(spark, sf):
    names = [s[0] for s in SPECS]
    frame, kept, shares, _ = jobs.selection_job(
        scaling.robust_scale_vector(scaling.assemble(windowed(spark, sf), names))[1], names, 2
    )
    out = frame.select(F.col("window.start").alias("window_start"), "CELL", "N_CELL", vector_to_array("pca_features").alias("p"))
    return out.select("window_start", "CELL", "N_CELL", r6(F.abs(F.col("p")[0]), "pc1"), r6(F.abs(F.col("p")[1]), "pc2"))


@query("residual_errors")
def residual_errors(spark, sf):
    ref, cur = early_late(spark, sf)
    r, c = moments(as_features(ref, MEASURES)), moments(as_features(cur, MEASURES))
    pca = fit_pca(r, 2)
    scored = score_rows(as_features(cur, MEASURES), {"error": pca})
    return scored.agg(r6(F.avg("error"), "mean_row_error")).withColumn("moment_error", F.round(F.lit(residual_mse(c, pca)), 6))


@query("scored_rows")
def scored_rows(spark, sf):
    v = vectors(spark, sf)
    m = moments(v)
    two = score_rows(v, {"e1": fit_pca(m, 8), "e2": fit_pca(m, 0.9)})
    scored = label_scores(weighted_score(two, "e1", "e2", out="anomaly_score"), 0.6)
    return scored.select("vec_id", r6("anomaly_score"), "prediction", "label_text")


@query("ensemble_votes")
def ensemble_votes(spark, sf):
    v = vectors(spark, sf)
    models = {f"m{i}": p for i, p in enumerate(fit_members(v, ["vec_id"], 10, target=8))}
    scored = score_rows(v, models)
    thr = scored.agg(*[(F.avg(m) + F.stddev_pop(m)).alias(m) for m in models]).first()
    out = ensemble_vote(scored, list(models), [thr[m] for m in models])
    return out.select("vec_id", r6("score"), "pred")


@query("linear_regression", """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
  regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem)
  SELECT round(sqrt(avg((l_extendedprice - a - b * l_quantity) * (l_extendedprice - a - b * l_quantity))), 4) AS rmse, round(max(r2), 6) AS r2 FROM lineitem, s""")
def linear_regression(spark, sf):
    _, got = adapt.linear_fit(measures(spark, sf).select("l_quantity", "l_extendedprice"))
    out = spark.createDataFrame([(got["rmse"], got["r2"])], "rmse double, r2 double")
    return out.select(F.round("rmse", 4).alias("rmse"), r6("r2"))


@query("train_test_split", """SELECT count(*) AS n, count(DISTINCT event_id) AS ids, CAST(0 AS BIGINT) AS in_both, CAST(80 AS BIGINT) AS train_percent FROM events""")
def train_test_split(spark, sf):
    s = sampling.train_test(events(spark, sf), ["event_id"])
    train, test = s.where("is_train"), s.where(~F.col("is_train"))
    in_both = train.join(test.select("event_id"), "event_id", "left_semi").count()
    both = train.unionByName(test)
    # the share of a split by hash is near 80 %, here to the nearest five
    percent = F.round(F.avg(F.col("is_train").cast("double")) * 20) * 5
    return both.agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.lit(in_both).cast("long").alias("in_both"), percent.cast("long").alias("train_percent")
    )


@query("stratified_folds", f"""WITH c AS (SELECT label, count(*) AS n FROM ({EVENTS}) GROUP BY label)
  SELECT label, CAST(f AS INTEGER) AS fold, n // 5 + CAST(f < n % 5 AS INTEGER) AS n FROM c, range(5) r(f)""")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(events(spark, sf), ["event_id"]).groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("rebalanced", f"""WITH c AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM ({EVENTS}))
  SELECT 0 AS label, n0 AS n, n0 AS ids, (SELECT round(sum(value), 4) FROM (%s) WHERE label = 0) AS normal_sum FROM c
  UNION ALL SELECT 1, least(greatest(1, CAST(floor(n0 * 0.01 / 0.99) AS BIGINT)), n1), least(greatest(1, CAST(floor(n0 * 0.01 / 0.99) AS BIGINT)), n1), NULL FROM c""" % EVENTS)
def rebalanced(spark, sf):
    out = sampling.rebalance(events(spark, sf), ["event_id"], 0.01)
    return out.groupBy("label").agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.round(F.sum(F.when(F.col("label") == 0, F.col("value"))), 4).alias("normal_sum")
    )


@query("permuted_cells", f"""WITH c AS ({" UNION ALL ".join(f"SELECT {c} AS v FROM lineitem" for c in MEASURES)}), n AS (SELECT count(*) AS n FROM c)
  SELECT count(*) AS cells, CAST(floor(max(n) * 0.31) AS BIGINT) AS chosen, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS cents, round(sum(v * v) / 1000000000, 4) AS squares,
  true AS most_moved, CAST(0 AS BIGINT) AS others_moved FROM c, n""")
def permuted_cells(spark, sf):
    p = sampling.permute_cells(measures(spark, sf), KEY, MEASURES, 0.31)
    v = F.col("permuted")
    return p.agg(
        F.count("*").alias("cells"), F.count(F.when(F.col("chosen"), 1)).alias("chosen"),
        F.sum(F.round(v * 100).cast("long")).alias("cents"), F.round(F.sum(v * v) / 1000000000, 4).alias("squares"),
        (F.count(F.when(F.col("chosen") & (v != F.col("value")), 1)) > 0.5 * F.count(F.when(F.col("chosen"), 1))).alias("most_moved"),
        F.count(F.when(~F.col("chosen") & (v != F.col("value")), 1)).alias("others_moved"),
    )


def injected_sql(kind: str, intensity: float) -> str:
    hit = sampling.affected_columns(MEASURES, intensity)
    shape = {"scale": "sign({c}) * pow(abs({c}), 1.0 / 3)", "shift": "{c} + 2 * (SELECT stddev_samp({c}) FROM lineitem)"}[kind]
    outs = ", ".join(f"round(avg({shape.format(c=c) if c in hit else c}), 6) AS {c}" for c in MEASURES)
    return f"SELECT l_linenumber, {outs} FROM lineitem GROUP BY l_linenumber"


def injected(spark, sf, kind: str, intensity: float):
    d = sampling.inject_drift(measures(spark, sf), MEASURES, KEY, kind, intensity)
    return d.groupBy("l_linenumber").agg(*[r6(F.avg(c), c) for c in MEASURES])


@query("injected_scale", injected_sql("scale", 0.6))
def injected_scale(spark, sf):
    return injected(spark, sf, "scale", 0.6)


@query("injected_shift", injected_sql("shift", 0.5))
def injected_shift(spark, sf):
    return injected(spark, sf, "shift", 0.5)


@query("injected_noise")
def injected_noise(spark, sf):
    return injected(spark, sf, "noise", 0.5)


@query("injected_deletion", """SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS ids,
  CAST(floor(count(*) * 0.8) AS BIGINT) AS unchanged FROM events""")
def injected_deletion(spark, sf):
    left = sampling.inject_drift(events(spark, sf), ["value"], ["event_id"], "missing", 0.2)
    same = left.join(events(spark, sf).select("event_id", F.col("value").alias("was")), "event_id", "left")
    return same.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.count(F.when(F.col("value").eqNullSafe(F.col("was")), 1)).alias("unchanged"))


@query("damped_segments", """WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
  SELECT event_id, round(CASE WHEN (i >= n // 3 AND i < least(n // 3 + n // 6, n)) OR (i >= 2 * n // 3 AND i < least(2 * n // 3 + n // 6, n))
  THEN value * 0.1 ELSE value END, 6) AS value FROM e""")
def damped_segments(spark, sf):
    return sampling.damp_segments(events(spark, sf), ["ts", "event_id"], ["value"]).select("event_id", r6("value"))


TWO = f"SELECT value AS v, CAST(ts < TIMESTAMP '{EV_CUT}' AS INTEGER) AS r, event_type FROM events"
KS_TERMS = "list_sum([CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam) FOR k IN range(1, 101)])"


@query("ks_two_sample", f"""WITH v AS (SELECT event_type, v, sum(r) AS r, sum(1 - r) AS c FROM ({TWO}) GROUP BY ALL),
  f AS (SELECT event_type, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER p AS nr, sum(c) OVER p AS nc FROM v
    WINDOW w AS (PARTITION BY event_type ORDER BY v), p AS (PARTITION BY event_type)),
  s AS (SELECT event_type, max(abs(cr / nr - cc / nc)) AS ks, max(nr) AS n_ref, max(nc) AS n_cur FROM f GROUP BY event_type),
  l AS (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * ks AS lam FROM s),
  m AS (SELECT event_type, avg(v) FILTER (r = 1) AS ref_mean, stddev_pop(v) FILTER (r = 1) AS ref_std, avg(v) FILTER (r = 0) AS cur_mean,
    stddev_pop(v) FILTER (r = 0) AS cur_std FROM ({TWO}) GROUP BY event_type),
  p AS (SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * {KS_TERMS})) END AS p_value FROM l)
  SELECT event_type, round(ks, 6) AS ks, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, round(ref_mean, 6) AS ref_mean, round(ref_std, 6) AS ref_std,
  round(cur_mean, 6) AS cur_mean, round(cur_std, 6) AS cur_std, round(p_value, 6) AS p_value, CAST(p_value < 0.05 AS INTEGER) AS drift FROM p JOIN m USING (event_type)""")
def ks_two_sample(spark, sf):
    early, late = halves(spark, sf)
    k = drift.ks_two_sample(early, late, "value", ["event_type"])
    return k.select("event_type", "n_ref", "n_cur", "drift", *[r6(c) for c in ("ks", "ref_mean", "ref_std", "cur_mean", "cur_std", "p_value")])


PSI = """e AS (SELECT quantile_cont({c}, [i / 10.0 FOR i IN range(1, 10)]) AS q FROM ({ref})),
  b AS (SELECT len(list_filter(q, lambda x: x <= v)) AS bin, r FROM (SELECT {c} AS v, 1 AS r FROM ({ref}) UNION ALL SELECT {c}, 0 FROM ({cur})), e),
  n AS (SELECT bin, sum(r) AS r, sum(1 - r) AS c FROM b GROUP BY bin),
  s AS (SELECT bin, greatest(r / sum(r) OVER (), 1e-6) AS e, greatest(c / sum(c) OVER (), 1e-6) AS a FROM n)"""


@query("psi_bins", "WITH " + PSI.format(c="l_extendedprice", ref=EARLY, cur=LATE) + """ SELECT CAST(bin AS INTEGER) AS bin, round(e, 6) AS ref_share,
  round(a, 6) AS cur_share, round((a - e) * ln(a / e), 6) AS term FROM s""")
def psi_bins(spark, sf):
    ref, cur = early_late(spark, sf)
    return drift.psi_bins(ref, cur, "l_extendedprice").select("bin", r6("ref_share"), r6("cur_share"), r6("term"))


@query("psi", "WITH " + PSI.format(c="value", ref=f"SELECT value FROM events WHERE ts < TIMESTAMP '{EV_CUT}'",
                                  cur=f"SELECT value * 1.5 AS value FROM events WHERE ts >= TIMESTAMP '{EV_CUT}'") +
       """, t AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM s) SELECT round(psi, 6) AS psi,
       CASE WHEN psi > 0.2 THEN 'strong' WHEN psi > 0.1 THEN 'medium' ELSE 'slight' END AS band FROM t""")
def psi(spark, sf):
    early, late = halves(spark, sf)
    return drift.psi(early, late.withColumn("value", F.col("value") * 1.5), "value").select(r6("psi"), "band")


@query("rank_sum_test", f"""WITH r AS (SELECT event_type, r, rank() OVER (PARTITION BY event_type ORDER BY v)
    + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0 AS rk FROM ({TWO})),
  s AS (SELECT event_type, sum(rk) FILTER (r = 1) AS rs, CAST(sum(r) AS DOUBLE) AS n_ref, CAST(sum(1 - r) AS DOUBLE) AS n_cur FROM r GROUP BY event_type),
  u AS (SELECT *, least(rs - n_ref * (n_ref + 1) / 2, n_ref * n_cur - rs + n_ref * (n_ref + 1) / 2) AS u FROM s),
  z AS (SELECT *, (u - n_ref * n_cur / 2) / sqrt(n_ref * n_cur * (n_ref + n_cur + 1) / 12) AS z FROM u)
  SELECT event_type, n_ref, n_cur, u, round(z, 6) AS z,
  CASE WHEN z < -3.2905267314918945 THEN 'alarm' WHEN z < -2.5758293035489004 THEN 'warn' ELSE 'normal' END AS verdict FROM z""")
def rank_sum_test(spark, sf):
    early, late = halves(spark, sf)
    return drift.mann_whitney(early, late, "value", ["event_type"]).select("event_type", "n_ref", "n_cur", "u", r6("z"), "verdict")


PAIR = ("l_quantity", "l_extendedprice")
PAIR_MOMENTS = f"""WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, stddev_pop(l_quantity) AS sa, stddev_pop(l_extendedprice) AS sb,
  corr(l_quantity, l_extendedprice) AS r FROM ({EARLY}))"""


@query("permutation_errors", PAIR_MOMENTS + """ SELECT CAST(1 + 10 * i AS INTEGER) AS percent,
  round((1 - abs(r)) / 2 + (1 + 10 * i) / 100.0 + power((1 + 10 * i) / 100.0, 2) * abs(r) / 2, 6) AS mse FROM m, range(10) AS t(i)""")
def permutation_errors(spark, sf):
    ref, _ = early_late(spark, sf)
    m = moments(as_features(ref, PAIR))
    rows = drift.permutation_errors(m, fit_pca(m, 1))
    return spark.createDataFrame([(round(p), e) for p, e in rows], "percent int, mse double").select("percent", r6("mse"))


@query("pair_drift", PAIR_MOMENTS + f""", z AS (SELECT (l_quantity - ma) / sa AS a, (l_extendedprice - mb) / sb AS b, sign(r) AS s FROM ({LATE}), m),
  t AS (SELECT atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) / 2 AS angle, any_value(s) AS s, avg(power(a - s * b, 2)) / 4 AS mse FROM z)
  SELECT round(100 * (1 - abs(cos(angle - s * pi() / 4))), 6) AS dp, round(mse, 6) AS mse FROM t""")
def pair_drift(spark, sf):
    """Drift of two columns, for which the components have a closed form."""
    ref, cur = early_late(spark, sf)
    got = drift.DriftModel.fit(as_features(ref, PAIR), target=1, calibrate=False).score(as_features(cur, PAIR))
    return spark.createDataFrame([(got["dP"], got["mse"])], "dp double, mse double").select(r6("dp"), r6("mse"))


@query("pca_drift")
def pca_drift(spark, sf):
    ref, cur = early_late(spark, sf)
    rep = jobs.drift_report(ref, cur, MEASURES)
    return rep.select("metric", r6("value"), "band", "advice")


@query("pca_drift_over_time")
def pca_drift_over_time(spark, sf):
    ref, cur = early_late(spark, sf)
    months = cur.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    rep = jobs.drift_report(ref, months, MEASURES, by="month")
    return rep.select("month", "n", "metric", r6("value"), "band", "advice")


@query("drift_history")
def drift_history(spark, sf):
    ref, cur = early_late(spark, sf)
    months = cur.withColumn("month", F.date_format("l_shipdate", "yyyyMM").cast("long"))
    rep = jobs.drift_report(ref, months, MEASURES, by="month")
    path = scratch(spark, "history")
    runs.append_metrics(rep, path, "monthly", "drift", step="month")
    back = runs.read_runs(spark, path)
    return back.select("experiment", "run_id", "key", "step", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("drift_scenarios")
def drift_scenarios(spark, sf):
    v = vectors(spark, sf)
    cols = [f"f{i}" for i in range(64)]
    wide = v.select("vec_id", *[q(ARR)[i].alias(c) for i, c in enumerate(cols)])
    model = drift.DriftModel.fit(as_features(wide, cols))
    s = drift.scenario_matrix(wide, ["vec_id"], cols, model)
    return s.select("scenario", *[r6(c) for c in ("dP", "dE_PCA", "mse")])


@query("reconstruction_alarm")
def reconstruction_alarm(spark, sf):
    ref, cur = early_late(spark, sf)
    moved = sampling.inject_drift(cur, MEASURES, KEY, "shift", 0.5)
    got = drift.reconstruction_alarm(as_features(ref, MEASURES), as_features(moved, MEASURES), 2)
    schema = "ref_mse double, cur_mse double, alarm boolean, adapted_mse double"
    return spark.createDataFrame([tuple(got.values())], schema).select(r6("ref_mse"), r6("cur_mse"), "alarm", r6("adapted_mse"))


def micro_batches(spark, sf):
    """Moments of the first batch, and the rows of all others in micro-batches of ten."""
    v = vectors(spark, sf)
    base = moments(v.where(F.col("batch") == 0))
    return base, v.where(F.col("batch") > 0).withColumn("micro", F.floor(F.col("vec_id") / 10))


@query("micro_batch_adaptation")
def micro_batch_adaptation(spark, sf):
    base, live = micro_batches(spark, sf)
    out = adapt.adaptation_losses(live, base, 8, batch="micro")
    return out.select("micro", "n", r6("loss_before"), r6("loss_after"))


@query("carried_adaptation")
def carried_adaptation(spark, sf):
    base, live = micro_batches(spark, sf)
    out = adapt.adaptation_losses(live, base, 8, batch="micro", carry=True)
    return out.select("micro", "n", r6("loss_before"), r6("loss_after"))


@query("adaptation_strategies")
def adaptation_strategies(spark, sf):
    return adapt.strategies(vectors(spark, sf), ["vec_id"])


@query("cross_validation")
def cross_validation(spark, sf):
    acc = adapt.cross_validate(vectors(spark, sf), ["vec_id"])
    return spark.createDataFrame([(acc,)], "accuracy double")


@query("importance_change")
def importance_change(spark, sf):
    v = vectors(spark, sf)
    old = adapt.fit_forest(v.where(F.col("batch") < 5), ids=["vec_id"])
    new = adapt.fit_forest(v.where(F.col("batch") >= 5), ids=["vec_id"])
    return adapt.importance_change(spark, old, new)
