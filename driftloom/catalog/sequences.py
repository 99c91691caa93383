"""Ordered streams: sliding windows, moving means, faded counters, stateful detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.inputs import EV_CUT, EVENTS, events, halves, query, r6, r6_off_ties
from driftloom.functions.columns import flatten_window
from driftloom.operators import sequence, threshold
from driftloom.operators.metrics import mean_history
from driftloom.operators.moments import as_features, fit_members, score_rows
from driftloom.operators.sampling import init_sample
from driftloom.session import settle

ORDER = ["ts", "event_id"]
WS = 24
CUT = 40.0


def cells(spark, sf):
    return events(spark, sf).select(F.col("user_id").cast("string").alias("CELL"), F.col("ts").alias("DATETIME"), "event_id", "value", "k")


WINDOWS = f"""WITH e AS ({EVENTS}), w AS (SELECT CAST(user_id AS VARCHAR) AS CELL, date_trunc('second', ts) AS END_TIME, event_id,
    list(value) OVER o AS vs, list(k) OVER o AS ks, count(*) OVER o AS n FROM e
    WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {WS - 1} PRECEDING AND CURRENT ROW))"""


@query("sliding_windows", f"""{WINDOWS} SELECT CELL, END_TIME, event_id, vs[1] AS first_value, round(list_sum(vs), 6) AS sum_value,
  round(list_sum(ks), 6) AS sum_k, 2 * len(vs) AS cells, CAST(ks[1] AS DOUBLE) AS second_cell, vs[{WS}] AS next_to_last, CAST(ks[{WS}] AS DOUBLE) AS last_cell FROM w WHERE n = {WS}""")
def sliding_windows(spark, sf):
    w = sequence.sliding_windows(cells(spark, sf), ["value", "k"], WS, tie=["event_id"])
    flat = w.withColumn("flat", flatten_window(F.col("win")))

    def part(i):
        return F.aggregate("win", F.lit(0.0), lambda a, r: a + r[i])

    return flat.select(
        "CELL", "END_TIME", "event_id", F.col("win")[0][0].alias("first_value"), r6(part(0), "sum_value"),
        r6(part(1), "sum_k"), F.size("flat").cast("long").alias("cells"),
        F.col("flat")[1].cast("double").alias("second_cell"), F.col("flat")[2 * WS - 2].alias("next_to_last"), F.col("flat")[2 * WS - 1].cast("double").alias("last_cell"),
    )


@query("trailing_mean", f"""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS trailing_mean FROM events""")
def trailing_mean(spark, sf):
    return sequence.trailing_mean(events(spark, sf), "value", ORDER, ["event_type"]).select("event_id", r6_off_ties("trailing_mean"))


@query("centred_mean", """SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING) / 300, 6)
  AS centred_mean FROM events""")
def centred_mean(spark, sf):
    return sequence.centred_mean(events(spark, sf), "value", ORDER).select("event_id", r6("centred_mean"))


def faded_sql(by: str = "", fade: float = 0.99) -> str:
    """Closed form of the faded counters: weights fade^(later rows of the same class)."""
    p = f"PARTITION BY {by}" if by else ""

    def total(cls: int, hit: int) -> str:
        k = "kp" if cls else "kn"
        return f"pow({fade}, {k}) * sum(CASE WHEN label = {cls} AND pred = {hit} THEN pow({fade}, -{k}) ELSE 0 END) OVER w"

    return f"""WITH e AS (SELECT *, CAST(score >= {CUT} AS INTEGER) AS pred FROM ({EVENTS})),
  k AS (SELECT *, sum(label) OVER w AS kp, sum(1 - label) OVER w AS kn FROM e WINDOW w AS ({p} ORDER BY ts, event_id)),
  c AS (SELECT *, {total(1, 1)} AS tp, {total(1, 0)} AS fn, {total(0, 0)} AS tn, {total(0, 1)} AS fp FROM k
    WINDOW w AS ({p} ORDER BY ts, event_id)),
  s AS (SELECT *, tp / (tp + fn + 1e-9) AS recall, tn / (tn + fp + 1e-9) AS specificity FROM c)"""


def predicted(spark, sf):
    return events(spark, sf).withColumn("pred", (F.col("score") >= CUT).cast("int"))


@query("prequential_scores", faded_sql() + """ SELECT event_id, round(recall, 6) AS recall, round(specificity, 6) AS specificity,
  round(sqrt(recall * specificity), 6) AS gmean FROM s""")
def prequential_scores(spark, sf):
    p = sequence.prequential(predicted(spark, sf), ORDER)
    return p.select("event_id", r6("recall"), r6("specificity"), r6("gmean"))


@query("prequential_summary", faded_sql("user_id") + """ SELECT user_id, round(avg(recall), 6) AS recall, round(avg(specificity), 6) AS specificity,
  round(avg(sqrt(recall * specificity)), 6) AS gmean FROM s GROUP BY user_id""")
def prequential_summary(spark, sf):
    p = sequence.prequential(predicted(spark, sf), ORDER, ["user_id"])
    m = mean_history(p, ["recall", "specificity", "gmean"], ["user_id"])
    return m.select("user_id", *[r6(c) for c in ("recall", "specificity", "gmean")])


@query("prequential_auc", f"""WITH e AS (SELECT event_id, score, label, row_number() OVER (ORDER BY ts, event_id) AS t FROM ({EVENTS})),
  p AS (SELECT a.t AS t0, b.t AS t1, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END AS win
    FROM e a JOIN e b ON a.label = 1 AND b.label = 0 AND b.t BETWEEN a.t - 999 AND a.t + 999),
  d AS (SELECT greatest(t0, t1) AS t, sum(win) AS w FROM p GROUP BY 1 UNION ALL SELECT least(t0, t1) + 1000, -sum(win) FROM p GROUP BY 1),
  g AS (SELECT t, sum(w) AS w FROM d GROUP BY t),
  n AS (SELECT event_id, t, sum(label) OVER o AS np, sum(1 - label) OVER o AS nn FROM e WINDOW o AS (ORDER BY t ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(CASE WHEN np > 0 AND nn > 0 THEN sum(coalesce(w, 0)) OVER (ORDER BY n.t) / (np * nn) ELSE 0.5 END + 1e-9, 6) AS pauc
  FROM n LEFT JOIN g USING (t)""")
def prequential_auc(spark, sf):
    return sequence.prequential_auc(events(spark, sf), ORDER).select("event_id", r6_off_ties("pauc"))


W_REF = 200


def reference_window(spark, sf) -> list[float]:
    """The last 200 scores before the cut: a window of fixed size."""
    early, _ = halves(spark, sf)
    rows = early.orderBy(F.desc("ts"), F.desc("event_id")).limit(W_REF).select("score").collect()
    return [r[0] for r in rows]


REF = f"SELECT score AS r FROM ({EVENTS}) WHERE ts < TIMESTAMP '{EV_CUT}' ORDER BY ts DESC, event_id DESC LIMIT {W_REF}"


@query("rolling_rank_sum", f"""WITH ref AS ({REF}), e AS ({EVENTS}),
  pl AS (SELECT event_id, any_value(event_type) AS event_type, any_value(ts) AS ts,
    sum(CASE WHEN r < score THEN 1.0 WHEN r = score THEN 0.5 ELSE 0 END) AS p FROM e, ref GROUP BY event_id),
  m AS (SELECT event_id, CAST(sum(p) OVER o AS DOUBLE) AS s, count(*) OVER o AS n FROM pl
    WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {W_REF - 1} PRECEDING AND CURRENT ROW)),
  u AS (SELECT event_id, CASE WHEN n = {W_REF} THEN least(s, {W_REF * W_REF} - s) END AS u FROM m),
  z AS (SELECT *, (u - {W_REF * W_REF / 2}) / sqrt({W_REF * W_REF * (2 * W_REF + 1)} / 12) AS z FROM u)
  SELECT event_id, u, round(z, 6) AS z, CASE WHEN z < -3.2905267314918945 THEN 'alarm' WHEN z < -2.5758293035489004 THEN 'warn' ELSE 'normal' END AS verdict FROM z""")
def rolling_rank_sum(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "event_type", "score")
    out = sequence.rolling_mann_whitney(e, ORDER, reference_window(spark, sf), ["event_type"])
    return out.select("event_id", "u", r6("z"), "verdict")


@query("rolling_ks", f"""WITH ref AS ({REF}), e AS (SELECT score, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM ({EVENTS})),
  c AS (SELECT t AS checkpoint, score FROM e JOIN (SELECT unnest(range(0, (SELECT count(*) FROM e), 120)) AS t) x ON i > t - 400 AND i <= t AND t >= 399),
  v AS (SELECT checkpoint, score AS v FROM c UNION SELECT checkpoint, r FROM ref, (SELECT DISTINCT checkpoint FROM c)),
  f AS (SELECT v.checkpoint, v.v, (SELECT count(*) FROM ref WHERE r <= v.v) / {W_REF} AS fr FROM v),
  b AS (SELECT f.checkpoint, f.v, any_value(fr) AS fr, count(*) FILTER (c.score <= f.v) / 400 AS fb FROM f JOIN c USING (checkpoint) GROUP BY ALL)
  SELECT CAST(checkpoint AS BIGINT) AS "row", round(max(abs(fr - fb)), 6) AS ks FROM b GROUP BY checkpoint""")
def rolling_ks(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "score")
    return sequence.rolling_ks(e, ORDER, reference_window(spark, sf)).select("row", r6("ks"))


#: Rows after which each member of the detector ensemble learns its threshold anew, from 1,000 up to 3,000.
TRAIN_SIZES = [1000 + 200 * i for i in range(10)]


def trials(n: int = 60) -> list[dict]:
    """Parameter sets that fill the search ranges evenly: a Halton sequence over all five parameters."""

    def part(i: int, base: int) -> float:
        out, step = 0.0, 1.0
        while i:
            step /= base
            out, i = out + step * (i % base), i // base
        return out

    return [
        {
            "w1": 0.1 + 0.8 * part(i, 2), "window": 200 + 100 * int(9 * part(i, 3)), "every": 20 + 20 * int(10 * part(i, 5)),
            "p": 10 ** (-4 + 2 * part(i, 7)), "k": 1.0 + 2.0 * part(i, 11),
        }
        for i in range(1, n + 1)
    ]


def adaptive_sql(sets: list[dict], score: str) -> str:
    """CTEs up to ``pred``: every set's threshold and prediction for each row of the late half; a window is taken row by row."""
    values = ", ".join(f"({i}, {g['w1']!r}::DOUBLE, {g['window']}, {g['every']}, {g['p']!r}::DOUBLE, {g['k']!r}::DOUBLE)" for i, g in enumerate(sets))
    return f"""WITH par(trial, w1, win, every, p, k) AS (VALUES {values}), e AS ({EVENTS}),
  late AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM e WHERE ts >= TIMESTAMP '{EV_CUT}'),
  early AS (SELECT * FROM e WHERE ts < TIMESTAMP '{EV_CUT}'),
  base AS (SELECT trial, avg({score}) + any_value(par.k) * stddev_pop({score}) AS start FROM par, early e GROUP BY trial),
  smp AS (SELECT * FROM early ORDER BY md5('0:' || event_id) LIMIT {threshold.REFERENCE_SAMPLE}), m AS (SELECT count(*) AS m FROM smp),
  refs AS (SELECT trial, {score} AS r, count(*) AS c FROM par, smp e GROUP BY ALL),
  cum AS (SELECT trial, r, sum(c) OVER (PARTITION BY trial ORDER BY r) / (SELECT m FROM m) AS share FROM refs),
  cp AS (SELECT trial, w1, win, t FROM par, (SELECT unnest(range(0, (SELECT count(*) FROM late))) AS t) x WHERE t % every = 0 AND t >= win - 1),
  v AS (SELECT trial, t, win, {score.replace("par.", "cp.")} AS v FROM cp JOIN late e ON e.i > t - win AND e.i <= t),
  f AS (SELECT *, cume_dist() OVER w AS f, (rank() OVER w - 1) / win AS g FROM v WINDOW w AS (PARTITION BY trial, t ORDER BY v)),
  ks AS (SELECT f.trial, t, any_value(win) AS win, avg(v) AS mean, stddev_pop(v) AS std, max(greatest(abs(coalesce(a.share, 0) - f), abs(coalesce(b.share, 0) - g))) AS ks
    FROM f ASOF LEFT JOIN cum a ON f.trial = a.trial AND f.v >= a.r ASOF LEFT JOIN cum b ON f.trial = b.trial AND f.v > b.r GROUP BY f.trial, t),
  lam AS (SELECT *, sqrt(m * win::DOUBLE / (m + win)) * ks AS lam FROM ks, m),
  pv AS (SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * lam * lam) for j in range(1, 101)]))) END AS pv FROM lam),
  al AS (SELECT pv.trial, t, mean + par.k * std AS threshold FROM pv JOIN par USING (trial) WHERE pv.pv < par.p),
  rows AS (SELECT par.trial, e.*, {score} AS s, start FROM par JOIN base USING (trial), late e),
  pred AS (SELECT rows.*, coalesce(al.threshold, start) AS threshold, (s >= coalesce(al.threshold, start))::INT AS pred
    FROM rows ASOF LEFT JOIN al ON rows.trial = al.trial AND rows.i > al.t)"""


@query("adapted_threshold", adaptive_sql([{"w1": 1.0, "window": 400, "every": 120, "p": 0.2, "k": 1.7872}], "e.value") + """
  SELECT event_id, round(threshold, 6) AS threshold, pred FROM pred""")
def adapted_threshold(spark, sf):
    early, late = halves(spark, sf)
    out, _ = threshold.adapt_on_drift(late, early, ORDER, ["event_id"], p=0.2)
    return out.select("event_id", r6("threshold"), "pred")


@query("threshold_tuning", adaptive_sql(trials(), "par.w1 * e.value + (1 - par.w1) * e.k") + """,
  cell AS (SELECT trial, i >= n // 2 AS late, label, pred, count(*) AS c FROM pred GROUP BY ALL),
  side AS (SELECT trial, late, label AS cls, c AS support, 0 AS chosen, (label = pred)::INT * c AS tp FROM cell UNION ALL
    SELECT trial, late, pred, 0, c, 0 FROM cell),
  cls AS (SELECT trial, late, cls, CASE WHEN sum(support) + sum(chosen) > 0 THEN 2.0 * sum(tp) / (sum(support) + sum(chosen)) ELSE 0 END AS f1 FROM side GROUP BY ALL),
  f1 AS (SELECT trial, avg(f1) FILTER (NOT late) AS a, avg(f1) FILTER (late) AS b FROM cls GROUP BY trial)
  SELECT trial, w1, win::DOUBLE AS "window", every::DOUBLE AS every, p, k, round(a, 6) AS f1_calibration, round(b, 6) AS f1_evaluation,
    (row_number() OVER (ORDER BY a DESC, trial) = 1)::INT AS best FROM f1 JOIN par USING (trial)""")
def threshold_tuning(spark, sf):
    early, late = halves(spark, sf)
    roles = {"e1": F.col("value"), "e2": F.col("k")}
    tuned = threshold.tune(late.withColumns(roles), early.withColumns(roles), ORDER, ["event_id"], trials())
    return tuned.withColumns({c: F.round(c, 6) for c in ("f1_calibration", "f1_evaluation")})


@query("adwin_errors")
def adwin_errors(spark, sf):
    e = events(spark, sf).withColumn("err", (F.col("score") >= CUT).cast("int") != F.col("label"))
    return sequence.adwin(e.withColumn("err", F.col("err").cast("int")), ORDER, "err", ["event_type"])


@query("adwin_block_sums", f"""SELECT event_type, CAST(floor((rn - 1) / 32) AS BIGINT) AS block, CAST(count(*) AS DOUBLE) AS n,
  round(sum(value), 4) AS s, round(sum(value * value), 4) AS ss
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL""")
def adwin_block_sums(spark, sf):
    b = sequence.block_sums(events(spark, sf), ORDER, "value", ["event_type"])
    return b.select("event_type", "block", "n", F.round("s", 4).alias("s"), F.round("ss", 4).alias("ss"))


def ensemble_verdicts(spark, sf, init_size: int = 2000):
    """Members and reference losses from ``init_size`` normal rows of the early half, verdicts on the late one."""
    early, late = halves(spark, sf)
    cols, ids = ["value", "k"], ["event_id"]
    init = settle(init_sample(as_features(early, cols), ids, init_size))
    members = fit_members(init, ids, members=10, target=1)
    names = {f"m{i}": m for i, m in enumerate(members)}
    sizes = [180 + 4 * i for i in range(len(members))]
    scored = score_rows(as_features(late, cols).select("event_id", "ts", "event_type", "features"), names)
    # Reference losses: the rows that the members were fitted on, scored the same way.
    losses = score_rows(init.select("features"), names).select(*names).collect()
    refs = [[r[n] for r in losses] for n in names]
    rows = scored.withColumn("scores", F.array(*names))
    return sequence.detector_ensemble(rows, "event_type", ORDER, "scores", refs, sizes, train_sizes=TRAIN_SIZES).drop("ts")


@query("detector_ensemble")
def detector_ensemble(spark, sf):
    return ensemble_verdicts(spark, sf)
