"""Projections, cleaning, filters, joins, windowed features, sorting, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.inputs import (
    EDGES, EVENTS, FACTS, VECTORS, edges, events, facts, query, r6, scratch, table, vectors,
)
from driftloom.functions import columns as C
from driftloom.functions.names import normalise_names, q
from driftloom.functions.payload import from_reply, to_payload
from driftloom.operators import adapt, clean, features, joins
from driftloom.operators.metrics import accuracy
from driftloom.operators.ranks import first_share
from driftloom.operators.sampling import init_and_stream
from driftloom.sources.schema import OVERLAP

SPECS = [
    ("avg_traffic_volume_gbyte_8h", "avg", "Traffic_Volume_Gbyte"),
    ("sum_traffic_volume_gbyte_8h", "sum", "Traffic_Volume_Gbyte"),
    ("avg_erab_drop_rate_8h", "avg", "ERAB_Drop_PC"),
]
WINDOWED = f"""WITH f AS ({FACTS}), e AS (SELECT CELL, N_CELL FROM ({EDGES}) WHERE overlap >= 40),
  j AS (SELECT f.*, e.N_CELL FROM f LEFT JOIN e USING (CELL)),
  w AS (SELECT time_bucket(INTERVAL '8 hours', DATETIME) AS window_start, CELL, N_CELL,
    coalesce(avg(Traffic_Volume_Gbyte), 0) AS avg_traffic_volume_gbyte_8h,
    coalesce(sum(Traffic_Volume_Gbyte), 0) AS sum_traffic_volume_gbyte_8h,
    coalesce(avg(ERAB_Drop_PC), 0) AS avg_erab_drop_rate_8h FROM j GROUP BY ALL)"""


def windowed(spark, sf):
    raw = facts(spark, sf).toDF("DATETIME", " SectorID", "event_id", "event_type", "[H] Traffic Volume Gbyte", "[H] ERAB_Drop_PC")
    return features.neighbour_window_features(normalise_names(raw), edges(spark, sf), SPECS)


@query("neighbour_window_features", f"""{WINDOWED} SELECT window_start, CELL, N_CELL,
  round(avg_traffic_volume_gbyte_8h, 6) AS avg_traffic_volume_gbyte_8h,
  round(sum_traffic_volume_gbyte_8h, 6) AS sum_traffic_volume_gbyte_8h,
  round(avg_erab_drop_rate_8h, 6) AS avg_erab_drop_rate_8h FROM w""")
def neighbour_windows(spark, sf):
    w = windowed(spark, sf)
    return w.select(F.col("window.start").alias("window_start"), "CELL", "N_CELL", *[r6(s[0]) for s in SPECS])


@query("neighbour_join", f"""SELECT f.event_id, f.CELL, e.N_CELL, f.Traffic_Volume_Gbyte FROM ({FACTS}) f
  LEFT JOIN (SELECT * FROM ({EDGES}) WHERE overlap >= 40) e USING (CELL)""")
def neighbour_join(spark, sf):
    return joins.join_neighbours(facts(spark, sf), edges(spark, sf)).select("event_id", "CELL", "N_CELL", "Traffic_Volume_Gbyte")


@query("strong_edges", f"SELECT CELL, N_CELL FROM ({EDGES}) WHERE overlap >= 40")
def strong_edges(spark, sf):
    return joins.strong_edges(edges(spark, sf))


@query("auto_window_features", f"""SELECT time_bucket(INTERVAL '8 hours', DATETIME) AS window_start, CELL,
  round(avg(Traffic_Volume_Gbyte), 6) AS avg_L_UL_Interference_Max_8h, round(avg(ERAB_Drop_PC), 6) AS avg_ERAB_Drop_PC_8h
  FROM ({FACTS}) GROUP BY ALL""")
def auto_windows(spark, sf):
    f = facts(spark, sf).select(
        "DATETIME", "CELL", q("Traffic_Volume_Gbyte").alias("L.UL.Interference.Max"), "ERAB_Drop_PC", F.lit(47.5).alias("LAT")
    )
    specs = features.auto_specs(f)
    w = features.window_features(f, specs)
    return w.select(F.col("window.start").alias("window_start"), "CELL", *[r6(s[0]) for s in specs])


@query("floored_cell_means", f"""WITH f AS ({FACTS}), e AS (SELECT CELL, N_CELL FROM ({EDGES}) WHERE overlap >= 40)
  SELECT time_bucket(INTERVAL '8 hours', DATETIME) AS time_window, CELL, round(avg(Traffic_Volume_Gbyte), 6) AS Traffic_Volume_Gbyte,
  round(avg(ERAB_Drop_PC), 6) AS ERAB_Drop_PC FROM f LEFT JOIN e USING (CELL) GROUP BY ALL""")
def floored(spark, sf):
    # Every row of a cell is repeated equally often by the join, so its mean needs no fan-out.
    cols = ["Traffic_Volume_Gbyte", "ERAB_Drop_PC"]
    return features.floored_means(facts(spark, sf), cols).select("time_window", "CELL", *[r6(c) for c in cols])


@query("table_totals", """SELECT round(sum(l_quantity), 6) AS total_quantity, round(avg(l_extendedprice), 6) AS avg_price,
  round(avg(l_discount), 6) AS avg_discount FROM lineitem""")
def totals(spark, sf):
    t = features.table_summary(
        table(spark, sf, "lineitem"), {"total_quantity": "l_quantity"},
        {"avg_price": "l_extendedprice", "avg_discount": "l_discount"}, null_as_zero=True,
    )
    return t.select(*[r6(c) for c in t.columns])


@query("neighbour_totals", f"""WITH f AS ({FACTS}), j AS (SELECT f.*, e.N_CELL FROM f LEFT JOIN ({EDGES}) e USING (CELL))
  SELECT 'per neighbour' AS mode, round(sum(Traffic_Volume_Gbyte), 4) AS total_traffic, round(avg(ERAB_Drop_PC), 6) AS avg_drop FROM j
  UNION ALL SELECT 'once', round(sum(Traffic_Volume_Gbyte), 4), round(avg(ERAB_Drop_PC), 6) FROM f""")
def fanout_totals(spark, sf):
    f, e = facts(spark, sf), edges(spark, sf)
    sums, avgs = {"total_traffic": "Traffic_Volume_Gbyte"}, {"avg_drop": "ERAB_Drop_PC"}
    both = [
        joins.neighbour_totals(f, e, sums, avgs).withColumn("mode", F.lit("per neighbour")),
        joins.neighbour_totals(f, e, sums, avgs, fanout_safe=True).withColumn("mode", F.lit("once")),
    ]
    return both[0].unionByName(both[1]).select("mode", F.round("total_traffic", 4).alias("total_traffic"), r6("avg_drop"))


@query("row_count", "SELECT count(*) AS n FROM orders")
def rows(spark, sf):
    return features.row_count(table(spark, sf, "orders"))


@query("top_cells", """SELECT user_id, round(avg(value), 6) AS avg_value FROM events GROUP BY user_id
  ORDER BY avg(value) DESC, user_id LIMIT 10""")
def top_cells(spark, sf):
    return features.top_groups(table(spark, sf, "events"), "user_id", "value").select("user_id", r6("avg_value"))


@query("window_gauges", f"""{WINDOWED} SELECT round(avg(avg_traffic_volume_gbyte_8h), 6) AS traffic,
  round(avg(avg_erab_drop_rate_8h), 6) AS drop_rate FROM w""")
def gauges(spark, sf):
    g = features.drift_gauges(windowed(spark, sf), {"traffic": "traffic_volume", "drop_rate": "erab_drop", "unknown": "no_such"})
    return g.select(r6("traffic"), r6("drop_rate"))


@query("name_cleanup", 'SELECT user_id AS "CELL", ts AS "DATETIME", value AS "Traffic_Volume_Gbyte", event_type AS "ERAB" FROM events')
def name_cleanup(spark, sf):
    raw = events(spark, sf).select(
        F.col("user_id").alias(" SITE "), F.col("ts").alias("DATETIME"), F.col("value").alias("[H] Traffic Volume Gbyte"),
        F.col("event_type").alias("[H] ERAB"),
    )
    return normalise_names(raw)


@query("composite_key", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) || '_' || CAST(s_suppkey AS VARCHAR) AS CELL FROM supplier")
def composite(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", C.composite_key("s_nationkey", "s_suppkey").alias("CELL"))


@query("clean_columns", f"""SELECT event_id, CAST(user_id AS VARCHAR) AS CELL, ts AS DATETIME,
  CASE WHEN event_type = 'view' THEN NULL ELSE value END AS kpi, CAST(NULL AS DOUBLE) AS absent, 0.0 AS filled
  FROM ({EVENTS}) WHERE event_type <> 'click'""")
def clean_columns(spark, sf):
    e = events(spark, sf)
    raw = e.select(
        "event_id", F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" ")).alias("CELL"),
        F.when(F.col("event_type") == "click", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("DATETIME"),
        F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string")).alias("kpi"),
        F.lit(None).cast("double").alias("empty"), F.col("value").alias("L.UL.prb7"), F.lit(None).cast("double").alias("filled"),
    )
    kept = clean.drop_named(clean.drop_empty_columns(raw, keep=["filled"]), "PRB")
    timed = kept.withColumns({
        "CELL": C.tidy_key(F.col("CELL")),
        "DATETIME": C.parse_time(F.col("DATETIME"), ["yyyy-MM-dd HH:mm:ss.SSSSSS", *C.TIME_LAYOUTS]),
    }).na.drop(subset=["CELL", "DATETIME"])
    full = clean.ensure_features(timed, ["kpi", "absent"])
    return full.withColumn("filled", F.coalesce("filled", F.lit(0.0)))


@query("fill_zero", """SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS value,
  CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS N_CELL FROM events""")
def fill_zero(spark, sf):
    is_view = F.col("event_type") == "view"
    e = events(spark, sf).select("event_id", F.when(~is_view, F.col("value")).alias("value"), F.when(~is_view, F.col("event_type")).alias("N_CELL"))
    return clean.fill_zero(e)


@query("fill_median", """WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events)
  SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 6) AS value FROM e""")
def fill_median(spark, sf):
    e = events(spark, sf).select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return clean.fill_median(e, ["value"]).select("event_id", r6("value"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("wide_series_row_mean", """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events
    WHERE NOT (event_type = 'view' AND ts >= TIMESTAMP '2024-01-20') GROUP BY ALL),
  g AS (SELECT a.day, b.event_type AS series FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) a,
    (SELECT DISTINCT event_type FROM events) b)
  SELECT g.day, g.series, round(coalesce(d.v, avg(d.v) OVER (PARTITION BY g.day)), 6) AS value
  FROM g LEFT JOIN d ON d.day = g.day AND d.event_type = g.series""")
def wide_series(spark, sf):
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    gap = (F.col("event_type") == "view") & (F.col("day") >= F.lit("2024-01-20").cast("date"))
    wide = clean.to_wide(e.withColumn("value", F.when(~gap, F.col("value"))), ["day"], KINDS, "event_type")
    full = clean.fill_row_mean(wide, KINDS)
    return clean.to_long(full, ["day"], KINDS).select("day", "series", r6("value"))


@query("label_variants", """SELECT vec_id, CAST(label <> (SELECT min(label) FROM embeddings) AS INTEGER) AS not_min,
  CAST(label > 0 AS INTEGER) AS above_0, CAST(label > 2 AS INTEGER) AS above_2 FROM embeddings""")
def label_variants(spark, sf):
    v = clean.binarise_not_min(vectors(spark, sf), "label", "not_min")
    return v.select("vec_id", "not_min", (F.col("label") > 0).cast("int").alias("above_0"), (F.col("label") > 2).cast("int").alias("above_2"))


@query("class_pick", "SELECT vec_id, CAST(label = 3 AS INTEGER) AS label FROM embeddings WHERE label IN (2, 3)")
def class_pick(spark, sf):
    return clean.keep_classes(vectors(spark, sf), [2, 3], 3).select("vec_id", "label")


@query("decoded_labels", """SELECT vec_id, CASE label WHEN 1 THEN 'Etanol (Ethanol)' WHEN 2 THEN 'Etilen (Ethylene)'
  WHEN 3 THEN 'Amonyak (Ammonia)' WHEN 4 THEN 'Asetaldehit (Acetaldehyde)' WHEN 5 THEN 'Aseton (Acetone)'
  WHEN 6 THEN 'Toluen (Toluene)' ELSE 'Bilinmeyen Gaz (' || label || ')' END AS name FROM embeddings""")
def decoded(spark, sf):
    return vectors(spark, sf).select("vec_id", C.decode(F.col("label")).alias("name"))


@query("score_flags", """SELECT event_id, CAST(value >= 12.31 AS INTEGER) AS at_least, CAST(value > 12.31 AS INTEGER) AS above,
  0 AS unset, CASE WHEN value >= 12.31 THEN 'Anomaly' ELSE 'Normal' END AS label_text FROM events""")
def score_flags(spark, sf):
    s = F.col("score")
    flagged = events(spark, sf).withColumns({"at_least": C.at_least(s, 12.31), "above": C.above(s, 12.31), "unset": C.above(s, None)})
    return flagged.select("event_id", "at_least", "above", "unset", C.flag_text(F.col("at_least")).alias("label_text"))


@query("padded_rows", """SELECT vec_id, 128 AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total,
  round(list_sum(CAST(embedding[1:10] AS DOUBLE[])), 6) AS head FROM embeddings""")
def padded(spark, sf):
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    p = vectors(spark, sf).withColumn("p", C.pad_or_crop(F.col("features"), 128))
    return p.select(
        "vec_id", F.size("p").alias("width"), r6(total(F.col("p")), "total"),
        r6(total(C.pad_or_crop(F.col("features"), 10)), "head"),
    )


@query("matrix_min_max", """WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  m AS (SELECT min(x) AS lo, max(x) AS hi FROM c)
  SELECT vec_id, round(sum((x - lo) / (hi - lo + 1e-7)), 6) AS total FROM c, m GROUP BY vec_id""")
def min_max_cells(spark, sf):
    s = clean.matrix_min_max(vectors(spark, sf), "features")
    return s.select("vec_id", r6(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x), "total"))


@query("rolled_pictures", """SELECT vec_id, pos, round(CAST(embedding[((pos - 1 - 16 + 64) % 64) + 1] AS DOUBLE), 6) AS value
  FROM embeddings, range(1, 65) r(pos)""")
def rolled(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode(C.roll_rows(F.col("features"), 2, 8)).alias("p", "x"))
    return v.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), r6("x", "value"))


@query("scalar_maths", """SELECT event_id, round(sign(value - 20) * pow(abs(value - 20), 1.0/3), 6) AS cbrt,
  round(1 / (1 + exp(-(value - 20) / 10)), 6) AS sig, least(greatest(value, 5.0), 50.0) AS clipped,
  round(ln((value + 1) / (k + 1)), 6) AS log_ratio, round(sqrt(value), 6) AS root FROM (%s)""" % EVENTS)
def scalar_maths(spark, sf):
    v, k = F.col("value"), F.col("k")
    return events(spark, sf).select(
        "event_id", r6(C.signed_cbrt(v - 20), "cbrt"), r6(C.sigmoid((v - 20) / 10), "sig"),
        C.clip(v, 5.0, 50.0).alias("clipped"), r6(F.log((v + 1) / (k + 1)), "log_ratio"), r6(F.sqrt(v), "root"),
    )


@query("string_functions", """SELECT p_partkey, trim(p_name) AS trimmed, starts_with(p_type, 'S') AS starts,
  replace(p_brand, '#', '') AS replaced, split_part(p_type, ' ', 1) AS first_word,
  CAST(nullif(regexp_extract(p_brand, '(\\d+)$', 1), '') AS INTEGER) AS number,
  contains(upper(p_name), 'PART') AS has_part FROM part""")
def strings(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.trim("p_name").alias("trimmed"), F.col("p_type").startswith("S").alias("starts"),
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("replaced"), F.split("p_type", " ")[0].alias("first_word"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("number"),
        F.upper("p_name").contains("PART").alias("has_part"),
    )


@query("json_payloads", """SELECT CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 1000) AS BIGINT) AS call,
  CAST((row_number() OVER (ORDER BY event_id) - 1) % 1000 AS INTEGER) AS pos, value AS anomaly_score FROM events""")
def payloads(spark, sf):
    e = events(spark, sf).withColumn("row", F.array("value", "k"))
    sent = to_payload(e, "row", ["event_id"])
    # The scorer's part, played by a column expression: the first feature comes back as the score.
    data = F.from_json("payload", "dataframe_split struct<data: array<array<double>>>")["dataframe_split"]["data"]
    scores = F.transform(data, lambda r: F.struct(r[0].alias("anomaly_score")))
    return from_reply(sent.select("call", F.to_json(F.struct(scores.alias("predictions"))).alias("reply")))


@query("within_tolerance", f"""WITH v AS ({VECTORS}), c AS (SELECT unnest(features) AS a, unnest(list_reverse(features)) AS b FROM v)
  SELECT round(avg(CAST(abs(a - b) < 0.1 AS DOUBLE)), 6) AS share FROM c""")
def tolerance(spark, sf):
    v = vectors(spark, sf).withColumn("other", F.reverse("features"))
    return clean.share_within(v, "features", "other").select(r6("share"))


@query("sensor_rows", f"""WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS CELL, ts AS DATETIME,
    CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value, k FROM ({EVENTS}))
  SELECT event_id, CELL, DATETIME, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 6) AS value, k FROM e""")
def sensor(spark, sf):
    e = events(spark, sf).select(
        "event_id", F.col("user_id").alias("CELL"), F.col("ts").alias("DATETIME"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"), "k", F.col("value").alias("PRB1"),
    )
    s = clean.sensor_rows(e, ["value", "k"])
    return s.select("event_id", "CELL", "DATETIME", r6("value"), "k")


@query("window_labels", f"""WITH e AS ({EVENTS}), l AS (SELECT user_id, date_trunc('second', ts) AS sec, max(label) AS label FROM e GROUP BY ALL)
  SELECT o.o_orderkey AS id, coalesce(l.label, 0) AS label FROM (
    SELECT event_id AS o_orderkey, user_id, date_trunc('second', CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 HOUR ELSE ts END) AS sec FROM e) o
  LEFT JOIN l USING (user_id, sec)""")
def window_labels(spark, sf):
    e = events(spark, sf)
    shifted = F.when(F.col("event_type") == "view", F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts"))
    wins = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("CELL"), shifted.alias("END_TIME"))
    # Each label twice, the copy as 0: doubled labels collapse to the largest.
    lab = e.select(F.col("user_id").alias("CELL"), F.col("ts").alias("END_TIME"), "label")
    lab = lab.unionByName(lab.withColumn("label", F.lit(0)))
    return joins.attach_labels(wins, lab).select("id", "label")


@query("init_and_stream", """SELECT 'init' AS part, least(2000, count(*) FILTER (label = 0)) AS n, CAST(0 AS BIGINT) AS anomalies,
  count(DISTINCT event_id) AS ids_of_both FROM (%s)
  UNION ALL SELECT 'stream', count(*) - least(2000, count(*) FILTER (label = 0)), count(*) FILTER (label = 1), count(DISTINCT event_id) FROM (%s)""" % (EVENTS, EVENTS))
def init_stream(spark, sf):
    init, stream = init_and_stream(events(spark, sf), ["event_id"])
    marked = init.withColumn("part", F.lit("init")).unionByName(stream.withColumn("part", F.lit("stream")))
    ids = marked.select("event_id").distinct().count()
    out = marked.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("anomalies"))
    return out.withColumn("ids_of_both", F.lit(ids).cast("long"))


@query("previous_batch_model", f"""WITH v AS ({VECTORS}), c AS (SELECT batch, label, i, avg(features[i]) AS m FROM v, range(1, 65) t(i) GROUP BY ALL),
  m AS (SELECT batch, label AS guess, list(m ORDER BY i) AS mean FROM c GROUP BY ALL),
  d AS (SELECT v.batch, v.vec_id, v.label, guess, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.features, m.mean)]) AS d FROM v JOIN m ON v.batch = m.batch + 1),
  n AS (SELECT batch, vec_id, any_value(label) AS label, arg_min(guess, (d, guess)) AS guess FROM d GROUP BY ALL)
  SELECT batch, round(avg(CAST(label = guess AS DOUBLE)), 6) AS accuracy FROM n GROUP BY batch""")
def previous_batch(spark, sf):
    """Each batch scored by the class means of the one before it, all pairs of batch and model in one pass."""
    v = vectors(spark, sf)
    pred = adapt.nearest_mean(v.select("batch", "vec_id", "label", "features"), joins.for_next_batch(adapt.class_means(v)))
    return accuracy(pred, ["batch"]).select("batch", r6("accuracy"))


@query("sorted_rows", "SELECT user_id, ts, event_id FROM events ORDER BY user_id, ts, event_id")
def sorted_rows(spark, sf):
    return events(spark, sf).select("user_id", "ts", "event_id").orderBy("user_id", "ts", "event_id")


@query("appended_history", f"""WITH v AS ({VECTORS}) SELECT b.batch, count(*) AS n, count(DISTINCT v.label) AS classes
  FROM (SELECT DISTINCT batch FROM v) b JOIN v ON v.batch <= b.batch GROUP BY b.batch""")
def appended(spark, sf):
    # The history of batch i is every batch up to i; per-class counts make the pieces small first.
    v = vectors(spark, sf).groupBy("batch", "label").agg(F.count("*").alias("n"))
    pieces = [v.where(F.col("batch") <= i).withColumn("upto", F.lit(i)) for i in range(10)]
    hist = features.append_history(*pieces)
    known = v.select(F.col("batch").alias("upto")).distinct()
    return hist.join(known, "upto", "left_semi").groupBy(F.col("upto").alias("batch")).agg(
        F.sum("n").alias("n"), F.count_distinct("label").alias("classes")
    )


@query("unseen_cells", "SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-30' EXCEPT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30'")
def unseen(spark, sf):
    e, last_day = events(spark, sf), F.lit("2024-01-30").cast("timestamp")
    early, late = e.where(F.col("ts") < last_day), e.where(F.col("ts") >= last_day)
    return joins.without(early.select("user_id").distinct(), late, ["user_id"])


@query("distinct_scores", "SELECT DISTINCT value FROM events")
def distinct_scores(spark, sf):
    return events(spark, sf).select("value").distinct()


@query("first_70_percent", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n
  FROM events) WHERE rn <= floor(n * 0.7)""")
def first_70(spark, sf):
    return first_share(events(spark, sf).select("event_id", "ts"), ["ts", "event_id"], 0.7).select("event_id")


@query("windowed_parquet", f"""{WINDOWED} SELECT CAST(window_start AS DATE) AS day, count(*) AS n,
  round(sum(avg_traffic_volume_gbyte_8h), 4) AS traffic FROM w GROUP BY day""")
def windowed_parquet(spark, sf):
    from driftloom.sinks.writers import write_windowed
    from driftloom.sources.readers import read_parquet

    path = scratch(spark, "windowed")
    write_windowed(windowed(spark, sf), path)
    back = read_parquet(spark, path)
    return back.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("avg_traffic_volume_gbyte_8h"), 4).alias("traffic"))


@query("edge_totals", f"SELECT count(*) AS n, round(avg(overlap), 6) AS avg_overlap FROM ({EDGES})")
def edge_totals(spark, sf):
    return edges(spark, sf).agg(F.count("*").alias("n"), r6(F.avg(q(OVERLAP)), "avg_overlap"))
