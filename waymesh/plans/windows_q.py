"""Window and ordered-sequence queries over the driver tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.operators import intervals, sequences

from .catalogue import register
from .tables import EVENT_S, WINDOWS, events, t, windows


@register("w1_edges", f"""
WITH e AS (SELECT user_id, {EVENT_S} - lag({EVENT_S}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(gap) AS n_edges, min(gap)::BIGINT AS shortest, max(gap)::BIGINT AS longest, sum(gap)::BIGINT AS total FROM e GROUP BY user_id""")
def w1_edges(spark, d):
    e = sequences.edges(events(spark, d).select("user_id", "ts", "event_id", "s"), ["user_id"], ["ts", "event_id"], ["s"]).withColumn("gap", F.col("s") - F.col("prev_s"))
    return e.groupBy("user_id").agg(F.count("gap").alias("n_edges"), F.min("gap").alias("shortest"), F.max("gap").alias("longest"), F.sum("gap").alias("total"))


_TRIP = f"""
v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, {EVENT_S} AS s FROM events),
a AS (SELECT *, CASE WHEN k % 3 = 0 AND k < n THEN NULL ELSE s END AS t, s + k * 2 AS dist FROM v)"""


@register("w2_interpolate", f"""
WITH {_TRIP},
b AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0, first_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1,
last_value(CASE WHEN t IS NOT NULL THEN dist END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0, first_value(CASE WHEN t IS NOT NULL THEN dist END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1 FROM a),
j AS (SELECT *, max(CASE WHEN t IS NULL AND t1 - t0 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS bad FROM b)
SELECT user_id AS trip_id, k AS stop_sequence, CASE WHEN t IS NOT NULL THEN t WHEN bad = 1 THEN NULL ELSE greatest(t0 + 1, least(round_even(t0 + (t1 - t0) * ((dist - d0)::DOUBLE / (d1 - d0)), 0)::BIGINT, t1 - 1)) END::INTEGER AS arrival_s,
CASE WHEN t IS NULL THEN 0 ELSE 1 END::INTEGER AS timepoint, CASE WHEN bad = 1 THEN 'too_short' END AS reason FROM j""")
def w2_interpolate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = events(spark, d).select(F.col("user_id").alias("trip_id"), F.row_number().over(w).cast("bigint").alias("stop_sequence"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), "s")
    blank = (F.col("stop_sequence") % 3 == 0) & (F.col("stop_sequence") < F.col("n"))
    known = F.when(~blank, F.col("s"))
    visits = v.select("trip_id", "stop_sequence", known.alias("arrival_s"), known.alias("departure_s"), (F.col("s") + F.col("stop_sequence") * 2).alias("distance"))
    return sequences.interpolate(visits).select("trip_id", "stop_sequence", "arrival_s", "timepoint", "reason")


@register("w3_reweight", f"""
WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, {EVENT_S} AS s, value FROM events),
a AS (SELECT user_id, (k - 1) // 3 AS span, k, s, n, value, lag(s) OVER (PARTITION BY user_id ORDER BY k) AS p FROM v),
h AS (SELECT user_id, (k - 2) // 3 AS span, count(*) AS hops, max(k) AS k1, min(k) - 1 AS k0, sum(s - p)::BIGINT AS duration, sum(CASE WHEN k % 11 = 0 THEN 2.0 * (s - p) ELSE 1.0 * (s - p) END) AS total, max(CASE WHEN s - p < 5 OR s - p > 3960 THEN 1 ELSE 0 END) AS bad_w, max(CASE WHEN k % 11 = 0 AND (2 * (s - p) > 3960) THEN 1 ELSE 0 END) AS bad_w2 FROM a WHERE k > 1 AND (k - 2) // 3 < (n - 1) // 3 GROUP BY 1, 2)
SELECT CASE WHEN bad_w = 1 AND bad_w2 >= 0 THEN 'missing_or_invalid_weight' WHEN bad_w2 = 1 THEN 'missing_or_invalid_weight' WHEN duration < hops OR NOT (total / duration BETWEEN 2.0 / 3 AND 1.5) THEN 'ratio' ELSE 'accepted' END AS outcome, count(*) AS n, sum(duration)::BIGINT AS seconds FROM h GROUP BY 1""")
def w3_reweight(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = events(spark, d).select("user_id", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), F.col("s").alias("t"), (F.col("s") - F.lag("s").over(w)).alias("hop"))
    visits = v.select(F.col("user_id").alias("trip_id"), F.col("k").alias("stop_sequence"), "t", (F.col("k") % 3 == 1).alias("anchor"), F.lit(False).alias("supplied"), (F.col("k") * 50.0).alias("distance"))
    weights = v.where("k > 1").select(F.col("user_id").alias("trip_id"), F.col("k").alias("stop_sequence"), F.when(F.col("k") % 11 == 0, 2.0 * F.col("hop")).when(F.col("hop").between(5, 3960) | (F.col("hop") < 5) | (F.col("hop") > 3960), 1.0 * F.col("hop")).alias("w"), F.lit(False).alias("conflict"))
    # a doubled weight keeps the limits of its own hop
    weights = weights.withColumn("w", F.when((F.col("stop_sequence") % 11 == 0) & ~(F.col("w") / 2).between(5, 3960), None).otherwise(F.col("w")))
    _, report = sequences.reweight(visits, weights)
    return report.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))


@register("w4_running", """
SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS mean5 FROM events""")
def w4_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = sequences.running(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", "total")
    return e.select("user_id", "event_id", F.round("total", 4).alias("total"), F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 4).alias("mean5"))


_ISLANDS = f"""
i AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {WINDOWS}),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM i), u AS (SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, isl)"""


@register("w6_islands", f"WITH {_ISLANDS} SELECT user_id, a, b FROM u")
def w6_islands(spark, d):
    return intervals.union_windows(windows(spark, d), ["user_id"])


@register("w8_complement", f"""
WITH {_ISLANDS}, x AS (SELECT user_id, greatest(a, 864000) AS a, least(b, 950400) AS b FROM u WHERE b > 864000 AND a < 950400),
y AS (SELECT user_id, b AS a, lead(a, 1, 950400) OVER (PARTITION BY user_id ORDER BY a) AS b FROM x UNION ALL SELECT user_id, 864000, min(a) FROM x GROUP BY user_id)
SELECT user_id, a, b FROM y WHERE a < b""")
def w8_complement(spark, d):
    low, high = F.lit(864_000).cast("bigint"), F.lit(950_400).cast("bigint")
    clipped = windows(spark, d).where((F.col("b") > low) & (F.col("a") < high)).select("user_id", F.greatest("a", low).alias("a"), F.least("b", high).alias("b"))
    return intervals.complement(clipped, ["user_id"], low, high)


@register("w9_rollover", f"""
WITH e AS (SELECT user_id, {EVENT_S} AS s FROM events WHERE {EVENT_S} % 86400 >= 64800 OR {EVENT_S} % 86400 < 21600), g AS (SELECT user_id, s, (s + 43200) // 86400 AS night FROM e),
m AS (SELECT user_id, night, s - CASE WHEN min(s) OVER (PARTITION BY user_id, night) >= night * 86400 THEN night * 86400 ELSE (night - 1) * 86400 END AS t FROM g)
SELECT user_id, night, count(DISTINCT t) AS n, min(t)::INTEGER AS first_s, max(t)::INTEGER AS last_s, FALSE AS error FROM m GROUP BY user_id, night""")
def w9_rollover(spark, d):
    # evening and early morning clocks of each user and night, read downwards
    night = events(spark, d).where("s % 86400 >= 64800 or s % 86400 < 21600").withColumn("night", F.floor((F.col("s") + 43_200) / 86_400))
    lists = night.groupBy("user_id", "night").agg(F.array_sort(F.collect_list(F.struct("ts", (F.col("s") % 86_400).cast("int").alias("c")))).alias("x"))
    r = lists.withColumn("r", sequences.rollover(F.transform("x", lambda x: x["c"])))
    return r.select("user_id", "night", F.size("r.out").cast("bigint").alias("n"), F.element_at("r.out", 1).alias("first_s"), F.element_at("r.out", -1).alias("last_s"), F.col("r.error").alias("error"))


@register("w12_dedupe_consecutive", """
WITH p AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, count(*) AS n, sum(CASE WHEN prev IS NULL OR event_type <> prev THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM p GROUP BY user_id""")
def w12_dedupe_consecutive(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    kept = sequences.collapse_repeats(e, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.count("*").alias("n_kept"))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).join(kept, "user_id")


@register("w17_sections", f"""
WITH e AS (SELECT user_id, {EVENT_S} AS s, row_number() OVER w AS k, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT user_id, sec, s FROM e UNION ALL SELECT user_id, sec - 1, s FROM e WHERE event_type = 'purchase' AND k > 1)
SELECT user_id, sec::INTEGER AS section, count(*) AS n_rows, (max(s) - min(s))::BIGINT AS seconds FROM x GROUP BY 1, 2""")
def w17_sections(spark, d):
    e = sequences.sections(events(spark, d).select("user_id", "ts", "event_id", "event_type", "s"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    return e.groupBy("user_id", "section").agg(F.count("*").alias("n_rows"), (F.max("s") - F.min("s")).alias("seconds"))


@register("w18_waits", f"""
WITH l AS (SELECT user_id, {EVENT_S} AS s, {EVENT_S} + (event_id % 300) AS e, event_type <> 'view' AS transit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT *, min(s) OVER (PARTITION BY user_id) - 120 AS req FROM l),
g AS (SELECT *, s - coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY k), req) AS gap, sum(CASE WHEN transit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS boarding FROM r)
SELECT user_id, coalesce(sum(CASE WHEN transit AND boarding = 1 THEN gap END), 0)::BIGINT AS initial_wait, coalesce(sum(CASE WHEN transit AND boarding > 1 THEN gap END), 0)::BIGINT AS transfer_wait, sum(CASE WHEN transit THEN 1 ELSE 0 END)::BIGINT AS boardings,
greatest(0, sum(CASE WHEN transit THEN 1 ELSE 0 END) - 1)::BIGINT AS transfers, (max(e) - min(req))::BIGINT AS elapsed FROM g GROUP BY user_id""")
def w18_waits(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    legs = events(spark, d).select("user_id", F.col("s").alias("start_s"), (F.col("s") + F.col("event_id") % 300).alias("end_s"), (F.col("event_type") != "view").alias("transit"), F.row_number().over(w).alias("k"))
    legs = legs.withColumn("request_s", F.min("start_s").over(Window.partitionBy("user_id")) - 120)
    return sequences.waits(legs, "user_id", "k")


@register("w20_bracket", f"""
WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events), a AS (SELECT user_id, k, CASE WHEN k % 4 = 0 THEN value END AS v FROM v),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER l AS k0, last_value(v IGNORE NULLS) OVER l AS v0, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER r AS k1, first_value(v IGNORE NULLS) OVER r AS v1 FROM a
WINDOW l AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, k::INTEGER AS k, round(CASE WHEN v IS NOT NULL THEN v WHEN k1 > k0 THEN v0 + (v1 - v0) * (k - k0) / (k1 - k0) END, 5) AS filled FROM b""")
def w20_bracket(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = t(spark, d, "events").select("user_id", F.row_number().over(w).alias("k"), "value").withColumn("v", F.when(F.col("k") % 4 == 0, F.col("value")))
    return sequences.bracket(v, ["user_id"], "k", "v").select("user_id", "k", F.round("filled", 5).alias("filled"))


@register("w21_last_n", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_last_50 FROM r WHERE k <= 50 GROUP BY event_type""")
def w21_last_n(spark, d):
    last = sequences.last_n(t(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 50)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_last_50"))


@register("w_extra_frames", """
SELECT c_custkey, ntile(4) OVER w AS quartile, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume, rank() OVER w AS rnk, dense_rank() OVER w AS dense,
round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS near_sum, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near_keys,
first_value(c_custkey) OVER w AS first_key, nth_value(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
def w_extra_frames(spark, d):
    by = Window.partitionBy("c_nationkey")
    w = by.orderBy("c_acctbal", "c_custkey")
    return t(spark, d, "customer").select(
        "c_custkey", F.ntile(4).over(w).cast("bigint").alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"), F.rank().over(w).cast("bigint").alias("rnk"), F.dense_rank().over(w).cast("bigint").alias("dense"),
        F.round(F.sum("c_acctbal").over(w.rowsBetween(-2, 2)), 2).alias("near_sum"), F.count("*").over(by.orderBy("c_custkey").rangeBetween(-50, 50)).alias("near_keys"),
        F.first("c_custkey").over(w).alias("first_key"), F.nth_value("c_custkey", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second_key"),
    )


@register("w5_propagate", f"""
WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {EVENT_S} AS s FROM events), a AS (SELECT user_id, k, s AS arr, s + k % 3 AS dep, CASE WHEN k % 5 = 0 THEN 60 END AS edge FROM v),
h AS (SELECT *, coalesce(edge, arr - lag(dep) OVER (PARTITION BY user_id ORDER BY k), 0) AS hop, CASE WHEN k = 1 THEN 0 ELSE dep - arr END AS dwell, first_value(dep) OVER (PARTITION BY user_id ORDER BY k) AS f FROM a)
SELECT user_id, k::INTEGER AS k, (f + sum(hop + dwell) OVER w - dwell)::INTEGER AS arrival_s, (f + sum(hop + dwell) OVER w)::INTEGER AS departure_s FROM h WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w5_propagate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = events(spark, d).select("user_id", F.row_number().over(w).alias("k"), "s")
    rows = v.select("user_id", "k", F.col("s").alias("arrival_s"), (F.col("s") + F.col("k") % 3).alias("departure_s"), F.when(F.col("k") % 5 == 0, 60).alias("edge_s"))
    return sequences.propagate(rows, "user_id", "k").select("user_id", "k", "arrival_s", "departure_s")


@register("w7_coalesce_bands", f"""
WITH b AS (SELECT user_id, a, b, event_id % 2 AS r FROM {WINDOWS}), bad AS (SELECT DISTINCT x.user_id FROM b x JOIN b y ON x.user_id = y.user_id AND x.r <> y.r AND x.a < y.b AND y.a < x.b)
SELECT (SELECT count(DISTINCT user_id) FROM b) AS n_keys, (SELECT count(*) FROM bad) AS n_rejected""")
def w7_coalesce_bands(spark, d):
    bands = windows(spark, d).select("user_id", F.col("a").alias("start_s"), F.col("b").alias("end_s"), (F.col("event_id") % 2).alias("low"), (F.col("event_id") % 2).alias("high"))
    got = intervals.coalesce_bands(bands, ["user_id"])
    return got.groupBy("user_id").agg(F.max("reason").alias("reason")).agg(F.count("*").alias("n_keys"), F.count("reason").alias("n_rejected"))
