"""Queries of the composite stages: calendars, compilations, routing, audits, indoor graphs."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.operators import aggregates, calendar, enrich, quality, rail, ranking, routing, scheduling, sequences
from waymesh.operators.intervals import quarantine

from .catalogue import register
from .tables import EVENT_S, events, t, windows


@register("d2_coordinates", """
WITH s AS (SELECT n_nationkey AS station FROM nation), o AS (SELECT s_nationkey AS station, min(s_acctbal) AS b FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1), c AS (SELECT s_nationkey AS station, min(s_acctbal) AS b FROM supplier WHERE s_suppkey % 3 = 1 GROUP BY 1), m AS (SELECT s_nationkey AS station, min(s_acctbal) AS b FROM supplier WHERE s_suppkey % 3 = 2 GROUP BY 1)
SELECT s.station, CASE WHEN o.b IS NOT NULL THEN 'official' WHEN c.b IS NOT NULL AND m.b IS NOT NULL AND abs(c.b - m.b) * 1e-6 * 6371000.0 * pi() / 180 > 500 THEN 'osm_replaces_cache' WHEN c.b IS NOT NULL THEN 'cache' WHEN m.b IS NOT NULL THEN 'osm' ELSE 'missing' END AS tier
FROM s LEFT JOIN o USING (station) LEFT JOIN c USING (station) LEFT JOIN m USING (station)""")
def d2_coordinates(spark, d):
    sup = t(spark, d, "supplier")
    part = lambda k: sup.where(F.col("s_suppkey") % 3 == k).groupBy(F.col("s_nationkey").alias("station")).agg(F.min("s_acctbal").alias("b")).select("station", (22 + F.col("b") * 1e-6).alias("lat"), F.lit(114.0).alias("lon"))
    return enrich.resolve_coordinates(t(spark, d, "nation").select(F.col("n_nationkey").alias("station")), part(0), part(1), part(2)).select("station", "tier")


@register("d6_sequence_set", """
WITH b AS (SELECT p_partkey AS k, (p_size * 60)::BIGINT AS a, (p_size * 60 + 3600)::BIGINT AS e, CASE WHEN p_partkey % 4 = 0 THEN 700 ELSE 600 END::BIGINT AS h FROM part),
m AS (SELECT k, unnest(range(a, e + 1, h)) AS t FROM b), g AS (SELECT p_partkey AS k, unnest(range((p_size * 60)::BIGINT, (p_size * 60 + 3600)::BIGINT + 1, 600)) AS t FROM part)
SELECT coalesce(x.k, y.k) AS k, x.s IS NOT DISTINCT FROM y.s AS same FROM (SELECT k, list(DISTINCT t ORDER BY t) AS s FROM m GROUP BY k) x FULL OUTER JOIN (SELECT k, list(DISTINCT t ORDER BY t) AS s FROM g GROUP BY k) y ON x.k = y.k""")
def d6_sequence_set(spark, d):
    part = t(spark, d, "part")
    a = (F.col("p_size") * 60).cast("bigint")
    bands = part.select(F.col("p_partkey").alias("k"), a.alias("start_s"), (a + 3600).alias("end_s"), F.when(F.col("p_partkey") % 4 == 0, 700).otherwise(600).cast("bigint").alias("headway_secs"))
    listed = part.select(F.col("p_partkey").alias("k"), F.explode(F.sequence(a, a + 3600, F.lit(600).cast("bigint"))).alias("start_s"))
    return calendar.explicit_matches_bands(listed, bands, "k")


_DAYS = "(SELECT range::DATE AS date FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY))"


@register("d12_calendar", f"""
WITH days AS {_DAYS}, trips AS (SELECT s_suppkey AS trip, 'S' || s_nationkey % 3 AS service FROM supplier),
svc AS (SELECT * FROM (VALUES ('S0', 0, 4), ('S1', 5, 6), ('S2', 0, 6)) v(service, lo, hi)),
rep AS (SELECT trip, date FROM trips, days WHERE (trip % 5 = 0 AND isodow(date) = 1) OR (trip % 7 = 0 AND day(date) IN (3, 10))),
act AS (SELECT trip, date FROM trips JOIN svc USING (service), days WHERE isodow(date) - 1 BETWEEN lo AND hi)
SELECT trip, count(*) AS n_days, strftime(min(date), '%Y%m%d') AS first_day FROM act a WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.trip = a.trip AND r.date = a.date) GROUP BY trip""")
def d12_calendar(spark, d):
    sup = t(spark, d, "supplier")
    trips = sup.select(F.col("s_suppkey").alias("trip_id"), F.concat(F.lit("S"), (F.col("s_nationkey") % 3).cast("string")).alias("service_id"))
    low, high = F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date")
    rows = [("S0", 0, 4), ("S1", 5, 6), ("S2", 0, 6)]
    cal = spark.createDataFrame([(s, *[int(a <= i <= b) for i in range(7)]) for s, a, b in rows], "service_id string, " + ", ".join(f"{w} int" for w in calendar.WEEK)).withColumns({"start_date": low, "end_date": high})
    none = spark.createDataFrame([], "service_id string, date date, exception_type int")
    days = trips.select("trip_id").withColumn("date", F.explode(F.sequence(low, high)))
    rep = days.where(((F.col("trip_id") % 5 == 0) & (F.weekday("date") == 0)) | ((F.col("trip_id") % 7 == 0) & F.dayofmonth("date").isin(3, 10)))
    moved, cal2, dates2 = calendar.replace_dates(trips, cal, none, rep)
    active = calendar.service_dates(cal2, dates2, low, high)
    return moved.join(active, "service_id").groupBy(F.col("trip_id").alias("trip")).agg(F.count("*").alias("n_days"), F.date_format(F.min("date"), "yyyyMMdd").alias("first_day"))


@register("d14_pairs_cost", """
WITH p AS (SELECT l_orderkey, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS ids FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, ids, unnest(range(0, len(ids))) AS i FROM p), y AS (SELECT l_orderkey, ids, i, unnest(range(i + 1, len(ids))) AS j FROM x),
k AS (SELECT *, 'L:' || array_to_string(ids[i + 1:j + 1], '>') AS path_key FROM y), c AS (SELECT path_key, min(l_orderkey) % 600 + 60 AS total FROM k WHERE len(ids) >= 4 GROUP BY 1)
SELECT l_orderkey, count(*) AS n_pairs, count(total) AS n_known, coalesce(sum(total), 0)::BIGINT AS total_s FROM k LEFT JOIN c USING (path_key) GROUP BY l_orderkey""")
def d14_pairs_cost(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids")).where(F.size("ids") > 1)
    trips = p.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.lit("L").alias("line"), F.transform("ids", lambda x: x.cast("string")).alias("stops"), F.transform("ids", lambda x, i: i * 100).alias("departures"))
    n = F.size("ids")
    index = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.slice("ids", i + 1, j - i + 1))))
    keys = p.where("size(ids) >= 4").select("l_orderkey", F.explode(index).alias("s")).select("l_orderkey", F.concat(F.lit("L:"), F.array_join(F.transform("s", lambda x: x.cast("string")), ">")).alias("path_key"))
    costs = keys.groupBy("path_key").agg((F.min("l_orderkey") % 600 + 60).alias("total_s"))
    made, missing = rail.all_pairs(trips, costs)
    a = made.groupBy(F.col("parent_id").alias("trip_id")).agg(F.count("*").alias("n_known"), F.sum(F.col("arrival_s") - F.col("departure_s")).alias("total_s"))
    b = missing.groupBy("trip_id").agg(F.count("*").alias("n_missing"))
    both = a.join(b, "trip_id", "full_outer").na.fill(0)
    return both.select(F.col("trip_id").cast("bigint").alias("l_orderkey"), (F.col("n_known") + F.col("n_missing")).alias("n_pairs"), "n_known", "total_s")


_GRAPH = "(SELECT DISTINCT s_nationkey AS a, c_nationkey AS b, (s_nationkey * 7 + c_nationkey * 13) % 50 + 1 AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)"


@register("d17_shortest", f"""
WITH RECURSIVE g AS {_GRAPH}, r(source, node, cost, k) AS (SELECT n_nationkey, n_nationkey, 0::BIGINT, 0 FROM nation UNION SELECT r.source, g.b, r.cost + g.w, k + 1 FROM r JOIN g ON r.node = g.a WHERE k < 4 AND r.cost + g.w <= 60)
SELECT source, node, min(cost) AS cost FROM r GROUP BY 1, 2""")
def d17_shortest(spark, d):
    g = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("s_nationkey <> c_nationkey")
    edges = g.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"), ((F.col("s_nationkey") * 7 + F.col("c_nationkey") * 13) % 50 + 1).alias("w")).distinct()
    found = routing.relax(edges, t(spark, d, "nation").select(F.col("n_nationkey").alias("node")), 4)
    return found.where("cost <= 60")


_SCHED = """
h AS (SELECT s_suppkey AS key, s_nationkey % 7 AS wd, s_suppkey % 4 = 0 AS hol, (s_suppkey % 10) * 1800 + 18000 AS a, (s_suppkey % 10) * 1800 + 32400 AS b, 300 + (s_suppkey % 5) * 60 AS hw FROM supplier),
days AS (SELECT range::DATE AS date FROM range(DATE '2024-01-01', DATE '2024-01-15', INTERVAL 1 DAY)), hd AS (SELECT * FROM (VALUES (DATE '2024-01-01'), (DATE '2024-01-09')) v(date))"""


@register("d19_schedule", f"""
WITH {_SCHED}, x AS (SELECT h.*, days.date, hd.date IS NOT NULL AS is_h FROM h, days LEFT JOIN hd USING (date))
SELECT key, strftime(date, '%Y%m%d') AS day, a::INTEGER AS start_s, b::INTEGER AS end_s, hw::INTEGER AS headway_secs FROM x WHERE CASE WHEN is_h THEN hol ELSE isodow(date) - 1 >= wd END""")
def d19_schedule(spark, d):
    key = F.col("s_suppkey")
    bits = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: i >= F.col("s_nationkey") % 7)
    start = ((key % 10) * 1800 + 18_000).cast("int")
    heads = t(spark, d, "supplier").select(key.alias("key"), bits.alias("weekdays"), (key % 4 == 0).alias("public_holiday"), F.lit("frequency").alias("kind"), start.alias("start_s"), (start + 14_400).alias("end_s"), (300 + (key % 5) * 60).cast("int").alias("low"), (300 + (key % 5) * 60).cast("int").alias("high"))
    dates = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-14").cast("date"))).alias("date"))
    extra = spark.range(13).select(F.date_add(F.lit("2024-06-01").cast("date"), F.col("id").cast("int")).alias("date"))
    holidays = spark.createDataFrame([("2024-01-01",), ("2024-01-09",), ("2024-12-25",)], "d string").select(F.col("d").cast("date").alias("date")).union(extra)
    bands, _ = calendar.compile_schedule(heads, dates, holidays)
    return bands.select("key", F.date_format("date", "yyyyMMdd").alias("day"), "start_s", "end_s", "headway_secs")


@register("d20_group_days", """
WITH u AS (SELECT user_id, ts::DATE AS day, list(DISTINCT event_type ORDER BY event_type) AS items FROM events GROUP BY 1, 2), g AS (SELECT user_id, items, count(*) AS n FROM u GROUP BY 1, 2)
SELECT user_id, count(*) AS n_schedules, max(n) AS most_days FROM g GROUP BY user_id""")
def d20_group_days(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_type")
    return aggregates.grouped_days(e, ["user_id"], "day", ["event_type"]).groupBy("user_id").agg(F.count("*").alias("n_schedules"), F.max(F.size("days")).cast("bigint").alias("most_days"))


@register("d11_segments", """
WITH h AS (SELECT user_id || ':' || hour(ts) AS edge, isodow(ts) - 1 AS origin, event_type AS v FROM events),
o AS (SELECT edge, origin, min(v) AS a, max(v) AS b FROM h GROUP BY 1, 2), t AS (SELECT edge, count(*) AS origins FROM o GROUP BY 1),
c AS (SELECT edge, a AS value, count(*) AS votes FROM o WHERE a = b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY votes DESC, value) AS k FROM c)
SELECT edge, value, votes, origins, votes >= 3 AND votes / origins >= 0.9 AS accepted FROM r JOIN t USING (edge) WHERE k = 1""")
def d11_segments(spark, d):
    rows = t(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.hour("ts").cast("string")).alias("edge"), F.weekday("ts").alias("origin"), F.col("event_type").alias("v"))
    return aggregates.consensus(rows, "edge", "origin", "v").drop("share")


def _after_ride(before: str) -> str:
    return f"(SELECT request, stop, min(t) AS t FROM (SELECT * FROM {before} UNION ALL SELECT request, g, arr FROM {before} JOIN rides ON stop = f AND dep >= t) GROUP BY 1, 2)"


@register("d27_plan", f"""
WITH rides AS (SELECT l_suppkey % 12 AS f, l_partkey % 12 AS g, (l_orderkey % 30) * 120 AS dep, min((l_orderkey % 30) * 120 + 300 + l_linenumber * 60) AS arr FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12 GROUP BY 1, 2, 3),
b0 AS (SELECT i AS request, i AS stop, 0 AS t FROM range(12) r(i)), b1 AS {_after_ride("b0")}, b2 AS {_after_ride("b1")}, b3 AS {_after_ride("b2")}
SELECT request, stop, t::INTEGER AS t FROM b3""")
def d27_plan(spark, d):
    """Earliest arrivals within three rides over all lines as connections of twelve stops."""
    lines = t(spark, d, "lineitem").where("l_suppkey % 12 <> l_partkey % 12")
    trip = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    dep = ((F.col("l_orderkey") % 30) * 120).cast("int")
    none = F.lit(None).cast("int")
    rides = lines.select(trip.alias("trip_id"), (F.col("l_suppkey") % 12).alias("from_stop"), (F.col("l_partkey") % 12).alias("to_stop"), dep.alias("dep_s"), (dep + 300 + F.col("l_linenumber") * 60).cast("int").alias("arr_s"), none.alias("end_s"), none.alias("headway"), none.alias("exact"))
    # of rides between two stops that leave together only the first to arrive can matter
    rides = rides.groupBy("from_stop", "to_stop", "dep_s", "end_s", "headway", "exact").agg(F.min(F.struct("arr_s", "trip_id")).alias("x")).select("x.trip_id", "from_stop", "to_stop", "dep_s", "x.arr_s", "end_s", "headway", "exact")
    requests = spark.range(12).select(F.col("id").alias("request"), F.col("id").alias("stop"), F.lit(0).alias("t"))
    return routing.earliest(requests, rides, None, 3).select("request", "stop", "t")


_EV = f"(SELECT 'w' || user_id AS worker, 'job' AS kind, event_id::VARCHAR AS job, {EVENT_S} AS s, {EVENT_S} + 600 + (event_id % 7) * 600 AS e FROM events)"


@register("d32_audit", f"""
WITH ev AS {_EV}, j AS (SELECT event_id::VARCHAR AS job, 600 + (event_id % 6) * 600 AS service, 0 AS a, 1000000 AS b FROM events WHERE event_type <> 'error'),
o AS (SELECT *, max(e) OVER (PARTITION BY worker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ev)
SELECT 'overlap' AS rule, count(*) AS n FROM o WHERE s < last UNION ALL SELECT 'outside_shift', count(*) FROM ev WHERE s < 3600 OR e > 2600000 UNION ALL SELECT 'unknown_job', count(*) FROM ev WHERE job NOT IN (SELECT job FROM j)
UNION ALL SELECT 'duration', count(*) FROM ev JOIN j USING (job) WHERE e - s <> service UNION ALL SELECT 'window', count(*) FROM ev JOIN j USING (job) WHERE s < a OR e > b
UNION ALL SELECT 'coverage', count(*) FROM j WHERE (SELECT count(*) FROM ev WHERE ev.job = j.job) <> 1 UNION ALL SELECT 'break', count(DISTINCT worker) FROM ev""")
def d32_audit(spark, d):
    e = events(spark, d)
    ev = e.select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker"), F.lit("job").alias("kind"), F.col("event_id").cast("string").alias("job"), F.col("s").alias("start_s"), (F.col("s") + 600 + (F.col("event_id") % 7) * 600).alias("end_s"))
    jobs = e.where("event_type <> 'error'").select(F.col("event_id").cast("string").alias("job"), (600 + (F.col("event_id") % 6) * 600).alias("service_s"), F.lit(0).alias("window_start"), F.lit(1_000_000).alias("window_end"))
    found = scheduling.audit(ev, jobs, (3600, 2_600_000), True).groupBy("rule").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(r,) for r in ("overlap", "outside_shift", "unknown_job", "duration", "window", "coverage", "break")], "rule string")
    return rules.join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


@register("d34_trip_fold", f"""
WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, floor(value * 10)::BIGINT AS travel, (event_id % 900)::BIGINT AS stay, min({EVENT_S}) OVER (PARTITION BY user_id) AS req FROM events),
f AS (SELECT *, req + coalesce(sum(travel + stay) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s FROM l)
SELECT user_id, k::INTEGER AS k, start_s::BIGINT AS start_s, (start_s + travel)::BIGINT AS end_s FROM f""")
def d34_trip_fold(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    legs = events(spark, d).select("user_id", F.row_number().over(w).alias("order"), F.floor(F.col("value") * 10).alias("travel_s"), (F.col("event_id") % 900).alias("stay_s"), F.min("s").over(Window.partitionBy("user_id")).alias("request_s"))
    return routing.trip_fold(legs, "user_id").select("user_id", F.col("order").alias("k"), "start_s", "end_s")


@register("p16_quarantine", f"""
WITH r AS (SELECT event_id AS id, user_id % 40 AS k, CASE WHEN event_id % 3 = 0 THEN 'departure' ELSE 'frequency' END AS kind, {EVENT_S} AS a, {EVENT_S} + 600 + (event_id % 7) * 600 AS b, event_id % 97 = 0 AS mixed FROM events),
o AS (SELECT DISTINCT x.id FROM r x JOIN r y ON x.k = y.k AND x.id <> y.id AND x.kind = 'frequency' AND y.kind = 'frequency' AND x.a < y.b AND y.a < x.b),
i AS (SELECT x.id AS d, y.id AS f FROM r x JOIN r y ON x.k = y.k AND x.kind = 'departure' AND y.kind = 'frequency' AND y.a <= x.a AND x.a < y.b), z AS (SELECT d AS id FROM i UNION SELECT f FROM i)
SELECT CASE WHEN mixed THEN 'mixed_service' WHEN id IN (SELECT id FROM o) THEN 'overlapping_bands' WHEN id IN (SELECT id FROM z) THEN 'departure_in_band' ELSE 'safe' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def p16_quarantine(spark, d):
    r = windows(spark, d).select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("k"), F.when(F.col("event_id") % 3 == 0, "departure").otherwise("frequency").alias("kind"), F.col("a").alias("start_s"), F.col("b").alias("end_s"), (F.col("event_id") % 97 == 0).alias("mixed"))
    return quarantine(r, ["k"], "id", 7200).groupBy(F.coalesce("reason", F.lit("safe")).alias("reason")).agg(F.count("*").alias("n"))


@register("d17_indoor")
def d17_indoor(spark, d):
    """Each nation is a venue: its suppliers are nodes in a ring, every third edge a lift; entrances to platforms both ways."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("venue"), F.col("s_suppkey").alias("a"), F.coalesce(F.lead("s_suppkey").over(w), F.first("s_suppkey").over(w)).alias("b"), F.row_number().over(w).alias("k"))
    feats = s.select("venue", F.col("a").alias("id"), "a", "b", F.when(F.col("k") % 3 == 0, "lift").otherwise("walk").alias("mode"), (10.0 + F.col("k") * 5).alias("metres"), F.lit(4.0).alias("rise"), F.when(F.col("k") % 4 == 0, -1).otherwise(0).alias("direction"), (F.col("k") % 11 != 0).alias("enabled"), F.lit(True).alias("known_type"), F.lit(False).alias("restricted"))
    edges, _ = enrich.indoor_edges(feats)
    edges = enrich.collapse_lifts(edges)
    entrances = s.where("k = 1").select("venue", F.col("a").alias("node"))
    platforms = s.where("k = 3").select("venue", F.col("a").alias("node"))
    paths, status = enrich.indoor_paths(edges, entrances, platforms)
    n = paths.groupBy("venue").agg(F.count("*").alias("n_paths"), F.sum("traversal_time").alias("seconds"))
    return status.join(n, "venue", "left")


_SERVED = """(SELECT DISTINCT 'S' || l_suppkey AS a, 'C' || o_custkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT 'C' || c_custkey, 'S' || (c_custkey % 7 + 1) FROM customer)"""


@register("v_reachability", f"""
WITH RECURSIVE g AS {_SERVED}, f(e, node) AS (SELECT x, x FROM (VALUES ('S1'), ('S2')) v(x) UNION SELECT f.e, g.b FROM f JOIN g ON f.node = g.a), k(e, node) AS (SELECT x, x FROM (VALUES ('S1'), ('S2')) v(x) UNION SELECT k.e, g.a FROM k JOIN g ON k.node = g.b)
SELECT 'C' || c_custkey AS node FROM customer WHERE 'C' || c_custkey NOT IN (SELECT node FROM (SELECT * FROM f INTERSECT SELECT * FROM k))""")
def v_reachability(spark, d):
    """Suppliers lead to whom they have served, a customer to one of seven suppliers; two suppliers are entrances."""
    name = lambda letter, key: F.concat(F.lit(letter), key.cast("string"))
    served = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(name("S", F.col("l_suppkey")).alias("a"), name("C", F.col("o_custkey")).alias("b")).distinct()
    customers = t(spark, d, "customer").select("c_custkey")
    edges = served.union(customers.select(name("C", F.col("c_custkey")), name("S", F.col("c_custkey") % 7 + 1)))
    return quality.unreachable(customers.select(name("C", F.col("c_custkey")).alias("node")), spark.createDataFrame([("S1",), ("S2",)], "node string"), edges.persist())


@register("o2_signature", """
SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus || o_orderpriority) AS n_signatures FROM orders GROUP BY o_custkey""")
def o2_signature(spark, d):
    none, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    leg = F.struct(F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("route_id"), F.lit("a").alias("from_stop"), F.lit("b").alias("to_stop"), num.alias("from_lat"), num.alias("from_lon"), num.alias("to_lat"), num.alias("to_lon"), none.alias("path"), none.alias("vessel"))
    j = t(spark, d, "orders").select("o_custkey", ranking.itinerary_signature(F.array(leg)).alias("s"))
    return j.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_signatures"))


@register("a17_progress", """
WITH r AS (SELECT o_orderstatus, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS s, o_orderkey FROM orders), l AS (SELECT s FROM r WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 50)
SELECT (SELECT count(*) FROM r WHERE o_orderstatus IN ('O', 'P')) AS waiting, round((SELECT avg(s) FROM l), 4) AS mean_s, round((SELECT avg(s) FROM l) * (SELECT count(*) FROM r WHERE o_orderstatus IN ('O', 'P')), 2) AS eta_s""")
def a17_progress(spark, d):
    done = F.col("o_orderstatus") == "F"
    jobs = t(spark, d, "orders").select(F.when(done, "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running").alias("state"), F.col("o_orderkey").alias("finished"), F.when(done, F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate)")).alias("seconds"))
    p = aggregates.progress(jobs, "state", "finished", "seconds")
    return p.select(F.col("left").alias("waiting"), F.round("mean_s", 4).alias("mean_s"), F.round("eta_s", 2).alias("eta_s"))
