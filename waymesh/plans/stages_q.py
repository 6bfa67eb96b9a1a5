"""Queries of request checks, gates, stage verification, identity and near searches: each runs the library's operator over whole tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.functions import clock, geo, structs, text
from waymesh.operators import aggregates, enrich, matching, rail, routing, spatial, stages
from waymesh.streaming import arrivals

from .catalogue import register
from .tables import EVENT_S, events, t

_TALLY = "SELECT rule, count(*) AS n, count(DISTINCT key) AS keys FROM v GROUP BY rule"


def _tally(violations):
    return violations.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@register("f_clock_wording", """
SELECT event_id, ((hour(ts) + CASE WHEN hour(ts) < 3 THEN 24 ELSE 0 END) * 3600 + minute(ts) * 60)::INTEGER AS night_s, (hour(ts) * 3600 + minute(ts) * 60)::INTEGER AS half_day_s,
epoch(date_trunc('second', ts))::BIGINT - 28800 AS instant_s, true AS naive_refused, CASE event_id % 3 WHEN 0 THEN '0,1,2,3,4' WHEN 1 THEN '7' END AS rule_days FROM events""")
def f_clock_wording(spark, d):
    hour, minute = F.hour("ts"), F.minute("ts")
    half = F.format_string("%d.%02d %s.m.", F.when(hour % 12 == 0, 12).otherwise(hour % 12), minute, F.when(hour < 12, "a").otherwise("p"))
    naive = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rule = F.when(F.col("event_id") % 3 == 0, "星期一 至五").when(F.col("event_id") % 3 == 1, "公眾假期").otherwise("now and then")
    return t(spark, d, "events").select(
        "event_id", clock.night_clock(F.format_string("%d:%02d", hour, minute)).alias("night_s"), clock.twelve_hour(half).alias("half_day_s"), clock.epoch(clock.strict_instant(F.concat(naive, F.lit("+08:00")))).alias("instant_s"),
        clock.strict_instant(naive).isNull().alias("naive_refused"), F.array_join(F.transform(clock.day_rule(rule), lambda x: x.cast("string")), ",").alias("rule_days"),
    )


@register("f_published_wording", r"""
SELECT p_partkey, lower(regexp_replace(p_name, '[^0-9A-Za-z一-鿿]', '', 'g')) AS stop_key, CASE p_partkey % 3 WHEN 0 THEN 'ctb' WHEN 1 THEN 'kmb' ELSE 'foo' END AS operator, p_name || '/y' AS names, (p_partkey % 20 + 1) || ',B' AS codes,
'07:00|' || lpad((p_partkey % 24)::VARCHAR, 2, '0') || ':30' AS clocks, concat_ws(',', (p_partkey % 5) * 3600 + 300, (p_partkey % 5) * 3600 + 1500, (p_partkey % 5) * 3600 + 3900, (p_partkey % 5) * 3600 + 5100) AS departures,
((p_partkey % 30 + 5) * 60)::INTEGER AS low, ((p_partkey % 30 + 10) * 60)::INTEGER AS high, p_partkey || ' z' AS parameter, p_name AS title, greatest(1, p_partkey % 12)::INTEGER AS span,
lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS month_day, CASE WHEN p_partkey % 2 = 0 THEN 'South Island Line' ELSE 'East Rail Line|Island Line' END AS lines, '#abcdef' AS colour, p_partkey % 2 = 0 AS conditional FROM part""")
def f_published_wording(spark, d):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    alias = F.when(k % 3 == 0, "NWFB").when(k % 3 == 1, " kmb ").otherwise("Foo")
    names = text.operator_names(F.concat(F.lit("[KMB+CTB] "), "p_name", F.lit("|x<br />[NLB] y")))
    span = text.minute_range(F.concat(F.lit("About "), s(k % 30 + 5), F.lit(" - "), s(k % 30 + 10), F.lit(" minutes")))
    even = k % 2 == 0
    return t(spark, d, "part").select(
        "p_partkey", text.stop_key(F.concat("p_name", F.lit(" (AB12)"))).alias("stop_key"), text.operator(alias).alias("operator"), F.concat(names[0]["name"], F.lit("/"), names[1]["name"]).alias("names"),
        F.array_join(text.codes(F.concat(s(k % 20 + 1), F.lit(" or b"))), ",").alias("codes"), F.array_join(text.clock_list(F.concat(F.lit("07:00、"), F.lpad(s(k % 24), 2, "0"), F.lit(":30, x"))), "|").alias("clocks"),
        F.array_join(F.transform(text.hour_minutes(k % 5, k % 5 + 1, F.lit("05, 25 61")), lambda x: x.cast("string")), ",").alias("departures"), span[0].alias("low"), span[1].alias("high"),
        text.query_parameter(F.concat(F.lit("https://x.org/a?b=1&id="), s(k), F.lit("%20z")), "id").alias("parameter"), text.page_title(F.concat(F.lit("/wiki/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("?q=1#z"))).alias("title"),
        text.repair_span(F.concat(F.lit('"'), s(k % 12), F.lit("px"))).alias("span"), text.month_day(F.concat(F.lit("2024年"), s(k % 12 + 1), F.lit("月"), s(k % 28 + 1), F.lit("日"))).alias("month_day"),
        F.array_join(text.lines_in(F.when(even, "take South Island Line").otherwise("Island Line, then East Rail Line")), "|").alias("lines"), text.table_cells(F.lit('<td style="Background-Color: #ABCDEF">')).alias("colour"),
        text.conditional(F.when(even, "School days").otherwise("daily")).alias("conditional"),
    )


@register("f_sequence_rules", """
WITH o AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS k, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, n >= 2 AND k = n AND a = 1 AND b = n AS ordered, n > 1 AND k = n AS rising, CASE WHEN n > 1 THEN n - 1 END::INTEGER AS hops, 'HR:L:' || l_orderkey || '>x' AS edge FROM o""")
def f_sequence_rules(spark, d):
    o = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    times = structs.profile(F.transform("x", lambda v: v * 60))
    return o.select(
        "l_orderkey", structs.ordered_from_one(F.col("x")).alias("ordered"), structs.strictly_increasing_to(times, (F.element_at("x", -1) - F.col("x")[0]) * 60).alias("rising"), F.size(structs.neighbours(F.col("x"))).alias("hops"),
        structs.edge_key(F.lit("HR"), F.lit("L"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("x")).alias("edge"),
    ).withColumn("hops", F.when(F.col("hops") > 0, F.col("hops")))


@register("f_plane", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS ax, embedding[4]::DOUBLE AS ay, embedding[5]::DOUBLE AS bx, embedding[6]::DOUBLE AS "by" FROM embeddings),
q AS (SELECT *, CASE WHEN (bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - ax) * (bx - ax) + (py - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) ELSE 0.0::DOUBLE END AS s FROM p)
SELECT vec_id, round(s, 6) AS share, round(sqrt(power(px - ax - s * (bx - ax), 2) + power(py - ay - s * ("by" - ay), 2)), 6) AS off, CASE WHEN vec_id % 2 = 1 THEN greatest(1, vec_id % 60 - 20) ELSE vec_id % 60 END::BIGINT AS seconds,
round(CASE WHEN vec_id % 3 = 0 THEN 1 + (px * 10 - 2) / 3 WHEN vec_id % 3 = 1 THEN 1 + 3 * (px * 10 - 2) / 9 ELSE 4 + (px * 10 - 11) / 3 END, 6) AS level FROM q""")
def f_plane(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    k = F.col("vec_id")
    on = geo.project_on_segment(*[e(i) for i in range(6)])
    low, high = F.when(k % 3 < 2, F.lit(2.0)), F.when(k % 3 > 0, F.lit(11.0))
    level = geo.level_index(e(0) * 10, low, F.lit(1.0), high, F.lit(4.0))
    return t(spark, d, "embeddings").select("vec_id", F.round(on["share"], 6).alias("share"), F.round(on["distance"], 6).alias("off"), geo.without_lift_wait(F.lit(4) + k % 2, k % 60).alias("seconds"), F.round(level, 6).alias("level"))


@register("p4_requests", """
WITH r AS (SELECT c_custkey AS request, 22.0::DOUBLE + (c_custkey % 70) * 0.01::DOUBLE AS la, 22.0::DOUBLE + (c_custkey % 64) * 0.01::DOUBLE AS lb, c_custkey AS k FROM customer)
SELECT request, CASE WHEN NOT la BETWEEN 22.1 AND 22.6 THEN 'origin' WHEN NOT lb BETWEEN 22.1 AND 22.6 THEN 'destination' WHEN k % 5 = 0 OR k % 7 = 0 THEN 'modes' WHEN k % 9 = 0 OR k % 13 = 0 THEN 'preference' WHEN k % 12 NOT BETWEEN 1 AND 10 THEN 'max_results'
WHEN k % 11 = 0 THEN 'departure' WHEN k % 28 + 1 NOT BETWEEN 3 AND 19 THEN 'outside_service_window' END AS problem FROM r""")
def p4_requests(spark, d):
    k = F.col("c_custkey")
    at = lambda m: F.lit(22.0) + (k % m) * F.lit(0.01)
    when = F.when(k % 11 == 0, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T09:00:00+08:00")))
    r = t(spark, d, "customer").select(
        k.alias("request"), at(70).alias("from_lat"), F.lit(114.0).alias("from_lon"), at(64).alias("to_lat"), F.lit(114.1).alias("to_lon"), when.alias("departure"), (k % 12).alias("max_results"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.lit("BUS"), F.lit("PLANE"))).otherwise(F.array(F.lit("BUS"))).alias("modes"), F.when(k % 9 == 0, None).when(k % 13 == 0, "cheapest").otherwise("fastest").alias("preference"),
    )
    instant = lambda s: F.lit(s).cast("timestamp")
    return stages.check_requests(r, instant("2024-01-03T00:00:00Z"), instant("2024-01-20T00:00:00Z")).select("request", "problem")


@register("p15_stays", """
WITH s AS (SELECT l_orderkey AS trip, l_linenumber AS seq, 22.0::DOUBLE + (l_partkey % 63) * 0.01::DOUBLE AS lat, (l_quantity * 15)::INTEGER AS stay FROM lineitem),
g AS (SELECT trip, count(*) AS n, bool_and(lat BETWEEN 22.1 AND 22.6) AS ok, bool_and(stay BETWEEN 0 AND 720) AS st, min(seq) AS a, max(seq) AS b, count(DISTINCT seq) AS k FROM s GROUP BY trip)
SELECT trip, n, CASE WHEN n NOT BETWEEN 2 AND 12 THEN 'stops' WHEN a <> 1 OR b <> n OR k <> n THEN 'order' WHEN NOT ok THEN 'coordinates' WHEN NOT st THEN 'stay' END AS problem FROM g""")
def p15_stays(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq"), (F.lit(22.0) + (F.col("l_partkey") % 63) * F.lit(0.01)).alias("lat"), F.lit(114.0).alias("lon"), (F.col("l_quantity") * 15).cast("int").alias("stay_min"))
    return stages.check_stays(s)


@register("p17_choose_entries", """
WITH g AS (SELECT o_custkey, bool_or(o_orderkey % 17 = 0) AS c, bool_and(o_orderstatus = 'F') AS i, bool_and(o_totalprice < 200000) AS p, bool_and(o_orderkey % 2 = 0) AS s FROM orders GROUP BY 1)
SELECT c_custkey AS item, CASE WHEN o_custkey IS NULL OR c THEN true WHEN i OR p OR s THEN false ELSE true END AS selected, CASE WHEN o_custkey IS NULL THEN 'not_listed' WHEN c THEN 'candidate' WHEN i THEN 'only_inactive' WHEN p THEN 'only_private' WHEN s THEN 'only_venue_shuttle' ELSE 'mixed' END AS reason
FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def p17_choose_entries(spark, d):
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 17 == 0).alias("candidate"), (F.col("o_orderstatus") == "F").alias("inactive"), (F.col("o_totalprice") < 200_000).alias("private"), (F.col("o_orderkey") % 2 == 0).alias("shuttle"))
    return stages.choose_entries(t(spark, d, "customer").select(F.col("c_custkey").alias("item")), e)


@register("j11_entry_candidates", """
WITH r AS (SELECT s_suppkey AS route_id, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['kmb', 'ctb'] WHEN 1 THEN ['nlb'] ELSE ['ctb'] END) AS operator, 'A' || s_suppkey % 7 AS number FROM supplier), p AS (SELECT * FROM (VALUES ('kmb', 'BUILD'), ('ctb', 'AUTO'), ('nlb', 'MACH')) v(operator, prefix))
SELECT DISTINCT route_id, c_custkey AS entry FROM r JOIN p USING (operator) JOIN customer ON number = 'A' || c_custkey % 7 AND starts_with(c_mktsegment, prefix)""")
def j11_entry_candidates(spark, d):
    k = F.col("s_suppkey")
    routes = t(spark, d, "supplier").select(k.alias("route_id"), F.when(k % 3 == 0, "KMB+CTB").when(k % 3 == 1, "NLB").otherwise("NWFB").alias("agency"), F.concat(F.lit("a"), (k % 7).cast("string")).alias("number"))
    entries = t(spark, d, "customer").select(F.col("c_custkey").alias("entry"), F.col("c_mktsegment").alias("title"), F.concat(F.lit("A"), (F.col("c_custkey") % 7).cast("string")).alias("number"))
    return stages.entry_candidates(routes, entries, spark.createDataFrame([("kmb", "BUILD"), ("ctb", "AUTO"), ("nlb", "MACH")], "operator string, prefix string"))


@register("d5_merge_gates", """
WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k, CASE WHEN NOT (k % 10 = 0 OR (k % 3 = 1 AND (k % 2 = 0 OR k % 5 <> 0)) OR (k % 3 > 1 AND k % 4 = 1)) THEN 'identity' WHEN k % 6 = 5 THEN 'endpoints' WHEN k % 5 = 0 THEN 'no_metadata' WHEN k % 11 = 0 THEN 'special_service' WHEN k % 8 = 0 THEN 'no_groups' WHEN k % 14 = 0 THEN 'unrepaired_table'
WHEN k % 10 <> 0 AND k % 12 + 1 < 4 THEN 'older_than_official' WHEN k % 19 = 0 THEN 'route_modified' WHEN k % 7 <> 1 THEN 'several_patterns' WHEN k % 23 = 0 THEN 'no_single_preferred_group' WHEN k % 29 = 0 THEN 'mixed_periods_and_departures' WHEN k % 31 = 0 OR k % 37 = 0 THEN 'date_already_covered'
WHEN k % 9 <> 0 AND k % 4 <> 1 AND k % 2 <> 0 THEN 'undated_page' WHEN k % 41 = 0 THEN 'no_origin_departure' WHEN k % 43 = 0 THEN 'negative_offset' END AS reason FROM o""")
def d5_merge_gates(spark, d):
    k = F.col("k")
    c = {
        "verified_loop": F.when(k % 10 == 0, True), "n_candidates": k % 3, "mutual": k % 2 == 0, "has_metadata": k % 5 != 0, "exact_terminal": k % 4, "endpoints_match": k % 6 != 5, "special": k % 11 == 0, "n_groups": k % 8, "unrepaired": k % 14 == 0, "page_month": k % 12 + 1,
        "official_month": F.lit(4), "modified": k % 19 == 0, "n_patterns": k % 7, "n_preferred": F.when(k % 23 == 0, 2).otherwise(1), "mixed": k % 29 == 0, "covered": F.when(k % 37 == 0, None).otherwise(k % 31 == 0), "dated": k % 9 == 0, "has_origin_departure": k % 41 != 0, "negative_offset": k % 43 == 0,
    }
    return stages.merge_gates(t(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumns(c)).select("k", "reason")


@register("d5_clone_departures", f"""
WITH dep AS (SELECT event_id, user_id % 5 AS template_id, {EVENT_S} AS s FROM events)
SELECT event_id AS trip_id, count(*) AS n, min(s + n_nationkey * 60)::BIGINT AS first_s, max(s + n_nationkey * 60 + 20)::BIGINT AS last_s FROM dep JOIN nation ON n_regionkey = template_id GROUP BY 1""")
def d5_clone_departures(spark, d):
    dep = events(spark, d).select(F.col("event_id").alias("trip_id"), (F.col("user_id") % 5).alias("template_id"), F.col("s").alias("departure_s"))
    k = F.col("n_nationkey")
    template = t(spark, d, "nation").select(F.col("n_regionkey").alias("template_id"), k.alias("stop_sequence"), k.alias("stop_id"), (k * 60).alias("offset_arr"), (k * 60 + 20).alias("offset_dep"))
    return stages.clone_departures(dep, template).groupBy("trip_id").agg(F.count("*").alias("n"), F.min("arrival_s").alias("first_s"), F.max("departure_s").alias("last_s"))


@register("d38_history_report", """
WITH p AS (SELECT DISTINCT user_id, event_id % 7 AS b FROM events WHERE user_id % 3 <> 0), h AS (SELECT isodow(ts) AS day, hour(ts) AS hour, user_id, event_id % 7 AS b FROM events WHERE event_id % 4 <> 0)
SELECT day, hour, count(DISTINCT (user_id, b)) AS covered, (SELECT count(*) FROM p) AS pairs FROM h JOIN p USING (user_id, b) GROUP BY day, hour""")
def d38_history_report(spark, d):
    e = t(spark, d, "events").select((F.weekday("ts") + 1).cast("bigint").alias("day"), F.hour("ts").cast("bigint").alias("hour"), F.col("user_id").alias("origin"), (F.col("event_id") % 7).alias("destination"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("seconds"))
    return stages.history_report(e.where("origin % 3 <> 0"), e).select("day", "hour", "covered", "pairs")


@register("d38_route_total", """
WITH v AS (SELECT DISTINCT l_suppkey, l_partkey, l_suppkey + l_partkey AS s FROM lineitem WHERE l_partkey % 10 <> 0)
SELECT l_orderkey AS route, CASE WHEN count(s) = count(*) THEN sum(s) END::BIGINT AS total FROM lineitem LEFT JOIN v USING (l_suppkey, l_partkey) GROUP BY 1""")
def d38_route_total(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_suppkey").alias("origin"), F.col("l_partkey").alias("destination"))
    values = s.where("destination % 10 <> 0").select("origin", "destination", (F.col("origin") + F.col("destination")).alias("seconds")).distinct()
    return stages.route_total(s, values)


_VISITS = """b AS (SELECT l_orderkey AS trip_id, l_linenumber AS q, min(l_partkey) AS p, CASE WHEN min(l_partkey) % 5 <> 0 THEN l_linenumber * 600 END AS a0 FROM lineitem GROUP BY 1, 2),
n AS (SELECT trip_id, q, p, CASE WHEN p % 89 = 0 THEN 0 ELSE p END AS s1, q * 600 - CASE WHEN p % 97 = 0 THEN 1300 ELSE 0 END AS a1 FROM b WHERE p % 83 <> 0)"""


def _visits(spark, d):
    """Visits before and after a re-timing that loses, moves and mistimes some."""
    q, p = F.col("stop_sequence"), F.col("stop_id")
    base = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence")).agg(F.min("l_partkey").alias("stop_id")).withColumn("arrival_s", F.when(p % 5 != 0, q * 600)).withColumn("departure_s", F.col("arrival_s") + 30)
    at = q * 600 - F.when(p % 97 == 0, 1300).otherwise(0)
    new = base.where(p % 83 != 0).withColumns({"stop_id": F.when(p % 89 == 0, 0).otherwise(p), "arrival_s": at, "departure_s": at + 30, "timepoint": F.when(p % 10 == 0, 1).otherwise(0), "shape_dist": F.when(p % 7 != 0, q * 100 - F.when(p % 71 == 0, 250).otherwise(0))})
    return base, new


@register("v1_timing", f"""
WITH {_VISITS}, x AS (SELECT b.trip_id, b.p, b.a0, n.s1, n.a1, n.trip_id IS NOT NULL AS there FROM b LEFT JOIN n USING (trip_id, q)), w AS (SELECT trip_id, a1, max(a1 + 30) OVER (PARTITION BY trip_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n),
v AS (SELECT 'visit_lost_or_added' AS rule, trip_id AS key FROM x WHERE NOT there UNION ALL SELECT 'stop_changed', trip_id FROM x WHERE there AND p <> s1 UNION ALL SELECT 'supplied_time_changed', trip_id FROM x WHERE there AND a0 <> a1
UNION ALL SELECT DISTINCT 'unapproved_trip', trip_id FROM x WHERE there AND a0 IS DISTINCT FROM a1 AND trip_id % 3 = 0 UNION ALL SELECT 'time_runs_back', trip_id FROM w WHERE a1 < before) {_TALLY}""")
def v1_timing(spark, d):
    base, new = _visits(spark, d)
    return _tally(stages.check_timing(base, new.drop("timepoint", "shape_dist"), base.where("trip_id % 3 <> 0").select("trip_id").distinct()))


@register("v3_surface", f"""
WITH {_VISITS}, x AS (SELECT n.*, b.a0 FROM n JOIN b USING (trip_id, q)), w AS (SELECT trip_id, dist, lag(dist) OVER (PARTITION BY trip_id ORDER BY q) AS before FROM (SELECT trip_id, q, q * 100 - CASE WHEN p % 71 = 0 THEN 250 ELSE 0 END AS dist FROM n WHERE p % 7 <> 0)),
v AS (SELECT 'rail_changed' AS rule, trip_id AS key FROM x WHERE trip_id % 4 = 0 AND a0 IS DISTINCT FROM a1 UNION ALL SELECT 'supplied_changed', trip_id FROM x WHERE a0 <> a1 UNION ALL SELECT 'estimate_not_flagged', trip_id FROM x WHERE a0 IS NULL AND p % 10 = 0
UNION ALL SELECT 'distance_falls', trip_id FROM w WHERE dist < before UNION ALL SELECT 'shape_missing', o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 9 = 0) {_TALLY}""")
def v3_surface(spark, d):
    base, new = _visits(spark, d)
    orders = t(spark, d, "orders")
    trips = orders.select(F.col("o_orderkey").alias("trip_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("shape_id"))
    shapes = orders.where("o_custkey % 9 <> 0").select(F.col("o_custkey").alias("shape_id"))
    return _tally(stages.check_surface(base, new, base.where("trip_id % 4 = 0").select("trip_id").distinct(), shapes, trips))


@register("v4_merge", f"""
WITH a AS (SELECT o_custkey AS r, o_orderdate::DATE AS day, o_orderstatus AS s FROM orders), p AS (SELECT DISTINCT r, day FROM a WHERE r % 2 = 0), g AS (SELECT p.r, p.day, count(*) FILTER (s = 'F') AS old, count(*) FILTER (s <> 'F') AS new FROM p JOIN a USING (r, day) GROUP BY 1, 2),
v AS (SELECT 'original_still_runs' AS rule, r AS key FROM g WHERE old > 0 UNION ALL SELECT 'no_replacement', r FROM g WHERE new = 0) {_TALLY}""")
def v4_merge(spark, d):
    active = t(spark, d, "orders").select(F.col("o_custkey").alias("route_id"), F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderstatus") == "F", "original").otherwise("replacement").alias("origin"))
    return _tally(stages.check_merge(active, active.where("route_id % 2 = 0").select("route_id", "date").distinct()))


@register("v7_pairs", f"""
WITH {_VISITS}, g AS (SELECT trip_id, count(*) AS n, arg_min(p, q) AS a, arg_max(p, q) AS z, max(q) * 600 - (min(q) * 600 + 30) AS s FROM b GROUP BY 1), e AS (SELECT *, CASE WHEN trip_id % 6 = 0 THEN 1 ELSE s END AS total, CASE WHEN trip_id % 8 = 0 THEN 0 ELSE a END AS f, trip_id % 5 <> 0 AS known FROM g),
v AS (SELECT 'not_two_visits' AS rule, trip_id AS key FROM e WHERE n <> 2 UNION ALL SELECT 'no_total', trip_id FROM e WHERE NOT known UNION ALL SELECT 'duration', trip_id FROM e WHERE known AND s <> total UNION ALL SELECT 'endpoints', trip_id FROM e WHERE known AND a <> f) {_TALLY}""")
def v7_pairs(spark, d):
    visits, k = _visits(spark, d)[0], F.col("trip_id")
    timed = visits.withColumns({"arrival_s": F.col("stop_sequence") * 600, "departure_s": F.col("stop_sequence") * 600 + 30})
    ends = timed.where("trip_id % 5 <> 0").groupBy("trip_id").agg(F.min_by("stop_id", "stop_sequence").alias("first"), F.max_by("stop_id", "stop_sequence").alias("last"), (F.max("arrival_s") - F.min("departure_s")).alias("total_s"))
    return _tally(stages.check_pairs(timed, ends.withColumns({"total_s": F.when(k % 6 == 0, 1).otherwise(F.col("total_s")), "first": F.when(k % 8 == 0, 0).otherwise(F.col("first"))})))


@register("v8_ferry", f"""
WITH {_VISITS}, g AS (SELECT trip_id, count(*) AS n, min(a1 + 30) AS dep, max(a1) AS arr FROM n GROUP BY 1), kept AS (SELECT trip_id, q, p, a0 FROM b WHERE trip_id % 2 = 1), same AS (SELECT kept.trip_id FROM kept LEFT JOIN n ON n.trip_id = kept.trip_id AND n.q = kept.q AND n.s1 = kept.p AND n.a1 = kept.a0 WHERE n.trip_id IS NULL),
v AS (SELECT 'unrelated_changed' AS rule, trip_id AS key FROM same UNION ALL SELECT 'proof_differs', o_orderkey FROM orders LEFT JOIN g ON trip_id = o_orderkey WHERE o_orderkey % 2 = 0 AND (n IS NULL OR n <> 2 OR dep <> 630 OR arr <> 1200)) {_TALLY}""")
def v8_ferry(spark, d):
    old, new = _visits(spark, d)
    proofs = t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("trip_id"), F.lit(630).alias("departure_s"), F.lit(1200).alias("arrival_s"))
    return _tally(stages.check_ferry(old, new, proofs, old.where("trip_id % 2 = 0").select("trip_id").distinct()))


@register("v11_suffixes", f"""
WITH v AS (SELECT 'suffix_differs' AS rule, o_orderkey AS key FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 600 <> o_custkey % 600 UNION ALL
SELECT 'forbidden_transfer', l_suppkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_partkey % 50 = 0) {_TALLY}""")
def v11_suffixes(spark, d):
    k = F.col("o_orderkey")
    trips = t(spark, d, "orders").select(k.alias("trip_id"), F.concat(F.lit("RAIL:X"), F.when(k % 4 != 0, F.concat(F.lit(":PATH:"), (k % 600).cast("string"))).otherwise("")).alias("route_id"), (F.col("o_custkey") % 600).alias("duration_s"))
    transfers = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_stop_id"), F.col("l_partkey").alias("to_stop_id")).distinct()
    return _tally(stages.check_suffixes(trips, transfers, transfers.where("to_stop_id % 50 = 0")))


@register("v12_response", f"""
WITH i AS (SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_partkey % 40 AS sig, l_partkey % 100 + l_linenumber * 20 AS k, l_partkey % 17 = 0 AS bad FROM lineitem), w AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY place) AS before FROM i),
v AS (SELECT 'not_sorted' AS rule, r AS key FROM w WHERE k < before UNION ALL SELECT 'signature_twice', r FROM i GROUP BY r, sig HAVING count(*) > 1 UNION ALL SELECT 'elapsed', r FROM i WHERE bad) {_TALLY}""")
def v12_response(spark, d):
    p = F.col("l_partkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    i = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), place.alias("place"), (p % 40).alias("signature"), (p % 100 + F.col("l_linenumber") * 20).alias("rank_key"), F.lit(900).alias("end_s"), F.lit(300).alias("request_s"), F.when(p % 17 == 0, 1).otherwise(600).alias("elapsed"))
    return _tally(stages.check_response(i))


@register("d26_release_drift", """
SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'new' ELSE 'changed' END AS state FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0) AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0)""")
def d26_release_drift(spark, d):
    k = F.col("path")
    files = t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return stages.release_drift(files.where(k % 5 != 0).withColumn("sha256", F.when(k % 11 == 0, "x").otherwise(F.col("sha256"))), files.where(k % 7 != 0))


@register("u5_missing_lines", """
WITH a AS (SELECT DISTINCT p_brand || p_size AS line FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_brand || p_size AS line FROM part WHERE p_partkey % 3 = 0)
SELECT line, 'no_page' AS state FROM a WHERE line NOT IN (SELECT line FROM b) UNION ALL SELECT line, 'not_in_inventory' FROM b WHERE line NOT IN (SELECT line FROM a)""")
def u5_missing_lines(spark, d):
    part = t(spark, d, "part").withColumn("line", F.concat("p_brand", F.col("p_size").cast("string")))
    return stages.missing_lines(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 3 = 0").select("line").distinct())


@register("u6_line_report", """
WITH r AS (SELECT p_brand AS line, ['listed', 'frequency', 'fallback', 'conditional'][p_partkey % 4 + 1] AS kind, CASE WHEN p_size % 9 = 0 THEN 'issue ' || p_size END AS issue FROM part)
SELECT line, printf('| %s | %d | %d | %d | %d | %s |', line, count(*) FILTER (kind = 'listed'), count(*) FILTER (kind = 'frequency'), count(*) FILTER (kind = 'fallback'), count(*) FILTER (kind = 'conditional'), coalesce(array_to_string(list_sort(list(DISTINCT issue) FILTER (issue IS NOT NULL)), ', '), '')) AS text FROM r GROUP BY line""")
def u6_line_report(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("listed", "frequency", "fallback", "conditional")])
    size = F.col("p_size")
    return stages.line_report(t(spark, d, "part").select(F.col("p_brand").alias("line"), F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"), F.when(size % 9 == 0, F.concat(F.lit("issue "), size.cast("string"))).alias("issue")))


@register("j22_unique_near", """
WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings), q AS (SELECT * FROM p WHERE label % 2 = 0), m AS (SELECT * FROM p WHERE label % 2 = 1),
g AS (SELECT q.vec_id, count(*) AS n, min(m.vec_id) AS one FROM q JOIN m ON m.x BETWEEN q.x - 4 AND q.x + 4 AND sqrt(power(q.x - m.x, 2) + power(q.y - m.y, 2)) <= 3 AND abs(q.z - m.z) <= 1 GROUP BY 1)
SELECT q.vec_id, CASE WHEN n = 1 THEN one END AS node, coalesce(n, 0) AS n FROM q LEFT JOIN g USING (vec_id)""")
def j22_unique_near(spark, d):
    e = lambda i, scale: F.col("embedding")[i].cast("double") * scale
    p = t(spark, d, "embeddings").select("vec_id", "label", e(0, 100).alias("x"), e(1, 100).alias("y"), e(2, 10).alias("z"))
    return spatial.unique_near(p.where("label % 2 = 0"), p.where("label % 2 = 1").withColumnRenamed("vec_id", "node"), "vec_id", "node", 3.0, 1.0)


@register("j21_within", """
WITH p AS (SELECT vec_id, label, 22.2 + (embedding[1]::DOUBLE + 1) * 0.1 AS la, 113.9 + (embedding[2]::DOUBLE + 1) * 0.1 AS lo FROM embeddings)
SELECT a.vec_id, count(*) AS n, min(b.vec_id) AS first_id FROM p a JOIN p b ON b.la BETWEEN a.la - 0.01 AND a.la + 0.01 AND 2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * power(sin(radians(b.lo - a.lo) / 2), 2)))) <= 400 AND a.label % 2 = 0 AND b.label % 2 = 1 GROUP BY 1""")
def j21_within(spark, d):
    at = lambda i, base: base + (F.col("embedding")[i].cast("double") + 1) * 0.1
    p = t(spark, d, "embeddings").select("vec_id", "label", at(0, 22.2).alias("lat"), at(1, 113.9).alias("lon"))
    marks = p.where("label % 2 = 1").select(F.col("vec_id").alias("mark"), "lat", "lon")
    return spatial.within(p.where("label % 2 = 0"), marks, 400.0).groupBy("vec_id").agg(F.count("*").alias("n"), F.min("mark").alias("first_id"))


@register("j30_unanimous", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1")
def j30_unanimous(spark, d):
    return matching.unanimous(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@register("j36_geographic", """
WITH s AS (SELECT c_custkey AS station, 'k' || c_custkey % 97 AS key FROM customer), v AS (SELECT s_suppkey, 'k' || (s_suppkey * 3) % 101 AS key FROM supplier), o AS (SELECT key, ns, nv FROM (SELECT key, count(*) AS ns FROM s GROUP BY 1) JOIN (SELECT key, count(*) AS nv FROM v GROUP BY 1) USING (key))
SELECT station, CASE WHEN ns IS NULL THEN 'no_venue' WHEN ns = 1 AND nv = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM s LEFT JOIN o USING (key)""")
def j36_geographic(spark, d):
    k = F.col("c_custkey")
    stations = t(spark, d, "customer").select(k.alias("station"), F.concat(F.lit("MTR K"), (k % 97).cast("string"), F.lit(" Station")).alias("name"))
    venues = t(spark, d, "supplier").select(F.concat(F.lit("k"), ((F.col("s_suppkey") * 3) % 101).cast("string")).alias("venue_name"), F.col("s_name").alias("name"))
    matched, held = enrich.geographic(stations, venues)
    return matched.select("station", F.lit("matched").alias("outcome")).union(held.select("station", F.col("reason").alias("outcome")))


@register("d18_rebind", """
WITH s AS (SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT trip_id, stop_sequence, CASE WHEN p % 3 = 0 THEN p + 1000000 ELSE p END AS stop_id FROM s""")
def d18_rebind(spark, d):
    base = _visits(spark, d)[0].select("trip_id", "stop_sequence", "stop_id")
    return enrich.rebind_stops(base, base.where("stop_id % 3 = 0").withColumn("platform_id", F.col("stop_id") + 1_000_000))


@register("d1_patterns", """
WITH q AS (SELECT l_orderkey, array_to_string(list(l_suppkey ORDER BY l_linenumber, l_suppkey), '>') AS s FROM lineitem GROUP BY 1)
SELECT o_custkey % 5 AS route, s AS stops, count(*) AS trip_count, count(DISTINCT o_orderkey % 2) AS n_directions FROM q JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def d1_patterns(spark, d):
    stops = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("stop_id"))
    trips = t(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 5).alias("route_id"), (F.col("o_orderkey") % 2).alias("direction_id"))
    got = enrich.patterns(stops, trips)
    return got.select(F.col("route_id").alias("route"), F.array_join(F.transform("stop_ids", lambda x: x.cast("string")), ">").alias("stops"), "trip_count", F.size("directions").cast("bigint").alias("n_directions"))


@register("d15_shift_bands", f"""
WITH f AS (SELECT user_id, {EVENT_S} AS s, event_id FROM events)
SELECT o_orderkey AS trip_id, count(*) AS n, min(s + o_orderkey % 900)::BIGINT AS first_s, max(s + 3600 + o_orderkey % 900)::BIGINT AS last_s FROM orders JOIN f ON user_id = o_custkey GROUP BY 1""")
def d15_shift_bands(spark, d):
    k = F.col("o_orderkey")
    connections = t(spark, d, "orders").select(k.alias("trip_id"), F.col("o_custkey").alias("parent_id"), (k % 900).alias("shift_s"))
    bands = events(spark, d).select(F.col("user_id").alias("trip_id"), F.col("s").alias("start_s"), (F.col("s") + 3600).alias("end_s"), F.lit(300).alias("headway_secs"), F.lit(0).alias("exact_times"))
    return rail.shift_bands(connections, bands).groupBy("trip_id").agg(F.count("*").alias("n"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))


@register("d27_recovery", """
WITH p AS (SELECT o_custkey AS r, o_orderkey % 50 AS a, o_orderkey % 1000 AS m1 FROM orders), q AS (SELECT o_custkey AS r, o_orderkey % 41 AS b, floor(o_totalprice)::BIGINT % 1000 AS m2 FROM orders),
w AS (SELECT p.r, a, b, row_number() OVER (PARTITION BY p.r ORDER BY m1 + m2, a, b) AS place FROM p JOIN q USING (r) WHERE a <> b) SELECT r AS request, a AS board, b AS alight, place::INTEGER AS place FROM w WHERE place <= 16""")
def d27_recovery(spark, d):
    k, o = F.col("o_orderkey"), t(spark, d, "orders")
    return routing.recovery_requests(o.select(F.col("o_custkey").alias("request"), (k % 50).alias("station"), (k % 1000).alias("metres")), o.select(F.col("o_custkey").alias("request"), (k % 41).alias("station"), (F.floor("o_totalprice") % 1000).alias("metres")))


@register("x5_identity_problems", """
WITH r AS (SELECT event_id AS k, CASE WHEN event_id % 13 = 0 THEN 'xyz' ELSE 'kmb' END AS op, CASE WHEN event_id % 17 = 0 THEN 'no way' ELSE 'R' || user_id % 9 END AS route, CASE WHEN event_id % 19 = 0 THEN 'X' ELSE 'O' END AS dir, user_id % 12 AS stop FROM events),
c AS (SELECT 'R' || p_size % 9 AS route, p_partkey % 10 AS stop, count(*) AS n FROM part WHERE p_size < 4 GROUP BY 1, 2)
SELECT k AS request, CASE WHEN op = 'xyz' THEN 'operator' WHEN r.route = 'no way' THEN 'route' WHEN dir = 'X' THEN 'direction' WHEN n IS NULL THEN 'not_verified' ELSE 'stop_repeats' END AS reason FROM r LEFT JOIN c ON c.route = r.route AND c.stop = r.stop WHERE op = 'xyz' OR r.route = 'no way' OR dir = 'X' OR n IS NULL OR n > 1""")
def x5_identity_problems(spark, d):
    k = F.col("event_id")
    number = lambda c: F.concat(F.lit("R"), (F.col(c) % 9).cast("string"))
    r = t(spark, d, "events").select(k.alias("request"), F.when(k % 13 == 0, "xyz").otherwise("kmb").alias("operator"), F.when(k % 17 == 0, "no way").otherwise(number("user_id")).alias("route"), F.when(k % 19 == 0, "X").otherwise("O").alias("direction"), (F.col("user_id") % 12).alias("stop"))
    c = t(spark, d, "part").where("p_size < 4").select(F.lit("kmb").alias("operator"), number("p_size").alias("route"), F.lit("O").alias("direction"), (F.col("p_partkey") % 10).alias("stop"))
    return arrivals.identity_problems(r, c)


@register("v2_schedule", f"""
WITH {_VISITS}, r AS (SELECT trip_id, q, dep - first_value(dep) OVER (PARTITION BY trip_id ORDER BY q) AS rel FROM (SELECT trip_id, q, q * 600 + CASE WHEN p % 97 = 0 THEN 7 ELSE 0 END AS dep FROM b)),
v AS (SELECT 'trip_lost' AS rule, o_orderkey AS key FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'offset_differs', x.trip_id FROM r x JOIN orders ON o_orderkey = x.trip_id LEFT JOIN r y ON y.trip_id = o_orderkey - o_orderkey % 2 AND y.q = x.q WHERE x.rel IS DISTINCT FROM y.rel
UNION ALL SELECT 'old_service_active', o_orderkey FROM orders WHERE o_orderkey % 13 = 0) {_TALLY}""")
def v2_schedule(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderdate").cast("date").alias("date"))
    times = _visits(spark, d)[0].withColumn("departure_s", F.col("stop_sequence") * 600 + F.when(F.col("stop_id") % 97 == 0, 7).otherwise(0))
    templates = orders.select("trip_id", (F.col("trip_id") - F.col("trip_id") % 2).alias("template_id"))
    return _tally(stages.check_schedule(orders, orders.where("trip_id % 50 <> 0"), templates, times, orders, orders.where("trip_id % 13 = 0")))


_HOPS = """e AS (SELECT trip_id, lag(s1) OVER w AS a, s1 AS z, a1 - lag(a1 + 30) OVER w AS sec FROM n WINDOW w AS (PARTITION BY trip_id ORDER BY q))"""


@register("v5_rail", f"""
WITH {_VISITS}, {_HOPS}, f AS (SELECT trip_id, lag(p) OVER (PARTITION BY trip_id ORDER BY q) AS a, p AS z, q * 600 - lag(q * 600 + 30) OVER (PARTITION BY trip_id ORDER BY q) AS sec FROM b),
v AS (SELECT 'edge_not_in_baseline' AS rule, trip_id AS key FROM e WHERE a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.a = e.a AND f.z = e.z AND f.sec = e.sec)
UNION ALL SELECT 'departure_twice', o_custkey % 50 FROM orders GROUP BY o_custkey % 50, o_orderdate::DATE, o_orderkey % 10 HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'not_attributed', trip_id FROM n WHERE trip_id % 9 = 0) {_TALLY}""")
def v5_rail(spark, d):
    base, new = _visits(spark, d)
    timed = base.withColumns({"arrival_s": F.col("stop_sequence") * 600, "departure_s": F.col("stop_sequence") * 600 + 30})
    departures = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("path_key"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 10).alias("departure_s"))
    return _tally(stages.check_rail(new, timed, departures, new.where("trip_id % 9 <> 0").select("trip_id").distinct()))


@register("v6_edges", f"""
WITH {_VISITS}, {_HOPS}, g AS (SELECT trip_id, arg_min(a1 + 30, q) AS dep, arg_min(q * 600 + 30, q) AS dep0 FROM n GROUP BY 1),
v AS (SELECT 'origin_moved' AS rule, trip_id AS key FROM g WHERE dep <> dep0 + CASE WHEN trip_id % 10 = 0 THEN 60 ELSE 0 END UNION ALL SELECT 'edge_differs', trip_id FROM e WHERE a % 2 = 0 AND sec <> 570) {_TALLY}""")
def v6_edges(spark, d):
    new = _visits(spark, d)[1]
    before = new.withColumn("departure_s", F.col("stop_sequence") * 600 + 30 + F.when(F.col("trip_id") % 10 == 0, 60).otherwise(0))
    edge = lambda a, b: F.concat_ws(">", a.cast("string"), b.cast("string"))
    hops = new.withColumn("a", F.lag("stop_id").over(Window.partitionBy("trip_id").orderBy("stop_sequence"))).where("a is not null")
    evidence = hops.select(edge(F.col("a"), F.col("stop_id")).alias("edge"), F.lit(570).alias("value"), (F.col("a") % 2 == 0).alias("accepted")).distinct()
    return _tally(stages.check_edges(new, before, evidence, edge))


@register("u6_service_span", f"""
WITH x AS (SELECT user_id, {EVENT_S} AS a, {EVENT_S} + CASE WHEN event_id % 2 = 0 THEN 1800 ELSE 601 END AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b FROM i GROUP BY user_id, island""")
def u6_service_span(spark, d):
    s, frequent = F.col("s"), F.col("event_id") % 2 == 0
    rows = events(spark, d).select("user_id", F.when(frequent, "frequency").otherwise("departures").alias("kind"), s.alias("start_s"), (s + 1800).alias("end_s"), F.when(~frequent, F.array(s + 600, s)).alias("times"))
    return stages.service_span(rows, ["user_id"]).select("user_id", "a", "b")


@register("d13_prefix_evidence", """
WITH o AS (SELECT l_orderkey AS origin, l_suppkey AS s, l_partkey % 1200 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS k FROM lineitem), h AS (SELECT y.origin, x.s AS a, y.s AS z, 100 + y.p - x.p AS sec FROM o x JOIN o y ON x.origin = y.origin AND y.k = x.k + 1),
e AS (SELECT origin, 'M:' || a || '>' || z AS edge, sec FROM h UNION ALL SELECT origin, 'L' || a % 2 || ':' || a || '>' || z, sec FROM h WHERE a % 2 = z % 2)
SELECT edge, count(*) AS n, count(DISTINCT origin) AS origins, min(sec)::INTEGER AS low, max(sec)::INTEGER AS high FROM e WHERE sec BETWEEN 30 AND 1200 GROUP BY edge""")
def d13_prefix_evidence(spark, d):
    o = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("origin")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("x"))
    paths = o.select("origin", "x", F.explode(F.sequence(F.lit(1), F.size("x"))).alias("k")).select("origin", F.transform(F.slice("x", F.lit(1), F.col("k")), lambda v: v["l_suppkey"].cast("string")).alias("path"), (F.col("k") * 100 + F.element_at("x", F.col("k"))["l_partkey"] % 1200).alias("total_s"))
    got = rail.prefix_evidence(paths.withColumn("lines", F.transform("path", lambda v: F.array(F.lit("M"), F.concat(F.lit("L"), (v.cast("bigint") % 2).cast("string"))))))
    return got.groupBy("edge").agg(F.count("*").alias("n"), F.count_distinct("origin").alias("origins"), F.min("seconds").alias("low"), F.max("seconds").alias("high"))


@register("d21_ferry", """
WITH x AS (SELECT o_orderkey AS k, o_orderkey % 32 AS mask, o_custkey % 5 AS route FROM orders)
SELECT k % 86400 AS departure_s, route, CASE WHEN mask >= 20 THEN 'no_service' WHEN mask < 5 THEN 'several_services' WHEN route = 3 THEN 'no_duration' ELSE 'S' || mask END AS outcome, CASE WHEN mask BETWEEN 5 AND 19 AND route <> 3 THEN k % 86400 + 600 * (route + 1) END AS arrival_s FROM x""")
def d21_ferry(spark, d):
    k = F.col("o_orderkey")
    bit = lambda mask, i: (F.floor(mask / 2**i) % 2).cast("int")
    week = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    mask = F.col("n_nationkey") % 20
    calendar = t(spark, d, "nation").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("service_id"), *[bit(mask, i).alias(day) for i, day in enumerate(week)])
    departures = t(spark, d, "orders").select((F.col("o_custkey") % 5).alias("route"), F.lit("O").alias("direction"), F.array(*[bit(k % 32, i) for i in range(7)]).alias("weekdays"), (k % 86_400).alias("departure_s"))
    durations = spark.range(5).where("id <> 3").select(F.col("id").alias("route"), F.lit("O").alias("direction"), (F.col("id") * 600 + 600).alias("upper_s"))
    new, unresolved = enrich.ferry_replacement(None, calendar, departures, durations)
    return new.select("departure_s", "route", F.col("service_id").alias("outcome"), "arrival_s").unionByName(unresolved.select("departure_s", "route", F.col("reason").alias("outcome"), F.lit(None).cast("bigint").alias("arrival_s")))


@register("d27_minute_search", """
WITH f AS (SELECT o_custkey AS r, o_orderkey % 30 AS trip FROM orders WHERE o_orderkey % 2 = 0), m AS (SELECT o_custkey AS r, o_orderkey % 37 AS trip FROM orders WHERE o_orderkey % 2 = 1),
more AS (SELECT * FROM m WHERE r IN (SELECT r FROM f WHERE trip % 3 = 0) AND NOT EXISTS (SELECT 1 FROM f WHERE f.r = m.r AND f.trip = m.trip)) SELECT r AS request, trip, count(*) AS n FROM (SELECT * FROM f UNION ALL SELECT * FROM more) GROUP BY 1, 2""")
def d27_minute_search(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    search = lambda rest, size: o.where(k % 2 == rest).select(F.col("o_custkey").alias("request"), F.array(k % size).alias("trips"))
    inexact = spark.range(30).where("id % 3 = 0").select(F.col("id").alias("trip_id"))
    return routing.with_minute_search(search(0, 30), search(1, 37), inexact).groupBy("request", F.col("trips")[0].alias("trip")).agg(F.count("*").alias("n"))


@register("j33_join_shifted", """
WITH o AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN n + 1 END::INTEGER AS n, CASE WHEN l_orderkey % 2 = 0 THEN b * 60 + 100 END::INTEGER AS end_t FROM o""")
def j33_join_shifted(spark, d):
    o = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.struct(x["l_suppkey"].alias("stop"), (x["l_linenumber"] * 60).alias("t"))).alias("a"))
    first = F.when(F.col("l_orderkey") % 2 == 0, F.element_at("a", -1)["stop"]).otherwise(F.lit(-1))
    b = F.array(F.struct(first.alias("stop"), F.lit(1000).alias("t")), F.struct(F.lit(7).cast("bigint").alias("stop"), F.lit(1100).alias("t")))
    got = o.select("l_orderkey", matching.join_shifted(F.col("a"), b).alias("x"))
    return got.select("l_orderkey", F.when(F.col("x").isNotNull(), F.size("x")).alias("n"), F.element_at("x", -1)["t"].alias("end_t"))


@register("a5_one_profile", """
WITH x AS (SELECT l_quantity::INTEGER AS k, l_orderkey AS trip, l_linenumber AS q, l_linenumber * (60 + l_partkey % 2) AS v FROM lineitem), r AS (SELECT *, v - first_value(v) OVER (PARTITION BY k, trip ORDER BY q, v) AS rel FROM x),
s AS (SELECT k, trip, list(rel ORDER BY q, v) AS profile FROM r GROUP BY 1, 2) SELECT k, count(DISTINCT profile) AS n_profiles, CASE WHEN count(DISTINCT profile) = 1 THEN min(trip) END AS template FROM s GROUP BY k""")
def a5_one_profile(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("k"), F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("q"), (F.col("l_linenumber") * (F.col("l_partkey") % 2 + 60)).alias("v"))
    return aggregates.one_profile(x, ["k"], "trip", "q", "v")


@register("a8_headway", "SELECT p_partkey, greatest(p_size, (p_size % 7) * 10, CASE WHEN p_partkey % 3 = 0 THEN 30 ELSE 0 END)::INTEGER AS headway_s FROM part")
def a8_headway(spark, d):
    part = t(spark, d, "part").withColumn("numbers", F.array("p_size", F.lit(None).cast("int"), F.col("p_size") % 7 * 10))
    return aggregates.headway(part, ["p_partkey"], "numbers", F.when(F.col("p_partkey") % 3 == 0, 30).otherwise(0))


@register("a13_first_sources", """
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority || o_orderstatus))[1:5], '|') AS sources FROM orders GROUP BY 1""")
def a13_first_sources(spark, d):
    o = t(spark, d, "orders").withColumn("url", F.concat("o_orderpriority", "o_orderstatus"))
    return aggregates.first_sources(o, ["o_custkey"], "url").withColumn("sources", F.array_join("sources", "|"))


@register("a15_percentile_matrix", """
WITH a AS (SELECT user_id % 20 AS origin, event_id % 15 AS destination, CASE WHEN event_id % 400 <> 0 THEN value END AS s FROM events)
SELECT origin, destination, CASE WHEN count(s) = count(*) THEN round(quantile_cont(s, 0.9), 6) END AS seconds FROM a GROUP BY 1, 2""")
def a15_percentile_matrix(spark, d):
    a = t(spark, d, "events").select((F.col("user_id") % 20).alias("origin"), (F.col("event_id") % 15).alias("destination"), F.when(F.col("event_id") % 400 != 0, F.col("value")).alias("seconds"))
    return routing.percentile_matrix(a).withColumn("seconds", F.round("seconds", 6))


@register("a21_holiday_services", """
WITH a AS (SELECT o_custkey % 25 AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1) SELECT n_nationkey AS service_id FROM nation JOIN a ON k = n_nationkey WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0 AND n >= 20""")
def a21_holiday_services(spark, d):
    k = F.col("n_nationkey")
    week = {day: F.lit(0) for day in ("tuesday", "wednesday", "thursday", "friday", "saturday")}
    calendar = t(spark, d, "nation").select(k.alias("service_id"), (k % 2).alias("sunday"), (k % 3 == 0).cast("int").alias("monday")).withColumns(week)
    dates = t(spark, d, "orders").select((F.col("o_custkey") % 25).alias("service_id"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 3).alias("exception_type"))
    return aggregates.holiday_services(dates, calendar, 20)


@register("j23_transfer_links", """
WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey // 8 END AS p, c_custkey // 16 AS name, c_custkey % 10 AS i FROM customer),
l AS (SELECT a.k, 'platform' AS kind, b.k AS other FROM s a JOIN s b ON a.p = b.p AND a.k <> b.k UNION ALL SELECT a.k, 'station', b.k FROM s a JOIN s b ON a.name = b.name AND a.k <> b.k AND a.p IS DISTINCT FROM b.p AND abs(a.i - b.i) <= 2)
SELECT k AS from_stop_id, kind, count(*) AS n, sum(other)::BIGINT AS others FROM l GROUP BY 1, 2""")
def j23_transfer_links(spark, d):
    k = F.col("c_custkey")
    stops = t(spark, d, "customer").select(k.alias("stop_id"), F.when(k % 7 != 0, F.floor(k / 8)).alias("parent_station"), F.floor(k / 16).alias("name_key"), (F.lit(22.2) + (k % 10) * F.lit(0.002)).alias("lat"), F.lit(114.0).alias("lon"))
    return enrich.transfer_links(stops).groupBy("from_stop_id", "kind").agg(F.count("*").alias("n"), F.sum("to_stop_id").alias("others"))


@register("j34_leg_provenance", """
WITH a AS (SELECT l_orderkey, min('u' || l_suppkey) AS url, max(l_partkey) AS rev, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, min('v' || l_suppkey) AS url, list_sort(list(DISTINCT l_linestatus)) AS w FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT o_orderkey AS trip_id, a.url AS shape_url, a.rev AS shape_revision, b.url AS time_url, array_to_string(list_concat(CASE WHEN r THEN ['returned'] ELSE [] END, coalesce(w, [])), ',') AS warnings FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""")
def j34_leg_provenance(spark, d):
    l = t(spark, d, "lineitem")
    source = lambda rows, mark, warning: rows.select(F.col("l_orderkey").alias("trip_id"), F.concat(F.lit(mark), F.col("l_suppkey").cast("string")).alias("url"), F.col("l_partkey").alias("revision"), warning.alias("warning"))
    sources = {"shape": source(l, "u", F.when(F.col("l_returnflag") == "R", "returned")), "time": source(l.where("l_linenumber % 2 = 0"), "v", F.col("l_linestatus"))}
    got = enrich.leg_provenance(t(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id")), sources)
    return got.select("trip_id", F.col("shape.url").alias("shape_url"), F.col("shape.revision").alias("shape_revision"), F.col("time.url").alias("time_url"), F.array_join("warnings", ",").alias("warnings"))
