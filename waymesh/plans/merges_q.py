"""Queries of whole merge stages: interchanges, published schedules on the dates they hold for, layers of rail evidence."""
from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.operators import calendar, interchange, layers, schedule_merge

from .catalogue import register
from .tables import t

START, END = datetime.date(2024, 3, 4), datetime.date(2024, 4, 14)
HOLIDAYS = [datetime.date(2024, 3, 29), datetime.date(2024, 4, 1), datetime.date(2024, 4, 4)]
_DAYS = f"""days AS (SELECT d::DATE AS date, CASE WHEN d::DATE IN ({', '.join(f"DATE '{x}'" for x in HOLIDAYS)}) THEN 7 ELSE (dayofweek(d) + 6) % 7 END AS category FROM range(DATE '{START}', DATE '{END}' + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d))"""


def _days(spark):
    return spark.createDataFrame([(x,) for x in HOLIDAYS], "date date")


# Journeys: an order is a journey, its line items the sections in turn; a supplier's number is a
# section's line. Every supplier has three bands a day on the dates of one of three services.
_BANDS = """bands AS (SELECT j, ((s_suppkey * 37 + j * 11) % 6 + 4 + j * 6) * 3600 AS a, ((s_suppkey * 37 + j * 11) % 6 + 8 + j * 6 + s_suppkey % 3) * 3600 AS b, CASE WHEN (s_suppkey + j) % 5 = 0 THEN 0 ELSE (s_suppkey % 4 + 2) * 300 END AS h, s_suppkey, s_suppkey % 3 AS service FROM supplier, range(3) r(j) WHERE s_suppkey % 17 <> 0),
ranges AS (SELECT *, CASE WHEN h = 0 THEN a + 1 ELSE b END AS e FROM bands),
running AS (SELECT r.*, date FROM ranges r JOIN (SELECT (d::DATE) AS date, k FROM range(DATE '2024-03-04', DATE '2024-03-11', INTERVAL 1 DAY) x(d), range(3) s(k)) ON k = service AND (k = 0 OR dayofmonth(date) % (k + 1) <> 0))"""
_JOURNEYS = """parts AS (SELECT l_orderkey AS path, l_suppkey AS supp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS n FROM lineitem),
s AS (SELECT path, n, supp, n * 600 AS off, max(n) OVER (PARTITION BY path) AS need FROM parts), ok AS (SELECT path FROM s GROUP BY path HAVING max(need) > 0 AND bool_and(supp % 17 <> 0)),
u AS (SELECT s.* FROM s JOIN ok USING (path))"""
_OPEN = f"""{_BANDS}, {_JOURNEYS},
later AS (SELECT DISTINCT path, n, need, date, a - off AS a, e - off AS e FROM u JOIN running ON supp = s_suppkey WHERE n > 0),
cuts AS (SELECT DISTINCT path, date, unnest([a, e]) AS x FROM later),
spans AS (SELECT path, date, x AS lo, lead(x) OVER (PARTITION BY path, date ORDER BY x) AS hi FROM cuts),
free AS (SELECT path, date, lo, hi FROM spans JOIN later USING (path, date) WHERE hi IS NOT NULL AND a <= lo AND hi <= e GROUP BY path, date, lo, hi HAVING count(DISTINCT n) = max(need)),
marked AS (SELECT *, CASE WHEN lo = lag(hi) OVER (PARTITION BY path, date ORDER BY lo) THEN 0 ELSE 1 END AS fresh FROM free),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY path, date ORDER BY lo) AS i FROM marked),
windows AS (SELECT path, date, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY path, date, i),
got AS (SELECT f.path, f.date, greatest(f.a, w.lo) AS start_s, least(f.e, w.hi) AS end_s, f.h AS headway_secs, min(f.s_suppkey || '-' || f.j) AS parent FROM (SELECT path, date, a, e, h, s_suppkey, j FROM u JOIN running ON supp = s_suppkey WHERE n = 0) f JOIN windows w USING (path, date) WHERE greatest(f.a, w.lo) < least(f.e, w.hi) GROUP BY ALL),
day AS (SELECT path, start_s, end_s, headway_secs, min(parent) AS parent, string_agg(strftime(date, '%Y%m%d'), ',' ORDER BY date) AS dates FROM got GROUP BY ALL)"""
_OPEN = _OPEN.replace("GROUP BY ALL),\nday", "GROUP BY f.path, f.date, greatest(f.a, w.lo), least(f.e, w.hi), f.h),\nday").replace("FROM got GROUP BY ALL)", "FROM got GROUP BY path, start_s, end_s, headway_secs)")


def _interchanges(spark, d):
    k, j = F.col("s_suppkey"), F.col("j")
    start = ((k * 37 + j * 11) % 6 + 4 + j * 6) * 3600
    head = F.when((k + j) % 5 == 0, 0).otherwise((k % 4 + 2) * 300)
    bands = t(spark, d, "supplier").where(k % 17 != 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        F.concat(F.lit("L"), k.cast("string"), F.lit(":A>B")).alias("section_key"), (k % 3).alias("service"), start.alias("start_s"), F.when(head == 0, start + 1).otherwise(((k * 37 + j * 11) % 6 + 8 + j * 6 + k % 3) * 3600).alias("end_s"),
        head.alias("headway_secs"), F.lit(0).alias("exact_times"), F.concat_ws("-", k.cast("string"), j.cast("string")).alias("parent"),
    )
    week = spark.range(1).select(F.explode(F.sequence(F.lit(datetime.date(2024, 3, 4)), F.lit(datetime.date(2024, 3, 10)))).alias("date"))
    dates = week.crossJoin(spark.range(3).select(F.col("id").alias("service"))).where("service = 0 OR dayofmonth(date) % (service + 1) <> 0")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), "l_linenumber", "l_suppkey")
    path = Window.partitionBy("path_id")
    placed = lines.withColumns({"n": F.row_number().over(path.orderBy("l_linenumber", "l_suppkey")) - 1, "__k": F.count("*").over(path)}).where("__k > 1")
    parts = placed.select("path_id", "n", F.concat(F.lit("L"), F.col("l_suppkey").cast("string"), F.lit(":A>B")).alias("section_key"), (F.col("n") * 600).cast("bigint").alias("offset_s"))
    return parts, bands.join(dates, "service").drop("service")


@register("d15_interchange_windows", f"""WITH {_OPEN} SELECT path AS path_id, start_s, end_s, headway_secs, parent, substring(sha256(dates), 1, 16) AS service_key FROM day""")
def d15_interchange_windows(spark, d):
    """Journeys of up to seven sections: when all of them run, with dates as one service."""
    found, _ = interchange.window_sets(*_interchanges(spark, d))
    bands, _ = interchange.bundle(found)
    return bands.select("path_id", "start_s", "end_s", F.col("headway_secs").cast("bigint").alias("headway_secs"), "parent", "service_key")


@register("d15_interchange_lanes", f"""WITH {_OPEN}, k AS (SELECT path, dates, start_s, end_s FROM day WHERE headway_secs > 0)
SELECT x.path AS path_id, substring(sha256(x.dates), 1, 16) AS service_key, count(DISTINCT (x.start_s, x.end_s)) > 0 AS any_band, max(n)::BIGINT AS lanes FROM k x JOIN (SELECT p.path, p.dates, p.start_s, count(*) AS n FROM (SELECT DISTINCT path, dates, start_s FROM k) p JOIN k q ON p.path = q.path AND p.dates = q.dates AND q.start_s <= p.start_s AND p.start_s < q.end_s GROUP BY 1, 2, 3) y ON x.path = y.path AND x.dates = y.dates GROUP BY 1, 2""")
def d15_interchange_lanes(spark, d):
    """Lanes of every path and service: as many as its bands overlap at most."""
    bands, _ = interchange.bundle(interchange.window_sets(*_interchanges(spark, d))[0])
    return bands.where("headway_secs > 0").groupBy("path_id", "service_key").agg((F.count("*") > 0).alias("any_band"), (F.max("lane") + 1).cast("bigint").alias("lanes"))


@register("d15_interchange_refused", f"""WITH {_OPEN}, c AS (SELECT path FROM s GROUP BY path HAVING max(need) > 0)
SELECT path AS path_id, CASE WHEN path NOT IN (SELECT path FROM ok) THEN 'no_timetable' ELSE 'no_common_window' END AS reason FROM c WHERE path NOT IN (SELECT path FROM got)""")
def d15_interchange_refused(spark, d):
    return interchange.window_sets(*_interchanges(spark, d))[1]


@register("d15_journey_checks", """
WITH n AS (SELECT l_orderkey AS path, l_linenumber AS i, l_suppkey, l_quantity::INTEGER AS q, count(*) OVER (PARTITION BY l_orderkey) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS r FROM lineitem),
m AS (SELECT path, k, r, CASE WHEN r = k THEN CASE WHEN path % 11 = 0 THEN 'RIDE' ELSE 'END' END WHEN l_suppkey % 3 = 0 THEN 'INTERCHANGE' WHEN path % 13 = 0 AND r = 2 THEN 'WALK' ELSE 'RIDE' END AS link, CASE WHEN path % 7 = 0 AND r = 2 THEN 0 ELSE (r - 1) * 3.5::DOUBLE END AS t, l_suppkey % 29 = 0 AS marked FROM n),
g AS (SELECT path, k, bool_or(link = 'INTERCHANGE') AS change, bool_or(marked) OR path % 5 = 0 AS cond, bool_and(CASE WHEN r = k THEN link = 'END' ELSE link <> 'WALK' END) AS shape, max(CASE WHEN path % 7 = 0 AND r = 2 THEN 1 ELSE 0 END) AS flat FROM m GROUP BY path, k)
SELECT path AS path_id, CASE WHEN k < 2 THEN 'no_path' WHEN NOT change THEN 'no_change' WHEN cond THEN 'conditional' WHEN NOT shape THEN 'path_type' WHEN flat = 1 OR path % 3 = 2 THEN 'invalid_times' END AS reason,
CASE WHEN k > 1 THEN (SELECT count(*) FROM m x WHERE x.path = g.path AND x.r > 1 AND x.r < x.k AND x.link = 'INTERCHANGE') + 1 END::BIGINT AS sections FROM g""")
def d15_journey_checks(spark, d):
    """Which recorded journeys can be compiled, and how many sections each has."""
    o, r, k = F.col("l_orderkey"), F.col("r"), F.col("k")
    x = t(spark, d, "lineitem").groupBy(o).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    n = F.size("x")

    def node(v, i):
        link = F.when(i == n - 1, F.when(o % 11 == 0, "RIDE").otherwise("END")).when(v["l_suppkey"] % 3 == 0, "INTERCHANGE").when((o % 13 == 0) & (i == 1), "WALK").otherwise("RIDE")
        return F.struct(F.concat(F.lit("S"), i.cast("string")).alias("station"), F.lit("L").alias("line"), F.when((o % 7 == 0) & (i == 1), 0.0).otherwise(i * 3.5).alias("t_min"), link.alias("link"), (v["l_suppkey"] % 29 == 0).alias("marked"))

    last = F.concat(F.lit("S"), (n - 1).cast("string"))
    journeys = x.select(o.alias("path_id"), F.lit("S0").alias("origin"), F.when(o % 3 == 2, "elsewhere").otherwise(last).alias("destination"), F.when((o % 7 == 0) & (n == 2), 0.0).otherwise((n - 1) * 3.5).alias("total_min"), (o % 5 == 0).alias("marked"), F.transform("x", node).alias("nodes"))
    told = interchange.checked(journeys)
    cut = interchange.sections(told.where(F.size("nodes") > 1)).groupBy("path_id").agg(F.count("*").alias("sections"))
    return told.select("path_id", "reason").join(cut, "path_id", "left")


# A feed: orders are trips of a customer's route, nations are services, and customers' published
# groups replace trips of their route.
_FEED = f"""{_DAYS},
trips AS (SELECT o_orderkey AS trip_id, o_custkey AS route_id, o_orderkey % 2 + 1 AS direction, o_orderkey % 25 AS service_id FROM orders),
weekly AS (SELECT n_nationkey AS service_id, date FROM nation, days WHERE CASE dayofweek(date) WHEN 0 THEN n_nationkey % 4 = 0 WHEN 6 THEN n_nationkey % 3 = 0 ELSE n_nationkey % 7 <> dayofweek(date) END),
ex AS (SELECT n_nationkey AS service_id, DATE '2024-03-04' + ((n_nationkey * 3 + j * 5) % 42)::INTEGER AS date, CASE WHEN (n_nationkey + j) % 2 = 0 THEN 1 ELSE 2 END AS kind FROM nation, range(4) r(j)),
active AS (SELECT * FROM weekly WHERE (service_id, date) NOT IN (SELECT (service_id, date) FROM ex WHERE kind = 2) UNION SELECT service_id, date FROM ex WHERE kind = 1),
g AS (SELECT c_custkey AS route_id, j, j // 4 AS page, c_custkey % 2 + 1 AS direction, CASE j % 4 WHEN 0 THEN [0, 1, 2, 3, 4] WHEN 1 THEN [5] WHEN 2 THEN [6, 7] ELSE [5, 6] END AS cats, CASE WHEN (c_custkey + j) % 3 = 0 THEN 'hour_minute' ELSE 'interval' END AS layout, (c_custkey * 7 + j) % 11 <> 0 AS valid,
 CASE WHEN (c_custkey + j) % 4 = 1 THEN 0 ELSE c_custkey % 5 + 1 END AS listed, CASE WHEN (c_custkey + j) % 4 = 1 OR (c_custkey + j) % 13 = 0 THEN 2 ELSE 0 END AS banded, CASE WHEN c_custkey % 19 = 0 AND j < 4 THEN 'older_than_official' END AS gate FROM customer, range(8) r(j)),
tpl AS (SELECT route_id, direction, min(trip_id) AS template_id, CASE WHEN route_id % 6 = 0 AND count(*) > 1 THEN 'several_patterns' WHEN route_id % 23 = 1 THEN 'no_origin_departure' WHEN route_id % 29 = 2 THEN 'negative_offset' END AS why FROM trips GROUP BY route_id, direction),
e AS (SELECT g.*, unnest(cats) AS category FROM g), w AS (SELECT e.*, count(*) FILTER (valid AND layout = 'hour_minute') OVER p AS h, count(*) FILTER (valid) OVER p AS v FROM e WINDOW p AS (PARTITION BY route_id, direction, category, page)),
q AS (SELECT w.*, CASE WHEN gate IS NOT NULL THEN gate WHEN template_id IS NULL THEN 'no_trips' WHEN why IS NOT NULL THEN why WHEN (CASE WHEN h > 0 THEN h ELSE v END) <> 1 OR NOT (CASE WHEN h > 0 THEN valid AND layout = 'hour_minute' ELSE valid END) THEN 'no_single_preferred_group' WHEN listed > 0 AND banded > 0 THEN 'mixed_periods_and_departures' WHEN listed = 0 AND banded = 0 THEN 'no_times' END AS reason FROM w LEFT JOIN tpl USING (route_id, direction)),
r AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY route_id, direction, category, reason ORDER BY page, j) END AS k FROM q),
lost AS (SELECT DISTINCT route_id, direction, date FROM r JOIN days USING (category) WHERE k = 1)"""


def _feed(spark, d):
    o, c, n = F.col("o_orderkey"), F.col("c_custkey"), F.col("n_nationkey")
    trips = t(spark, d, "orders").select(o.alias("trip_id"), F.col("o_custkey").alias("route_id"), (o % 2 + 1).alias("direction"), (o % 25).cast("string").alias("service_id"))
    trips = trips.select(F.col("trip_id").cast("string").alias("trip_id"), "route_id", "direction", "service_id", F.col("trip_id").alias("__o"))
    r, q = F.col("route_id"), F.col("q")
    base = F.col("__o") % 18 * 3600 + 18000
    visits = trips.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(3))))
    arrival = F.when((r % 23 == 1) & (q == 1), None).otherwise(base + (q - 1) * 300 - F.when((r % 29 == 2) & (q == 2), 900).otherwise(0))
    stop_times = visits.select("trip_id", q.alias("stop_sequence"), F.concat_ws("-", r.cast("string"), q.cast("string"), F.when(r % 6 == 0, F.col("trip_id"))).alias("stop_id"), arrival.cast("int").alias("arrival_s"), arrival.cast("int").alias("departure_s"))
    nation = t(spark, d, "nation")
    week = {w: ((n % 7 != i + 1) if i < 5 else (n % 3 == 0) if i == 5 else (n % 4 == 0)).cast("int") for i, w in enumerate(calendar.WEEK)}
    cal = nation.select(n.cast("string").alias("service_id"), *[v.alias(w) for w, v in week.items()], F.lit(datetime.date(2024, 1, 1)).alias("start_date"), F.lit(datetime.date(2024, 12, 31)).alias("end_date"))
    j = F.col("j")
    ex = nation.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(n.cast("string").alias("service_id"), F.date_add(F.lit(datetime.date(2024, 3, 4)), ((n * 3 + j * 5) % 42).cast("int")).alias("date"), F.when((n + j) % 2 == 0, 1).otherwise(2).alias("exception_type"))
    groups = t(spark, d, "customer").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
    ints = lambda x: F.array(*[F.lit(v) for v in x])
    cats = F.when(j % 4 == 0, ints([0, 1, 2, 3, 4])).when(j % 4 == 1, ints([5])).when(j % 4 == 2, ints([6, 7])).otherwise(ints([5, 6]))
    departures = F.when((c + j) % 4 == 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1).cast("bigint"), c % 5 + 1), lambda i: (i * 1800 + 20000).cast("int")))
    span = lambda a, b, h: F.struct(F.lit(a).alias("start_s"), F.lit(b).alias("end_s"), F.lit(h).alias("headway_secs"))
    both = F.array(span(21600, 36000, 600), span(36000, 72000, 900))
    periods = F.when(((c + j) % 4 == 1) | ((c + j) % 13 == 0), both).otherwise(F.array().cast("array<struct<start_s:int,end_s:int,headway_secs:int>>"))
    g = groups.select(
        j.cast("string").alias("group_id"), F.floor(j / 4).cast("int").alias("page"), c.alias("route_id"), (c % 2 + 1).alias("direction"), cats.alias("categories"), F.when((c + j) % 3 == 0, "hour_minute").otherwise("interval").alias("layout"),
        ((c * 7 + j) % 11 != 0).alias("valid"), departures.alias("departures"), periods.alias("periods"), F.when((c % 19 == 0) & (j < 4), "older_than_official").alias("reason"),
    )
    feed = {"trips": trips.drop("__o"), "stop_times": stop_times, "calendar": cal, "calendar_dates": ex, "frequencies": trips.limit(0).select("trip_id", F.lit(0).alias("start_s"), F.lit(0).alias("end_s"), F.lit(0).alias("headway_secs"), F.lit(0).alias("exact_times"))}
    return schedule_merge.merge(feed, g, _days(spark), F.lit(START), F.lit(END))


@register("d5_merged_dates", f"""WITH {_FEED}
SELECT 'old' AS side, trip_id::VARCHAR AS trip_id, count(*) AS days, min(a.date) AS first_day, max(a.date) AS last_day FROM trips t JOIN active a USING (service_id) WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.route_id = t.route_id AND l.direction = t.direction AND l.date = a.date) GROUP BY trip_id
UNION ALL SELECT 'new', 'PUBLISHED:' || route_id || ':' || direction || ':' || j || ':' || i, count(*), min(date), max(date) FROM (SELECT route_id, direction, j, date, unnest(range(CASE WHEN banded > 0 THEN 2 ELSE listed END)) AS i FROM r JOIN days USING (category) WHERE k = 1) GROUP BY route_id, direction, j, i""")
def d5_merged_dates(spark, d):
    """On which dates every trip of the merged feed runs, old ones and new ones."""
    out = _feed(spark, d)
    runs = calendar.service_dates(out["calendar"], out["calendar_dates"], F.lit(START), F.lit(END))
    side = F.when(F.startswith("trip_id", F.lit("PUBLISHED:")), "new").otherwise("old")
    return out["trips"].join(runs, "service_id").groupBy(side.alias("side"), "trip_id").agg(F.count("*").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@register("d5_merge_refused", f"WITH {_FEED} SELECT route_id, direction, category, page, j::VARCHAR AS group_id, CASE WHEN k > 1 THEN 'date_already_covered' ELSE reason END AS reason FROM r WHERE k IS NULL OR k > 1")
def d5_merge_refused(spark, d):
    return _feed(spark, d)["refused"].select("route_id", "direction", "category", "page", "group_id", "reason")


@register("d5_merged_times", f"""WITH {_FEED}, n AS (SELECT DISTINCT route_id, direction, j, listed, banded FROM r WHERE k = 1 AND category IN (SELECT category FROM days)),
s AS (SELECT *, unnest(CASE WHEN banded > 0 THEN [21600, 36000] ELSE [i * 1800 + 20000 FOR i IN range(1, listed + 1)] END) AS s FROM n)
SELECT route_id, direction, j::VARCHAR AS group_id, count(*) * 3 AS visits, min(s)::BIGINT AS first_s, (max(s) + 600)::BIGINT AS last_s, (CASE WHEN max(banded) > 0 THEN 2 ELSE 0 END)::BIGINT AS bands FROM s GROUP BY 1, 2, 3""")
def d5_merged_times(spark, d):
    """Stop times and bands of the new trips."""
    out = _feed(spark, d)
    new = out["trips"].where("trip_id LIKE 'PUBLISHED:%'").select("trip_id", "route_id", "direction", F.split("trip_id", ":")[3].alias("group_id"))
    times = new.join(out["stop_times"], "trip_id").groupBy("route_id", "direction", "group_id").agg(F.count("*").alias("visits"), F.min("arrival_s").cast("bigint").alias("first_s"), F.max("departure_s").cast("bigint").alias("last_s"))
    bands = new.join(out["frequencies"], "trip_id").groupBy("route_id", "direction", "group_id").agg(F.count("*").alias("bands"))
    return times.join(bands, ["route_id", "direction", "group_id"], "left").withColumn("bands", F.coalesce("bands", F.lit(0).cast("bigint")))


@register("d5_services", f"""WITH {_FEED}, o AS (SELECT route_id, direction, service_id, string_agg(a.date::VARCHAR, ',' ORDER BY a.date) AS gone FROM (SELECT DISTINCT route_id, direction, service_id FROM trips) t JOIN active a USING (service_id) JOIN lost USING (route_id, direction, date) GROUP BY 1, 2, 3)
SELECT service_id::VARCHAR AS service_id, count(DISTINCT gone) AS clones FROM o GROUP BY 1""")
def d5_services(spark, d):
    """Clones of each old service: one for each set of dates that some of its trips lose."""
    out = _feed(spark, d)
    return out["calendar"].where("service_id LIKE 'RETAIN:%'").groupBy(F.split("service_id", ":")[1].alias("service_id")).agg(F.count("*").alias("clones"))


# Rail records: line items speak of a part's path; suppliers are the baseline.
_RAIL = f"""{_DAYS},
rec AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey AS path, CASE l_orderkey % 3 WHEN 0 THEN [0, 1, 2, 3, 4] WHEN 1 THEN [5, 6] ELSE [6, 7] END AS cats, CASE WHEN l_linenumber % 3 = 0 THEN 'departure' ELSE 'frequency' END AS kind, (l_orderkey * 13 + l_linenumber * 7) % 1000 * 80 + 18000 AS s, (l_suppkey % 5 + 1) * 1500 AS len, (l_suppkey % 6 + 2) * 60 AS h, l_orderkey % 31 = 0 AS mixed FROM lineitem),
e AS (SELECT id, path, kind, s, CASE WHEN kind = 'frequency' THEN s + len END AS e, h, mixed, unnest(cats) AS category FROM rec),
bad AS (SELECT x.id, x.category, CASE WHEN x.mixed THEN 'mixed_service' WHEN x.kind = 'frequency' AND EXISTS (SELECT 1 FROM e y WHERE y.path = x.path AND y.category = x.category AND y.id <> x.id AND y.kind = 'frequency' AND y.s < x.e AND x.s < y.e) THEN 'overlapping_bands'
 WHEN x.kind = 'frequency' AND EXISTS (SELECT 1 FROM e y WHERE y.path = x.path AND y.category = x.category AND y.kind = 'departure' AND x.s <= y.s AND y.s < x.e) THEN 'departure_in_band' WHEN x.kind = 'departure' AND EXISTS (SELECT 1 FROM e y WHERE y.path = x.path AND y.category = x.category AND y.kind = 'frequency' AND y.s <= x.s AND x.s < y.e) THEN 'departure_in_band' END AS reason FROM e x),
j AS (SELECT e.*, reason FROM e JOIN bad USING (id, category)), good AS (SELECT * FROM j WHERE reason IS NULL)"""
_LAYERED = f"""{_RAIL}, base AS (SELECT p_partkey AS path, 19000 + p_partkey % 10 * 100 AS lo, 90000 + p_partkey % 7 * 100 AS hi, (p_partkey % 4 + 4) * 120 AS h, p_partkey % 2 = 0 AS gaps FROM part WHERE p_partkey % 5 <> 0),
touched AS (SELECT DISTINCT path, category FROM e), cover AS (SELECT path, category, s AS a, e AS b FROM good WHERE kind = 'frequency' UNION ALL SELECT path, category, min(s), max(s) + 1 FROM good WHERE kind = 'departure' GROUP BY 1, 2),
wanted AS (SELECT path, category, lo, hi, h FROM base JOIN touched USING (path) WHERE gaps UNION ALL SELECT base.path, category, greatest(lo, s), least(hi, coalesce(e, s + 1)), base.h FROM base JOIN j USING (path) WHERE NOT gaps AND reason IS NOT NULL AND greatest(lo, s) < least(hi, coalesce(e, s + 1))),
cut AS (SELECT path, category, unnest([lo, hi]) AS x FROM wanted UNION SELECT path, category, unnest([a, b]) FROM cover), span AS (SELECT path, category, x AS lo, lead(x) OVER (PARTITION BY path, category ORDER BY x) AS hi FROM cut),
fill AS (SELECT s.path, s.category, s.lo, s.hi, max(w.h) AS h FROM span s JOIN wanted w ON w.path = s.path AND w.category = s.category AND w.lo <= s.lo AND s.hi <= w.hi WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.path = s.path AND c.category = s.category AND c.a <= s.lo AND s.hi <= c.b) GROUP BY 1, 2, 3, 4),
fm AS (SELECT *, CASE WHEN lo = lag(hi) OVER (PARTITION BY path, category ORDER BY lo) THEN 0 ELSE 1 END AS fresh FROM fill), fn AS (SELECT *, sum(fresh) OVER (PARTITION BY path, category ORDER BY lo) AS i FROM fm),
rows_ AS (SELECT path, category, 'listed_departure' AS origin, s AS start_s, s + 1 AS end_s, 0 AS headway_s FROM good WHERE kind = 'departure' UNION SELECT path, category, 'published_interval', s, e, h FROM good WHERE kind = 'frequency'
 UNION SELECT path, category, 'retained_fallback', min(lo), max(hi), max(h) FROM fn GROUP BY path, category, i)"""


def _rail(spark, d):
    o, i, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p_partkey")
    ints = lambda x: F.array(*[F.lit(v) for v in x])
    start = (o * 13 + i * 7) % 1000 * 80 + 18000
    often = i % 3 != 0
    # copies go while rows are narrow, and by path, where all the rest is done
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_partkey").distinct()
    records = lines.select(
        F.concat_ws("-", o, i, "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("path"), F.when(o % 3 == 0, ints([0, 1, 2, 3, 4])).when(o % 3 == 1, ints([5, 6])).otherwise(ints([6, 7])).alias("categories"), F.when(often, "frequency").otherwise("departure").alias("kind"),
        start.alias("start_s"), F.when(often, start + (F.col("l_suppkey") % 5 + 1) * 1500).alias("end_s"), ((F.col("l_suppkey") % 6 + 2) * 60).alias("headway_s"), (o % 31 == 0).alias("mixed"),
    )
    base = t(spark, d, "part").where(p % 5 != 0).select(p.alias("path"), (p % 10 * 100 + 19000).alias("start_s"), (p % 7 * 100 + 90000).alias("end_s"), ((p % 4 + 4) * 120).alias("headway_s"), (p % 2 == 0).alias("gaps"))
    return layers.rail_schedule(records, base, schedule_merge.categories(F.lit(START), F.lit(END), _days(spark)))


@register("d10_rail_bands", f"""WITH {_LAYERED} SELECT path, origin, start_s::BIGINT AS start_s, end_s::BIGINT AS end_s, headway_s::BIGINT AS headway_s, count(DISTINCT date) AS days FROM rows_ JOIN days USING (category) GROUP BY 1, 2, 3, 4, 5""")
def d10_rail_bands(spark, d):
    """Published records over the baseline, equal bands once, with the number of dates they run on."""
    return _rail(spark, d)[0].select("path", "origin", "start_s", "end_s", "headway_s", "days")


@register("d10_rail_refused", f"WITH {_RAIL} SELECT id, path, category, reason FROM j WHERE reason IS NOT NULL")
def d10_rail_refused(spark, d):
    return _rail(spark, d)[2]
