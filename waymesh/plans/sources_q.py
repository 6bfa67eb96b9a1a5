"""Queries of sources: archives written and read back by the data source."""
from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from waymesh.sources import archives, grammars, rebuild

from .catalogue import register
from .tables import shared_folder, t

_TIMES = "trip_id string, stop_id string, stop_sequence int, fare double"


def _written(spark, d, stored: bool):
    """Line items as stop times of trips, in archives of eight operators' trips; the more rows, the more archives of an operator."""
    archives.register(spark)
    path = shared_folder(spark, "feeds")
    times = t(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_partkey").cast("string").alias("stop_id"), F.col("l_linenumber").cast("int").alias("stop_sequence"), F.col("l_quantity").cast("double").alias("fare"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit('a "quoted", name')).alias("headsign"), (F.col("l_suppkey") % 8).alias("operator"),
    )
    times.repartition("operator", F.pmod(F.hash("trip_id"), F.lit(256))).drop("operator").write.format(archives.NAME).option("member", "stop_times.txt").option("stored", stored).mode("append").save(path)
    return path


def _read(spark, path: str, schema: str, member: str = "stop_times.txt"):
    return spark.read.format(archives.NAME).schema(schema).option("member", member).option("splitBytes", 1 << 17).load(path)


@register("s1_feed_source", "SELECT l_orderkey::VARCHAR AS trip_id, l_linenumber::INTEGER AS stop_sequence, CASE WHEN l_orderkey % 3 = 0 THEN 'a \"quoted\", name' END AS headsign, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 AND l_orderkey % 3 = 0 GROUP BY 1, 2, 3")
def s1_feed_source(spark, d):
    """Three of five columns of deflated archives, in ranges of bytes, with two filters pushed into the source."""
    rows = _read(spark, _written(spark, d, False), "trip_id string, stop_sequence int, headsign string")
    return rows.where((F.col("stop_sequence") >= 3) & F.col("headsign").isNotNull()).groupBy("trip_id", "stop_sequence", "headsign").agg(F.count("*").alias("n"))


@register("s3_feed_stored", "SELECT l_partkey::VARCHAR AS stop_id, count(*) AS n, sum(l_linenumber)::BIGINT AS sequences, round(sum(l_quantity::DOUBLE), 4) AS fares FROM lineitem GROUP BY 1")
def s3_feed_stored(spark, d):
    """Stored archives, entered at each range's own offset; a column that no archive has is null."""
    rows = _read(spark, _written(spark, d, True), _TIMES + ", zone string")
    return rows.where("zone IS NULL").groupBy("stop_id").agg(F.count("*").alias("n"), F.sum("stop_sequence").alias("sequences"), F.round(F.sum("fare"), 4).alias("fares"))


def _builds(spark, d):
    """Line items in parts by supplier, built, changed in three parts, and built again."""
    rows = t(spark, d, "lineitem").select((F.col("l_suppkey") % 16).cast("string").alias("part"), "l_partkey", "l_linenumber", "l_quantity", "l_tax")
    p = F.col("part")
    after = rows.where(p != "5").withColumns({"l_quantity": F.when((p == "7") & (F.col("l_linenumber") == 1), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")), "l_tax": F.when(p == "3", F.col("l_tax") + 1).otherwise(F.col("l_tax"))})
    # the first stage does not read taxes, so the second is left alone where only these change
    sums = rebuild.Stage("sums", ("lines",), lambda x: x["lines"].groupBy("part", "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(20,2)")).alias("quantity"), F.count("*").alias("n")))
    most = rebuild.Stage("most", ("sums",), lambda x: x["sums"].groupBy("part").agg(F.max("quantity").cast("double").alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")))
    store = rebuild.Store(spark, shared_folder(spark, "store"))
    first, _ = rebuild.rebuild(store, {"lines": rows}, [sums, most])
    second, report = rebuild.rebuild(store, {"lines": after}, [sums, most])
    return store, most, first, second, report


@register("u3_rebuilt_parts", """
WITH l AS (SELECT (l_suppkey % 16)::VARCHAR AS part, l_partkey, l_quantity + CASE WHEN l_suppkey % 16 = 7 AND l_linenumber = 1 THEN 1 ELSE 0 END AS q FROM lineitem WHERE l_suppkey % 16 <> 5),
s AS (SELECT part, l_partkey, sum(q::DECIMAL(20, 2)) AS quantity, count(*) AS n FROM l GROUP BY 1, 2)
SELECT part, max(quantity)::DOUBLE AS most, sum(n)::BIGINT AS n, count(*) AS parts, part = '7' AS fresh FROM s GROUP BY part""")
def u3_rebuilt_parts(spark, d):
    """The last stage after the second build, and which of its parts that build wrote."""
    store, most, _, second, _ = _builds(spark, d)
    rows = store.read(most, "part string, most double, n bigint, parts bigint")
    fresh = store.manifest().where(F.col("stage") == most.mark).select("part", (F.col("version") == second).alias("fresh"))
    return rows.join(fresh, "part")


@register("d25_rebuild_report", """
SELECT * FROM (VALUES ('sums', '3', 'same'), ('sums', '5', 'removed'), ('sums', '7', 'changed'), ('most', '5', 'removed'), ('most', '7', 'changed')) r(stage, part, change) WHERE part IN (SELECT (l_suppkey % 16)::VARCHAR FROM lineitem)""")
def d25_rebuild_report(spark, d):
    """What the second build recomputed, and what came of it."""
    return _builds(spark, d)[4]


@register("d8_hour_minutes", """
WITH e AS (SELECT user_id, 'day ' || (isodow(ts) - 1) AS day, hour(ts) AS h, minute(ts) AS m, CASE WHEN event_type = 'click' THEN 'x' WHEN event_type = 'error' THEN '?' END AS mark FROM events), b AS (SELECT DISTINCT * FROM e)
SELECT user_id, day, ((h + CASE WHEN h < 3 THEN 24 ELSE 0 END) * 3600 + m * 60)::INTEGER AS start_s, CASE mark WHEN 'x' THEN 'express' END AS branch, NULL AS reason FROM b WHERE coalesce(mark, '') <> '?' AND NOT (user_id % 7 = 0 AND h = 5)
UNION ALL SELECT user_id, day, NULL, NULL, 'unknown_mark' FROM b WHERE mark = '?' AND NOT (user_id % 7 = 0 AND h = 5) UNION ALL SELECT DISTINCT user_id, day, NULL::INTEGER, NULL, 'unread_minutes' FROM b WHERE user_id % 7 = 0 AND h = 5""")
def d8_hour_minutes(spark, d):
    """Hour-and-minute grids made of the events of each user, read back: headings of days, marks, and cells that cannot be read."""
    e = t(spark, d, "events").select("user_id", F.weekday("ts").alias("w"), F.hour("ts").alias("h"), F.concat(F.minute("ts").cast("string"), F.when(F.col("event_type") == "click", "x").when(F.col("event_type") == "error", "?").otherwise("")).alias("m"))
    cell = F.array_join(F.array_sort(F.collect_set("m")), ", ")
    rows = e.groupBy("user_id", "w", "h").agg(F.when((F.col("user_id") % 7 == 0) & (F.col("h") == 5), "see note").otherwise(cell).alias("m"))
    name = F.concat(F.lit("day "), F.col("w").cast("string"))
    days = rows.groupBy("user_id", "w").agg(F.array_sort(F.collect_list(F.struct("h", "m"))).alias("x"))
    body = F.concat(F.array(F.array(name, name)), F.transform("x", lambda x: F.array(x["h"].cast("string"), x["m"])))
    pages = days.select("user_id", "w", body.alias("b")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("all"))
    head = F.array(F.array(F.lit("Hour"), F.lit("Minutes")))
    tables = pages.select("user_id", F.concat(head, F.flatten(F.transform("all", lambda x: x["b"]))).alias("grid"))
    marked = dataclasses.replace(grammars.HOUR_MINUTE, legend={"x": "express"})
    return grammars.records(tables, [grammars.HEADWAY, marked], ["user_id"]).select("user_id", "day", "start_s", "branch", "reason")


@register("d9_branch_headways", """
WITH s AS (SELECT o_orderkey AS k, j, o_custkey AS c FROM orders, range(3) r(j))
SELECT k AS page, 'Weekdays' AS day, CASE b WHEN 0 THEN 'A' ELSE 'B' END AS branch, (j * 8 * 3600)::INTEGER AS start_s, ((j + 1) * 8 * 3600)::INTEGER AS end_s, ((c % 5 + j + b + 1) * 60)::INTEGER AS low_s, ((c % 5 + j + b + 1 + k % 3) * 60)::INTEGER AS high_s, NULL AS reason FROM s, range(2) r(b) WHERE NOT (k % 6 = 1 AND b = 1) AND NOT (k % 11 = 4 AND j = 1)
UNION ALL SELECT k, 'Weekdays', NULL, NULL, NULL, NULL, NULL, 'unread_period' FROM s WHERE k % 11 = 4 AND j = 1 UNION ALL SELECT k, 'Weekdays', NULL, NULL, NULL, NULL, NULL, 'unread_headway' FROM s WHERE k % 6 = 1 AND NOT (k % 11 = 4 AND j = 1)""")
def d9_branch_headways(spark, d):
    """Headway tables with a column for each branch: ranges, periods over midnight, cells that cannot be read."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")

    def row(j: int):
        clock = lambda h: f"{h % 24:02d}:00"
        period = F.when((k % 11 == 4) & F.lit(j == 1), "rush hours").otherwise(f"{clock(8 * j)} - {clock(8 * j + 8)}")
        low = [c % 5 + j + b + 1 for b in (0, 1)]
        cells = [F.when(k % 3 == 0, text(x)).otherwise(F.concat(text(x), F.lit("-"), text(x + k % 3))) for x in low]
        return F.array(period, cells[0], F.when(k % 6 == 1, "often").otherwise(cells[1]))

    title, day = (F.array(*[F.lit(x)] * 3) for x in ("Line", "Weekdays"))
    head = F.array(F.lit("Period"), F.lit("Every A"), F.lit("Headway B"))
    tables = t(spark, d, "orders").select(k.alias("page"), F.array(title, head, day, row(0), row(1), row(2)).alias("grid"))
    return grammars.records(tables, [grammars.HOUR_MINUTE, grammars.HEADWAY], ["page"]).select("page", "day", "branch", "start_s", "end_s", "low_s", "high_s", "reason")
