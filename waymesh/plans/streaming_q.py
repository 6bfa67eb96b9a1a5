"""Time-window, freshness and streaming queries."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.streaming import arrivals, keyed

from .catalogue import register
from .tables import EVENT_S, events, shared_folder, t


@register("x_windows", """
SELECT 'tumbling' AS kind, strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 2, 3
UNION ALL SELECT 'sliding', strftime(w, '%Y-%m-%d %H:%M:%S'), event_type, count(*) FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 2, 3""")
def x_windows(spark, d):
    e = t(spark, d, "events")
    text = F.date_format("start", "yyyy-MM-dd HH:mm:ss")
    a = arrivals.tumbling(e, "ts", "1 hour", ["event_type"]).select(F.lit("tumbling").alias("kind"), text.alias("start"), "event_type", "n")
    b = arrivals.sliding(e, "ts", "2 hours", "1 hour", ["event_type"]).select(F.lit("sliding").alias("kind"), text.alias("start"), "event_type", "n")
    return a.union(b)


@register("x_sessions", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id""")
def x_sessions(spark, d):
    s = arrivals.sessions(t(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@register("x_profile", """
SELECT (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def x_profile(spark, d):
    return t(spark, d, "events").groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("x_dedup", """
WITH e AS (SELECT user_id, event_type, ts, date_diff('second', TIMESTAMP '2024-01-15 00:00:00', date_trunc('second', ts)) AS s FROM events), f AS (SELECT * FROM e WHERE s BETWEEN -30 AND 10800),
u AS (SELECT user_id, event_type, max(s) AS s FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_type) AS place FROM u)
SELECT user_id, place::INTEGER AS place, event_type, s FROM r WHERE place <= 3""")
def x_dedup(spark, d):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-15 00:00:00', date_trunc('SECOND', ts))")
    live = t(spark, d, "events").select("user_id", "event_type", s.alias("s")).where(F.col("s").between(*arrivals.HORIZON))
    last = live.groupBy("user_id", "event_type").agg(F.max("s").alias("s"))
    w = Window.partitionBy("user_id").orderBy("s", "event_type")
    return last.withColumn("place", F.row_number().over(w)).where("place <= 3").select("user_id", "place", "event_type", "s")


@register("x_freshness", f"""
WITH r AS (SELECT event_id, {EVENT_S} AS now, {EVENT_S} - (event_id % 200) AS gen, {EVENT_S} - (event_id % 500) AS upd, {EVENT_S} + (event_id % 12000) - 60 AS eta, event_id % 9 = 0 AS other FROM events)
SELECT CASE WHEN now - gen > 120 THEN 'stale_payload' WHEN now - upd > 300 THEN 'stale_record' WHEN other THEN 'other_service' WHEN eta - now < -30 OR eta - now > 10800 THEN 'out_of_horizon' ELSE 'live' END AS status, count(*) AS n FROM r GROUP BY 1""")
def x_freshness(spark, d):
    e = events(spark, d)
    at = lambda c: F.timestamp_seconds(c + 1_704_067_200)
    k = F.col("event_id")
    rows = e.select(
        "event_id", F.lit("kmb").alias("operator"), F.when(k % 9 == 0, "X").otherwise("1").alias("route"), F.lit("O").alias("direction"), F.lit(None).cast("string").alias("service_type"), F.lit(1).alias("seq"),
        F.lit("1").alias("want_route"), F.lit("O").alias("want_direction"), F.lit(1).alias("want_seq"), F.lit(None).cast("string").alias("want_service_type"),
        at(F.col("s") - k % 200).alias("generated"), at(F.col("s") - k % 500).alias("updated"), at(F.col("s") + k % 12_000 - 60).alias("eta"), at(F.col("s")).alias("now"),
    )
    return arrivals.judged(rows, F.col("now")).groupBy("status").agg(F.count("*").alias("n"))


@register("x_stream_equal")
def x_stream_equal(spark, d):
    """Daily counts of a file stream driven to its end, next to the same plan run as a batch."""
    from waymesh.operators.quality import same_rows

    batch = t(spark, d, "events")
    # the stream source wants a folder; a glob lets it take one file
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    daily = lambda e: arrivals.tumbling(e.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", ["event_type"])
    want = daily(batch)
    name = f"stream_{uuid.uuid4().hex}"
    where = shared_folder(spark, name)
    got = arrivals.run_available(daily(stream), name, "complete", where)
    return same_rows(want, got)


def _in_files(spark, d, name, frame, parts: int):
    """frame (with a column `part`) as a stream over files, one a batch, in the order of the parts."""
    path = shared_folder(spark, name)
    for k in range(parts):
        frame.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@register("x5_stale_cache", f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ns(ts) // 1000000 AS ms, {EVENT_S} // 864000 AS part FROM events), q AS (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS following FROM (SELECT DISTINCT user_id, ms FROM e)),
f(user_id, ms) AS (SELECT user_id, min(ms) FROM e GROUP BY 1 UNION ALL SELECT f.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = f.user_id AND e.ms >= f.ms + 7200000) FROM f WHERE f.ms IS NOT NULL)
SELECT e.user_id, e.event_id, e.ms - f.ms AS age_ms, NOT (e.ms = f.ms AND e.event_id = (SELECT min(x.event_id) FROM e x WHERE x.user_id = e.user_id AND x.ms = e.ms)) AS hit FROM e ASOF JOIN (SELECT * FROM f WHERE ms IS NOT NULL) f ON e.user_id = f.user_id AND e.ms >= f.ms""")
def x5_stale_cache(spark, d):
    """Requests of each user against an answer that serves two hours, over four batches; state is kept between them."""
    e = t(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    part = F.least(F.lit(3), F.floor((F.unix_timestamp("at") - 1_704_067_200) / 864_000)).cast("int")
    stream = _in_files(spark, d, "requests", e.withColumn("part", part), 4)
    found = keyed.cached(stream, ["user_id"], "at", "event_id", 7200)
    got = keyed.run_to_end(found, shared_folder(spark, "hits"), shared_folder(spark, "hits-state"))
    return got.select("user_id", "event_id", "age_ms", "hit")


@register("x7_progress_log", """
WITH s AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id, seq FROM s WHERE seq > n // 2 + length(event_type)""")
def x7_progress_log(spark, d):
    """Entries of each kind numbered over four batches, read from a cursor in the middle of each log."""
    e = t(spark, d, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("at"))
    part = F.least(F.lit(3), F.floor((F.unix_timestamp("at") - 1_704_067_200) / 864_000)).cast("int")
    stream = _in_files(spark, d, "progress", e.withColumn("part", part), 4)
    log = keyed.run_to_end(keyed.appended(stream, ["event_type"], ["at", "event_id"]), shared_folder(spark, "log"), shared_folder(spark, "log-state"))
    cursors = e.groupBy("event_type").agg((F.floor(F.count("*") / 2) + F.length("event_type")).alias("seq"))
    return keyed.since(log, cursors, ["event_type"]).select("event_type", "event_id", "seq")
