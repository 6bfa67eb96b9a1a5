"""Function-library queries: clocks, geometry, text, hashes, JSON, polylines, sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from waymesh.functions import clock, geo, structs, text
from waymesh.sources import html, state

from .catalogue import register
from .tables import EVENT_S, event_seconds, events, t


@register("f_time", f"""
WITH e AS (SELECT event_id, ts, {EVENT_S} % 129600 AS s, value FROM events)
SELECT event_id, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS clock, s::INTEGER AS seconds, round_even(value * 60, 0)::INTEGER AS minutes_s, (isodow(ts) - 1)::INTEGER AS weekday,
CASE WHEN day(ts) IN (1, 22) THEN 7 ELSE isodow(ts) - 1 END::INTEGER AS category, greatest(0, ceil((s - 43200) / 60.0))::INTEGER AS wait_min,
(isodow(ts) <= 5 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND day(ts) <> 10) OR day(ts) = 28 AS active FROM e""")
def f_time(spark, d):
    s = F.col("s") % 129_600
    day = F.col("ts").cast("date")
    bits = [F.lit(1)] * 5 + [F.lit(0)] * 2
    exception = F.when(F.dayofmonth("ts") == 28, 1).when(F.dayofmonth("ts") == 10, 2)
    return events(spark, d).select(
        "event_id", clock.clock(s).alias("clock"), clock.seconds(clock.clock(s)).alias("seconds"), clock.minutes_to_seconds(F.col("value")).alias("minutes_s"), F.weekday("ts").alias("weekday"),
        clock.day_category(day, F.dayofmonth("ts").isin(1, 22)).alias("category"), clock.wait_minutes(s - 43_200).alias("wait_min"),
        clock.active_on(day, bits, F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"), exception).alias("active"),
    )


_LATLON = "(SELECT vec_id, 22.2 + (embedding[1]::DOUBLE + 1) * 0.1 AS lat1, 113.9 + (embedding[2]::DOUBLE + 1) * 0.1 AS lon1, 22.2 + (embedding[3]::DOUBLE + 1) * 0.1 AS lat2, 113.9 + (embedding[4]::DOUBLE + 1) * 0.1 AS lon2 FROM embeddings)"


@register("f_geo", f"""
WITH p AS {_LATLON}, q AS (SELECT *, 2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))) AS h,
sqrt(power((lat2 - lat1) * 111195.0, 2) + power((lon2 - lon1) * 111195.0 * cos(radians(lat1)), 2)) AS f FROM p)
SELECT vec_id, round(h, 3) AS haversine, round(f, 3) AS flat, round(6371000.0 * sqrt(power(radians(lat2 - lat1), 2) + power(radians(lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2)), 3) AS flat_mean,
floor(lat1 / 0.005)::BIGINT AS cell_y, greatest(10, round_even(f / 10, 0) * 10)::INTEGER AS tens, greatest(45, round_even(f * 1.25 / (18 / 3.6) + 20, 0))::INTEGER AS run_s, greatest(1, ceil(f / 0.6))::INTEGER AS stairs_s,
(f <= 100 OR (f / 600 * 3.6 BETWEEN 1 AND 100)) AS speed_ok, lat1 BETWEEN 22.1 AND 22.6 AND lon1 BETWEEN 113.8 AND 114.5 AS inside FROM q""")
def f_geo(spark, d):
    e = t(spark, d, "embeddings")
    at = lambda i, base: base + (F.col("embedding")[i].cast("double") + 1) * 0.1
    p = e.select("vec_id", at(0, 22.2).alias("lat1"), at(1, 113.9).alias("lon1"), at(2, 22.2).alias("lat2"), at(3, 113.9).alias("lon2"))
    four = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    flat = geo.flat_metres(*four)
    return p.select(
        "vec_id", F.round(geo.haversine(*four), 3).alias("haversine"), F.round(flat, 3).alias("flat"), F.round(geo.flat_metres_mean(*four), 3).alias("flat_mean"), geo.cell(F.col("lat1")).alias("cell_y"),
        geo.round_ten(flat).alias("tens"), geo.running_seconds(flat).alias("run_s"), geo.edge_seconds(F.lit("stairs"), flat, F.lit(0.0)).alias("stairs_s"), geo.speed_ok(flat, F.lit(600)).alias("speed_ok"), geo.inside(F.col("lat1"), F.col("lon1")).alias("inside"),
    )


@register("f_text", r"""
SELECT p_partkey, lower(regexp_replace(p_name || ' (Circular)', '(?i)\(?\s*(circular|循環線?)\s*\)?|[^0-9A-Za-z_一-鿿]', '', 'g')) AS identity, regexp_replace(lower('MTR ' || p_name), '^(mtr|light rail|港鐵|輕鐵)\s*', '') AS spaced,
trim(regexp_replace('  ' || p_name || '   x ', '\s+', ' ', 'g')) AS one_space, (p_size % 20 + 1)::VARCHAR || '-' || (p_size % 20 + 3)::VARCHAR AS wording, ((p_size % 20 + 1) * 60)::INTEGER AS low, ((p_size % 20 + 3) * 60)::INTEGER AS high, 'range' AS kind,
'RAIL' || p_partkey AS station, 'x:' || p_partkey AS unscoped, contains(replace(lower(p_name), ' ', ''), 'ring') AND contains(replace(lower(p_name), ' ', ''), 's') AS tokens, p_type || ' · ' || p_brand AS joined FROM part""")
def f_text(spark, d):
    part = t(spark, d, "part")
    wording = F.concat_ws("-", (F.col("p_size") % 20 + 1).cast("string"), (F.col("p_size") % 20 + 3).cast("string"))
    key = F.col("p_partkey").cast("string")
    return part.select(
        "p_partkey", text.identity_key(F.concat("p_name", F.lit(" (Circular)"))).alias("identity"), F.regexp_replace(F.lower(F.concat(F.lit("MTR "), "p_name")), r"^(mtr|light rail|港鐵|輕鐵)\s*", "").alias("spaced"),
        text.one_space(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("one_space"), wording.alias("wording"), text.interval(wording)["low"].alias("low"), text.interval(wording)["high"].alias("high"), text.interval(wording)["kind"].alias("kind"),
        text.station_of(F.concat(F.lit("feed:RAIL:MTR:RAIL"), key, F.lit(":TWL"))).alias("station"), text.unscoped(F.concat(F.lit("feed:x:"), key)).alias("unscoped"), text.all_tokens(F.col("p_name"), F.lit("RING s")).alias("tokens"),
        text.joined(F.array("p_type", F.lit(None).cast("string"), "p_brand", "p_type", F.lit(" "))).alias("joined"),
    )


@register("f_text_nfkc", "SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, md5(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM documents")
def f_text_nfkc(spark, d):
    return t(spark, d, "documents").select("doc_id", text.compact(F.col("text")).alias("c")).select("doc_id", F.length("c").cast("bigint").alias("n"), F.md5("c").alias("digest"))


@register("f_hash", """
WITH p AS (SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, substr(sha256('["R' || l_orderkey || '", ["' || array_to_string(ids, '", "') || '"]]'), 1, 20) AS pattern_key, substr(sha256(array_to_string(ids, ',')), 1, 8) AS short, 'RAIL:TWL:' || l_orderkey || '>' || ids[1] AS edge FROM p""")
def f_hash(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("s")).select("l_orderkey", F.transform("s", lambda x: x["l_suppkey"].cast("string")).alias("ids"))
    order = F.col("l_orderkey").cast("string")
    return p.select("l_orderkey", structs.pattern_key(F.concat(F.lit("R"), order), F.col("ids")).alias("pattern_key"), structs.short_hash(F.array_join("ids", ","), 8).alias("short"), structs.edge_key(F.lit("RAIL"), F.lit("TWL"), F.concat(F.lit("0"), order), F.col("ids")[0]).alias("edge"))


@register("f_json", """
WITH e AS (SELECT event_id, (props->>'k')::BIGINT AS k, event_type FROM events)
SELECT event_id, k, k * 2 AS doubled, event_type || ':' || k AS decoded, CASE WHEN k % 3 = 0 THEN 'zero width' WHEN k % 5 = 0 THEN 'interval out of range' END AS error, CASE WHEN k % 7 = 0 THEN NULL ELSE k + 1 END AS nested, k >= 2 AS ordered FROM e""")
def f_json(spark, d):
    e = t(spark, d, "events").withColumn("k", F.variant_get(F.parse_json("props"), "$.k", "bigint"))
    b64 = F.base64(F.concat(F.lit('{"id":"'), "event_type", F.lit('","n":'), F.col("k").cast("string"), F.lit("}")).cast("binary"))
    got = structs.base64_json(b64, "id string, n bigint")
    end = F.when(F.col("k") % 3 == 0, F.col("k")).otherwise(F.col("k") + 600)
    row = structs.headway(F.col("k"), end, F.when(F.col("k") % 5 == 0, F.lit(0)).otherwise(F.lit(300)), F.lit(None).cast("int"))
    map_ = F.create_map(F.lit("a"), F.create_map(F.when(F.col("k") % 7 == 0, F.lit("other")).otherwise(F.lit("b")), F.col("k") + 1))
    numbers = F.sequence(F.lit(1), F.least(F.col("k"), F.lit(9)).cast("int"))
    return e.select("event_id", "k", (F.variant_get(F.parse_json("props"), "$.k", "bigint") * 2).alias("doubled"), F.concat_ws(":", got["id"], got["n"].cast("string")).alias("decoded"), row["error"].alias("error"), structs.nested(map_, F.lit("a"), F.lit("b")).alias("nested"), F.when(F.col("k") >= 1, structs.ordered_from_one(numbers)).otherwise(F.lit(False)).alias("ordered"))


_CODES = "array_to_string(list_transform([(lat, 1), (lon, 2)], lambda x: x), '')"


@register("f_polyline")
def f_polyline(spark, d):
    """Lines of three points made from keys, encoded as characters by expressions and decoded again."""
    p = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1000 + 1).alias("a"), (F.col("p_size") * 7 + 3).alias("b"))
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.char(F.call_function("shiftright", v.cast("int"), (i * 5).cast("int")).bitwiseAND(31) + F.when(i < 3, 32).otherwise(0) + 63))
    encoded = F.array_join(F.concat(chunks(F.col("a") * 2), chunks(F.col("b") * 2), chunks(F.col("b") * 2), chunks(F.col("a") * 2)), "")
    line = geo.decode_polyline(encoded)
    got = p.select("p_partkey", "a", "b", line.alias("line"))
    return got.select("p_partkey", F.size("line").alias("n"), F.round(F.col("line")[0]["lat"] * 1e5, 0).cast("bigint").alias("lat0"), F.round(F.col("line")[1]["lat"] * 1e5, 0).cast("bigint").alias("lat1"), F.round(F.col("line")[1]["lon"] * 1e5, 0).cast("bigint").alias("lon1"))


from .catalogue import _ORACLES  # noqa: E402

_ORACLES["f_polyline"] = "SELECT p_partkey, 2::INTEGER AS n, p_partkey % 1000 + 1 AS lat0, p_partkey % 1000 + 1 + p_size * 7 + 3 AS lat1, p_size * 7 + 3 + p_partkey % 1000 + 1 AS lon1 FROM part"


@register("s15_html", r"""
SELECT page_id, len(regexp_extract_all(html, '<a\s')) AS n_links, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, length(html) AS n_html FROM pages""")
def s15_html(spark, d):
    pages = t(spark, d, "pages")
    got = html.articles(pages.select("page_id", "html"), "page_id", "html")
    return got.select("page_id", F.size("links").cast("bigint").alias("n_links"), "lang", F.col("n_html").cast("bigint").alias("n_html"))


@register("s42_cache_miss", """
WITH c AS (SELECT DISTINCT sha256('{"o":' || o_custkey || ',"s":"' || o_orderstatus || '"}') AS key FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT o_orderkey, sha256('{"o":' || o_custkey || ',"s":"' || o_orderstatus || '"}') AS key FROM orders)
SELECT count(*) AS n, count(c.key) AS hits, count(*) - count(c.key) AS misses, count(DISTINCT CASE WHEN c.key IS NULL THEN r.key END) AS distinct_misses FROM r LEFT JOIN c USING (key)""")
def s42_cache_miss(spark, d):
    orders = t(spark, d, "orders")
    key = state.cache_key(F.struct(F.col("o_custkey").alias("o"), F.col("o_orderstatus").alias("s")))
    cache = orders.where("o_orderpriority = '1-URGENT'").select(key.alias("key"), F.lit(1).alias("value")).dropDuplicates(["key"])
    hits, misses = state.lookup(orders.select("o_orderkey", key.alias("key")), cache)
    a = hits.agg(F.count("*").alias("hits"))
    b = misses.agg(F.count("*").alias("misses"), F.count_distinct("key").alias("distinct_misses"))
    return a.crossJoin(b).select((F.col("hits") + F.col("misses")).alias("n"), "hits", "misses", "distinct_misses")


@register("s38_upsert", """
WITH old AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS state, 1 AS attempts FROM orders WHERE o_orderpriority <> '5-LOW'),
new AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 150000 THEN 'failed' ELSE 'done' END AS state FROM orders WHERE o_orderpriority <> '1-URGENT'),
m AS (SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.state = 'done' THEN 'done' ELSE coalesce(new.state, old.state) END AS state, coalesce(old.attempts, 0) + CASE WHEN new.k IS NOT NULL AND old.state IS DISTINCT FROM 'done' THEN 1 ELSE 0 END AS attempts FROM old FULL OUTER JOIN new ON old.k = new.k)
SELECT state, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM m GROUP BY state""")
def s38_upsert(spark, d):
    orders = t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    old = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), status.alias("state"), F.lit(1).alias("attempts"))
    new = orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 150_000, "failed").otherwise("done").alias("state"))
    return state.upsert(old, new, "k").groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@register("s40_manifest", """
WITH d AS (SELECT lang, substr(sha256(doc_id::VARCHAR), 1, 3) AS deal, count(*) AS n, sum(strlen(text)) AS bytes, md5(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS part FROM documents GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS n_files, sum(bytes)::BIGINT AS bytes, md5(string_agg(part, chr(10) ORDER BY deal)) AS digest FROM d GROUP BY lang""")
def s40_manifest(spark, d):
    files = t(spark, d, "documents").select("lang", F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return state.manifest_digest(files, ["lang"])
