"""Join and matching queries over the driver tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.functions.structs import sub_path
from waymesh.operators import intervals, matching, spatial

from .catalogue import register
from .tables import EVENT_S, ROLES, WINDOWS, event_seconds, events, roles, t, windows


@register("j1_dim_lookup", """
SELECT r_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name""")
def j1_dim_lookup(spark, d):
    # revenue is summed by customer and by nation before the small dimensions are joined
    by_customer = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    nation = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by_nation = by_customer.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("revenue"))


@register("j2_semi_cascade", """
WITH n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')),
c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'nation' AS tbl, count(*) AS n FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def j2_semi_cascade(spark, d):
    region = t(spark, d, "region").where("r_name = 'ASIA'")
    kept = matching.semi_cascade([(region, "", ""), (t(spark, d, "nation"), "n_regionkey", "r_regionkey"), (t(spark, d, "customer"), "c_nationkey", "n_nationkey"), (t(spark, d, "orders"), "o_custkey", "c_custkey"), (t(spark, d, "lineitem"), "l_orderkey", "o_orderkey")])
    out = None
    for name, frame in zip(("nation", "customer", "orders", "lineitem"), kept[1:]):
        row = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = row if out is None else out.union(row)
    return out


@register("j3_anti_retain", """
WITH q AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'),
base AS (SELECT c_custkey, c_mktsegment, 'retained' AS origin FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM q)),
new AS (SELECT c_custkey, c_mktsegment, 'replaced' AS origin FROM customer WHERE c_custkey IN (SELECT o_custkey FROM q)),
fk AS (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))
SELECT origin, c_mktsegment, count(*) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM new) GROUP BY origin, c_mktsegment
UNION ALL SELECT 'fk_violation', NULL, n FROM fk""")
def j3_anti_retain(spark, d):
    customers, orders = t(spark, d, "customer"), t(spark, d, "orders")
    quarter = orders.where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-04-01").cast("timestamp_ntz"))).select(F.col("o_custkey").alias("c_custkey")).distinct()
    base = customers.select("c_custkey", "c_mktsegment", F.lit("retained").alias("origin"))
    new = customers.join(quarter, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment", F.lit("replaced").alias("origin"))
    whole = matching.retain_and_append(base, quarter, new, "c_custkey").groupBy("origin", "c_mktsegment").agg(F.count("*").alias("n"))
    broken = matching.violations(orders, customers.where("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey").agg(F.count("*").alias("n"))
    return whole.union(broken.select(F.lit("fk_violation"), F.lit(None).cast("string"), "n"))


@register("j5_sequence_match", f"""
WITH s AS {ROLES}, g AS (SELECT roles, count(*) AS n, min(conv_id) AS first FROM s GROUP BY roles)
SELECT array_to_string(roles, '>') AS signature, len(roles) AS n_turns, n AS n_conversations, first AS first_conv, n > 1 AS is_shared FROM g""")
def j5_sequence_match(spark, d):
    s = roles(spark, d)
    firsts = s.groupBy("roles").agg(F.min("conv_id").alias("conv_id"))
    pairs = matching.sequence_matches(firsts.withColumnRenamed("conv_id", "first_conv"), s, "roles", "first_conv", "conv_id")
    return pairs.groupBy(F.array_join("roles", ">").alias("signature"), F.size("roles").cast("bigint").alias("n_turns"), "first_conv").agg(F.count("*").alias("n_conversations")).withColumn("is_shared", F.col("n_conversations") > 1)


@register("j6_unique_or_reject", """
WITH c AS (SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS one FROM supplier GROUP BY s_nationkey)
SELECT n_nationkey, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN one END AS s_suppkey,
CASE WHEN n = 1 THEN NULL WHEN n IS NULL THEN 'no_candidate' ELSE 'ambiguous' END AS reason
FROM nation LEFT JOIN c ON n_nationkey = s_nationkey""")
def j6_unique_or_reject(spark, d):
    nations = t(spark, d, "nation").select("n_nationkey")
    return matching.unique_or_reject(nations, t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), "n_nationkey", "s_suppkey")


@register("j7_tier_fallback", """
WITH a AS (SELECT doc_id, min('q' || quality) AS v FROM labels WHERE quality = 1 GROUP BY doc_id),
b AS (SELECT doc_id, min('s' || source) AS v FROM documents WHERE n_chars > 500 GROUP BY doc_id),
i AS (SELECT DISTINCT doc_id FROM labels)
SELECT d.doc_id, coalesce(a.v, CASE WHEN i.doc_id IS NULL THEN b.v END) AS value,
CASE WHEN a.v IS NOT NULL THEN 'official' WHEN i.doc_id IS NOT NULL THEN 'blocked_by_official' WHEN b.v IS NOT NULL THEN 'fallback' ELSE 'none' END AS tier
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN i USING (doc_id)""")
def j7_tier_fallback(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    official = labels.where("quality = 1").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    fallback = docs.where("n_chars > 500").select("doc_id", F.concat(F.lit("s"), "source").alias("value"))
    return matching.tiers(docs.select("doc_id"), official, fallback, labels.select("doc_id"), "doc_id", "value")


@register("j8_overlap_stitch", f"""
WITH s AS (SELECT DISTINCT roles FROM {ROLES} WHERE len(roles) >= 3)
SELECT array_to_string(x.roles, '>') AS a, array_to_string(y.roles, '>') AS b, n AS overlap
FROM (SELECT x.roles AS xr, y.roles AS yr, [k FOR k IN range(2, least(len(x.roles), len(y.roles))::BIGINT) IF x.roles[-k:] = y.roles[1:k]] AS fit FROM s x, s y WHERE x.roles <> y.roles) q,
LATERAL (SELECT q.fit[1] AS n, {{'roles': q.xr}} AS x, {{'roles': q.yr}} AS y) z WHERE len(fit) = 1""".replace("{{", "{").replace("}}", "}"))
def j8_overlap_stitch(spark, d):
    from waymesh.functions.structs import overlaps

    s = roles(spark, d).where(F.size("roles") >= 3).select("roles").distinct()
    pairs = s.alias("x").join(s.alias("y"), F.col("x.roles") != F.col("y.roles"))  # distinct signatures: a few dozen rows
    fit = pairs.withColumn("fit", overlaps(F.col("x.roles"), F.col("y.roles"))).where(F.size("fit") == 1)
    return fit.select(F.array_join("x.roles", ">").alias("a"), F.array_join("y.roles", ">").alias("b"), F.col("fit")[0].cast("bigint").alias("overlap"))


@register("j10_unordered_pair", """
SELECT least(a.n_name, b.n_name) AS nation_1, greatest(a.n_name, b.n_name) AS nation_2, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS volume
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1, 2""")
def j10_unordered_pair(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    keyed = lines.join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("v"))
    by = keyed.join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("s_nationkey", "c_nationkey").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    nation = t(spark, d, "nation")
    named = by.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("a")), "s_nationkey").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("b")), "c_nationkey")
    pair = named.withColumn("pair", matching.unordered(F.col("a"), F.col("b")))
    return pair.groupBy(F.col("pair")[0].alias("nation_1"), F.col("pair")[1].alias("nation_2")).agg(F.sum("n").alias("n_lines"), F.round(F.sum("v"), 2).alias("volume"))


@register("j12_bijective", """
WITH p AS (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier),
a AS (SELECT s_nationkey FROM p GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1), b AS (SELECT s_suppkey FROM p GROUP BY 1 HAVING count(DISTINCT s_nationkey) = 1)
SELECT s_nationkey, s_suppkey FROM p WHERE s_nationkey IN (SELECT * FROM a) AND s_suppkey IN (SELECT * FROM b)""")
def j12_bijective(spark, d):
    return matching.bijective(t(spark, d, "supplier"), "s_nationkey", "s_suppkey")


@register("j13_prefix_delta", """
WITH p AS (SELECT conv_id, turn, list(role || ':' || length(text)) OVER w AS path, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT x.conv_id, len(x.path) AS n_turns, (x.total - y.total)::BIGINT AS delta FROM p x JOIN p y ON x.conv_id = y.conv_id AND len(x.path) > 1 AND x.path[:len(x.path) - 1] = y.path""")
def j13_prefix_delta(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("x"), F.length("text").cast("bigint").alias("n"))
    paths = c.select("conv_id", F.collect_list("x").over(w).alias("path"), F.sum("n").over(w).alias("total"))
    return matching.prefix_deltas(paths, "path", "total", ["conv_id"]).select("conv_id", F.size("path").cast("bigint").alias("n_turns"), "delta")


@register("j14_pairs_lt", """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS k FROM l)
SELECT a.l_orderkey, count(*) AS n_pairs, round(sum(b.l_extendedprice - a.l_extendedprice), 2) AS delta FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k < b.k GROUP BY 1""")
def j14_pairs_lt(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").distinct()
    pairs = matching.ordered_pairs(lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("line")), ["l_orderkey"], "line")
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("n_pairs"), F.round(F.sum(F.col("b.line.l_extendedprice") - F.col("a.line.l_extendedprice")), 2).alias("delta"))


_BANDS = "(SELECT range AS band, (range * 5400)::BIGINT AS a, (range * 5400 + 7200)::BIGINT AS b FROM range(0, 17))"


@register("j16_point_in_band", f"""
WITH e AS (SELECT event_type, {EVENT_S} % 86400 AS c FROM events), x AS (SELECT event_type, c AS t FROM e UNION ALL SELECT event_type, c + 86400 FROM e)
SELECT event_type, band, count(*) AS n FROM x JOIN {_BANDS} ON a <= t AND t < b GROUP BY event_type, band""")
def j16_point_in_band(spark, d):
    bands = spark.range(17).select(F.col("id").alias("band"), (F.col("id") * 5400).alias("a"), (F.col("id") * 5400 + 7200).alias("b"))
    clock = events(spark, d).groupBy("event_type", (F.col("s") % 86_400).alias("c")).agg(F.count("*").alias("k"))
    return intervals.clock_bands(clock, bands, "c", "a", "b", 5400).groupBy("event_type", "band").agg(F.sum("k").alias("n"))


@register("j17_overlap_conflict", f"""
WITH w AS {WINDOWS}, p AS (SELECT x.user_id, x.event_id AS e1, y.event_id AS e2, greatest(x.a, y.a) AS a, least(x.b, y.b) AS b FROM w x JOIN w y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a < y.b AND y.a < x.b)
SELECT user_id, count(*) AS n_conflicts, sum(b - a)::BIGINT AS overlap_s FROM p GROUP BY user_id""")
def j17_overlap_conflict(spark, d):
    pairs = intervals.overlapping_pairs(windows(spark, d), ["user_id"], "event_id", "a", "b", 7200)
    return pairs.groupBy("user_id").agg(F.count("*").alias("n_conflicts"), F.sum(F.col("b") - F.col("a")).alias("overlap_s"))


@register("j18_intersect", f"""
WITH w AS {WINDOWS}, x AS (SELECT user_id - user_id % 2 AS k, a, b FROM w WHERE user_id % 2 = 0), y AS (SELECT user_id - user_id % 2 AS k, a, b FROM w WHERE user_id % 2 = 1)
SELECT k, count(*) AS n, sum(least(x.b, y.b) - greatest(x.a, y.a))::BIGINT AS seconds FROM x JOIN y USING (k) WHERE greatest(x.a, y.a) < least(x.b, y.b) GROUP BY k""")
def j18_intersect(spark, d):
    w = windows(spark, d).withColumn("k", F.col("user_id") - F.col("user_id") % 2)
    both = intervals.intersect(w.where("user_id % 2 = 0"), w.where("user_id % 2 = 1"), ["k"], 7200)
    return both.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("seconds"))


_POINTS = "(SELECT vec_id, 22.2 + (embedding[1]::DOUBLE + 1) * 0.1 AS lat, 113.9 + (embedding[2]::DOUBLE + 1) * 0.1 AS lon FROM embeddings)"


@register("j19_grid_knn", f"""
WITH p AS {_POINTS}, x AS (SELECT q.vec_id, m.vec_id AS other, sqrt(power((m.lat - q.lat) * 111195.0, 2) + power((m.lon - q.lon) * 111195.0 * cos(radians(q.lat)), 2)) AS d FROM p q, p m WHERE q.vec_id <> m.vec_id)
SELECT vec_id, arg_min(other, struct_pack(d := d, o := other)) AS nearest, round(min(d), 3) AS metres FROM x WHERE d <= 600 GROUP BY vec_id""")
def j19_grid_knn(spark, d):
    p = _points(spark, d)
    near = spatial.closest(p, p.withColumnRenamed("vec_id", "nearest"), "vec_id", "nearest", 1, 600.0, sphere=False, others=True)
    return near.select("vec_id", "nearest", F.round("metres", 3).alias("metres"))


def _points(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", (22.2 + (F.col("embedding")[0].cast("double") + 1) * 0.1).alias("lat"), (113.9 + (F.col("embedding")[1].cast("double") + 1) * 0.1).alias("lon"))


_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians(m.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(m.lat)) * power(sin(radians(m.lon - q.lon) / 2), 2))))"


@register("j20_radius_topk", f"""
WITH p AS {_POINTS}, x AS (SELECT q.vec_id, m.vec_id AS station, {_HAV} AS d FROM p q, p m WHERE q.vec_id <> m.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, station) AS rank FROM x WHERE d <= 2500)
SELECT vec_id, rank, station, round(d, 3) AS metres FROM r WHERE rank <= 6""")
def j20_radius_topk(spark, d):
    p = _points(spark, d)
    near = spatial.closest(p, p.withColumnRenamed("vec_id", "station"), "vec_id", "station", 6, 2500.0, others=True)
    return near.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "station", F.round("metres", 3).alias("metres"))


@register("j23_self_pairs", """
SELECT a.s_nationkey, count(*) AS n_pairs, round(sum(abs(a.s_acctbal - b.s_acctbal)), 2) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1""")
def j23_self_pairs(spark, d):
    s = t(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    # sum over ordered pairs of |x - y| from ranks and running sums: no pairs are made
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    r = s.withColumns({"k": F.row_number().over(w), "before": F.sum("s_acctbal").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s_acctbal")})
    g = r.groupBy("s_nationkey").agg(F.count("*").alias("m"), F.sum(F.col("s_acctbal") * (F.col("k") - 1) - F.col("before")).alias("half"))
    return g.where("m > 1").select("s_nationkey", (F.col("m") * (F.col("m") - 1)).alias("n_pairs"), F.round(F.col("half") * 2, 2).alias("gap"))


@register("j26_cross", """
WITH m AS (SELECT s_nationkey AS o, c_nationkey AS d, round(min(l_extendedprice), 2) AS seconds FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT a.n_nationkey AS origin, b.n_nationkey AS destination, m.seconds FROM nation a CROSS JOIN nation b LEFT JOIN m ON m.o = a.n_nationkey AND m.d = b.n_nationkey WHERE a.n_nationkey <> b.n_nationkey""")
def j26_cross(spark, d):
    known = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = known.groupBy(F.col("s_nationkey").alias("origin"), F.col("c_nationkey").alias("destination")).agg(F.round(F.min("l_extendedprice"), 2).alias("seconds"))
    return spatial.matrix(t(spark, d, "nation").select(F.col("n_nationkey").alias("p")), known)


@register("j27_full_outer_diff", """
WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE source <> 'src1')
SELECT CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' WHEN a.lang IS NOT DISTINCT FROM b.lang AND a.n_chars IS NOT DISTINCT FROM b.n_chars THEN 'equal' ELSE 'conflicting' END AS status, count(*) AS n
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id GROUP BY 1""")
def j27_full_outer_diff(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    other = docs.where("source <> 'src1'").withColumn("n_chars", F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars"))).drop("source")
    return matching.full_outer_diff(docs.where("lang <> 'de'").drop("source"), other, ["doc_id"], ["lang", "n_chars"]).groupBy("status").agg(F.count("*").alias("n"))


@register("j34_provenance", """
WITH l AS (SELECT doc_id, list(DISTINCT CASE WHEN quality = 1 THEN 'quality' ELSE 'low' END) AS q, max(toxic) AS toxic FROM labels GROUP BY doc_id),
b AS (SELECT text, count(*) AS n FROM benchmark GROUP BY 1)
SELECT d.doc_id, coalesce(array_to_string(list_sort(l.q), ','), 'unlabelled') AS reasons, coalesce(l.toxic, 0) = 1 AS warned, coalesce(b.n, 0) AS benchmark_hits
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN b ON b.text = d.text""")
def j34_provenance(spark, d):
    labels = t(spark, d, "labels").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("quality") == 1, "quality").otherwise("low"))), ",").alias("q"), F.max("toxic").alias("toxic"))
    bench = t(spark, d, "benchmark").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("k"))
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))  # whole texts meet by their digests
    got = docs.join(labels, "doc_id", "left").join(bench, "digest", "left")
    return got.select("doc_id", F.coalesce("q", F.lit("unlabelled")).alias("reasons"), (F.coalesce("toxic", F.lit(0)) == 1).alias("warned"), F.coalesce("k", F.lit(0)).alias("benchmark_hits"))


@register("j32_path_unique", f"""
WITH s AS {ROLES}, w AS (SELECT 'user' AS o, 'assistant' AS d UNION ALL SELECT 'system', 'user' UNION ALL SELECT 'assistant', 'user' UNION ALL SELECT 'system', 'assistant'),
p AS (SELECT o, d, roles[list_position(roles, o):list_position(roles, d)] AS path FROM s, w WHERE list_contains(roles, o) AND list_contains(roles, d) AND list_position(roles, o) < list_position(roles, d))
SELECT o AS origin, d AS destination, count(DISTINCT path) AS n_paths, CASE WHEN count(DISTINCT path) = 1 THEN array_to_string(min(path), '>') END AS path FROM p GROUP BY o, d""")
def j32_path_unique(spark, d):
    wanted = spark.createDataFrame([("user", "assistant"), ("system", "user"), ("assistant", "user"), ("system", "assistant")], "origin string, destination string")
    got = matching.routes_between(roles(spark, d), wanted, "roles")
    return got.select("origin", "destination", "n_paths", F.array_join("path", ">").alias("path"))


@register("j31_tiered_choice", """
WITH r AS (SELECT p_brand, p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END AS t1, p_size AS t2 FROM part),
b AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY t1, t2) AS k FROM r), x AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM b WHERE k = 1)
SELECT p_brand, p_partkey, t1::INTEGER AS t1, t2, CASE WHEN n > 1 THEN 'tie' END AS reason FROM x""")
def j31_tiered_choice(spark, d):
    rows = t(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1).alias("t1"), F.col("p_size").alias("t2"))
    return matching.tiered_choice(rows, ["p_brand"], ["t1", "t2"])


@register("j15_path_key", """
WITH p AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem GROUP BY 1),
k AS (SELECT array_to_string(ids[1:2], '>') AS path_key, l_orderkey FROM p WHERE len(ids) >= 2), g AS (SELECT path_key, min(l_orderkey) AS first_order, count(*) AS n FROM k GROUP BY 1)
SELECT path_key, first_order, n FROM g WHERE n > 1""")
def j15_path_key(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("s")).where(F.size("s") >= 2)
    key = sub_path(F.transform("s", lambda x: x["l_suppkey"].cast("string")), F.lit(0), F.lit(1))
    return p.groupBy(key.alias("path_key")).agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("n")).where("n > 1")
