"""Aggregation, predicate, validation, set and ranking queries over the driver tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.functions.clock import strict_instant
from waymesh.functions.text import conditional
from waymesh.operators import aggregates, intervals, quality, ranking, sequences, spatial
from waymesh.operators.matching import full_outer_diff

from .catalogue import register
from .tables import EVENT_S, ROLES, WINDOWS, event_seconds, events, roles, t, windows


@register("p1_constraints", """
SELECT 'duplicate_key' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'missing_parent', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'no_children', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'sequence_gap', count(*) FROM (SELECT conv_id, list(turn ORDER BY turn) AS s FROM conversations GROUP BY 1) WHERE s <> range(0, len(s))
UNION ALL SELECT 'time_runs_back', count(*) FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE ts < p""")
def p1_constraints(spark, d):
    lines, orders, c = t(spark, d, "lineitem"), t(spark, d, "orders"), t(spark, d, "conversations")
    return quality.report([
        ("duplicate_key", quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])),
        ("missing_parent", quality.orphans(lines, orders, "l_orderkey", "o_orderkey")),
        ("no_children", quality.orphans(orders, lines, "o_orderkey", "l_orderkey")),
        ("sequence_gap", quality.broken_sequences(c, "conv_id", "turn", 0)),
        ("time_runs_back", quality.decreasing(t(spark, d, "events"), ["user_id"], ["event_id"], "ts")),
    ])


@register("p5_guards", """
WITH n AS (SELECT vec_id, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS norm FROM embeddings)
SELECT (SELECT count(*) FROM n WHERE isfinite(norm) AND norm BETWEEN 0.5 AND 1.5) AS good_norms, (SELECT count(*) FROM events WHERE isfinite(value) AND value BETWEEN 0 AND 100) AS good_values,
(SELECT count(*) FROM events WHERE value > 50) AS large_values, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS negative_balances""")
def p5_guards(spark, d):
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    good = t(spark, d, "embeddings").agg(F.count_if(quality.number_ok(norm, 0.5, 1.5)).alias("good_norms"))
    values = t(spark, d, "events").agg(F.count_if(quality.number_ok(F.col("value"), 0, 100)).alias("good_values"), F.count_if(F.col("value") > 50).alias("large_values"))
    balance = t(spark, d, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("negative_balances"))
    return good.crossJoin(values).crossJoin(balance)  # three single rows


@register("p8_text_condition", """
SELECT source, count(*) AS n, sum(CASE WHEN regexp_matches(text, '(?i)license|copyright|rights reserved') THEN 1 ELSE 0 END)::BIGINT AS n_legal, sum(CASE WHEN regexp_matches(text, '(?i)password|secret|token') THEN 1 ELSE 0 END)::BIGINT AS n_secret, 
sum(CASE WHEN regexp_matches(text, '(?i)school|event|holiday only|amend|temporar|學校|活動|臨時|修訂') THEN 1 ELSE 0 END)::BIGINT AS n_conditional FROM documents GROUP BY source""")
def p8_text_condition(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(text.rlike("(?i)license|copyright|rights reserved")).alias("n_legal"), F.count_if(text.rlike("(?i)password|secret|token")).alias("n_secret"), F.count_if(conditional(text)).alias("n_conditional"))


@register("p13_consecutive", """
WITH p AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, count(*) AS n_events, sum(CASE WHEN event_type = prev THEN 1 ELSE 0 END)::BIGINT AS n_split, max(CASE WHEN event_type = prev AND event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS split_purchase FROM p GROUP BY user_id""")
def p13_consecutive(spark, d):
    e = sequences.edges(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    again = F.col("event_type") == F.col("prev_event_type")
    return e.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(again).alias("n_split"), F.coalesce(F.bool_or(again & (F.col("event_type") == "purchase")), F.lit(False)).alias("split_purchase"))


@register("a2_reason_counts", """
SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_large, round(avg(value), 6) AS mean_value, min(value) AS low, max(value) AS high FROM events GROUP BY event_type""")
def a2_reason_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("value").alias("low"), F.max("value").alias("high"))


_CONSENSUS = """
WITH o AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_linestatus) AS k, min(l_linestatus) AS v FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_partkey, count(*) AS origins FROM o GROUP BY 1), c AS (SELECT l_partkey, v, count(*) AS votes FROM o WHERE k = 1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, v) AS k FROM c)
SELECT l_partkey, v AS value, votes, origins, round(votes / origins, 6) AS share, votes >= 3 AND votes / origins >= 0.9 AS accepted, votes >= 3 AND votes / origins >= 0.5 AS accepted_half FROM r JOIN t USING (l_partkey) WHERE k = 1"""


@register("a3_consensus", _CONSENSUS)
def a3_consensus(spark, d):
    got = aggregates.consensus(t(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_linestatus")
    return got.withColumn("accepted_half", (F.col("votes") >= 3) & (F.col("votes") / F.col("origins") >= 0.5)).withColumn("share", F.round("share", 6))


@register("a5_profile", f"""
WITH s AS {ROLES}, g AS (SELECT roles, count(*) AS n FROM s GROUP BY roles)
SELECT n = 1 AS unique_profile, count(*) AS n_profiles, sum(n)::BIGINT AS n_conversations FROM g GROUP BY 1""")
def a5_profile(spark, d):
    g = roles(spark, d).groupBy("roles").agg(F.count("*").alias("n"))
    return g.groupBy((F.col("n") == 1).alias("unique_profile")).agg(F.count("*").alias("n_profiles"), F.sum("n").alias("n_conversations"))


@register("a9_envelope", f"""
WITH g AS (SELECT event_type, user_id, {EVENT_S} AS a, lead({EVENT_S}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events),
h AS (SELECT event_type, a, b, unnest(range(a // 3600, (b - 1) // 3600 + 1)) % 24 AS hour FROM g WHERE b > a)
SELECT event_type, hour::BIGINT AS hour, max(b - a)::BIGINT AS max_gap_s, count(*) AS n FROM h GROUP BY 1, 2""")
def a9_envelope(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gaps = events(spark, d).select("event_type", F.col("s").alias("a"), F.lead("s").over(w).alias("b")).where("b > a")
    return aggregates.hour_envelope(gaps, ["event_type"])


@register("a11_group_days", """
WITH u AS (SELECT user_id, ts::DATE AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS signature FROM events GROUP BY 1, 2)
SELECT signature, count(*) AS n_user_days, count(DISTINCT day) AS n_days, strftime(min(day), '%Y%m%d') AS first_day, strftime(max(day), '%Y%m%d') AS last_day FROM u GROUP BY 1""")
def a11_group_days(spark, d):
    days = t(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("signature"))
    return days.groupBy("signature").agg(F.count("*").alias("n_user_days"), F.count_distinct("day").alias("n_days"), F.date_format(F.min("day"), "yyyyMMdd").alias("first_day"), F.date_format(F.max("day"), "yyyyMMdd").alias("last_day"))


@register("a12_lanes", f"""
WITH w AS {WINDOWS}, k AS (SELECT x.user_id, x.event_id, count(*) AS depth FROM w x JOIN w y ON x.user_id = y.user_id AND y.a <= x.a AND x.a < y.b GROUP BY 1, 2)
SELECT user_id, max(depth)::INTEGER AS n_lanes, count(*) AS n FROM k GROUP BY user_id""")
def a12_lanes(spark, d):
    packed = intervals.lanes(windows(spark, d), ["user_id"], ["event_id"])
    return packed.groupBy("user_id").agg((F.max("lane") + 1).alias("n_lanes"), F.count("*").alias("n"))


@register("a15_percentile", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def a15_percentile(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@register("a18_coverage", """
SELECT l_orderkey, count(*) AS n_segments, CASE WHEN count(CASE WHEN l_discount < 0.09 THEN 1 END) = count(*) THEN round(sum(l_extendedprice), 2) END AS total FROM lineitem GROUP BY 1""")
def a18_coverage(spark, d):
    known = t(spark, d, "lineitem").withColumn("seconds", F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice")))
    return aggregates.complete_sum(known, ["l_orderkey"], "seconds").select("l_orderkey", F.col("n").alias("n_segments"), F.round("total", 2).alias("total"))


@register("a19_label_sets", """
SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ' · ') AS langs, count(*) AS n FROM documents GROUP BY source""")
def a19_label_sets(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), " · ").alias("langs"), F.count("*").alias("n"))


@register("a20_pivot", """
SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'error' THEN 1 END) AS error, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase, count(*) AS total,
round(count(CASE WHEN event_type = 'click' THEN 1 END) / count(*), 6) AS click_share FROM events GROUP BY user_id""")
def a20_pivot(spark, d):
    wide = t(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).agg(F.count("event_id"))
    total = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"))
    full = total.join(wide, "user_id", "left").na.fill(0, ["click", "error", "purchase"])
    return full.withColumn("click_share", F.round(F.col("click") / F.col("total"), 6))


@register("a21_having", """
WITH h AS (SELECT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 15)
SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT c_custkey FROM h) GROUP BY 1""")
def a21_having(spark, d):
    busy = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n >= 15")
    return t(spark, d, "customer").join(busy, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@register("a22_single_pattern", f"""
WITH s AS (SELECT conv_id % 10 AS grp, roles FROM {ROLES})
SELECT grp, count(DISTINCT roles) AS n_patterns, count(*) AS n, CASE WHEN count(DISTINCT roles) = 1 THEN NULL ELSE 'several_patterns' END AS reason FROM s GROUP BY grp""")
def a22_single_pattern(spark, d):
    g = roles(spark, d).groupBy((F.col("conv_id") % 10).alias("grp")).agg(F.count_distinct("roles").alias("n_patterns"), F.count("*").alias("n"))
    return g.withColumn("reason", F.when(F.col("n_patterns") != 1, "several_patterns"))


@register("a_extra_grouping", """
SELECT 'cube' AS kind, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)
UNION ALL SELECT 'rollup', n_name, c_mktsegment, count(*), round(sum(c_acctbal), 2) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)
UNION ALL SELECT 'sets', n_name, c_mktsegment, count(*), round(sum(c_acctbal), 2) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (c_mktsegment))""")
def a_extra_grouping(spark, d):
    rows = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    agg = [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")]
    sets = rows.groupingSets([[F.col("n_name")], [F.col("c_mktsegment")]], F.col("n_name"), F.col("c_mktsegment")).agg(*agg)
    made = [("cube", rows.cube("n_name", "c_mktsegment").agg(*agg)), ("rollup", rows.rollup("n_name", "c_mktsegment").agg(*agg)), ("sets", sets)]
    out = None
    for name, frame in made:
        part = frame.select(F.lit(name).alias("kind"), "n_name", "c_mktsegment", "n", "balance")
        out = part if out is None else out.union(part)
    return out


@register("a_extra_distinct", """
SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type""")
def a_extra_distinct(spark, d):
    """The sketch's count is within five standard errors of the exact one."""
    both = t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"), F.approx_count_distinct("user_id", 0.02).alias("approx"))
    return both.select("event_type", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@register("o1_rank", """
WITH j AS (SELECT o_orderkey, o_custkey, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS arrival, (o_orderkey % 13) AS walk, (o_orderkey % 3) AS transfers FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY arrival, walk, transfers, o_orderkey) AS fastest, row_number() OVER (PARTITION BY o_custkey ORDER BY transfers, arrival, walk, o_orderkey) AS fewest, row_number() OVER (PARTITION BY o_custkey ORDER BY walk, arrival, transfers, o_orderkey) AS least FROM j)
SELECT o_custkey, min(CASE WHEN fastest = 1 THEN o_orderkey END) AS by_fastest, min(CASE WHEN fewest = 1 THEN o_orderkey END) AS by_transfers, min(CASE WHEN least = 1 THEN o_orderkey END) AS by_walking FROM r GROUP BY o_custkey""")
def o1_rank(spark, d):
    j = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate)").alias("arrival"), (F.col("o_orderkey") % 13).alias("walk"), (F.col("o_orderkey") % 3).alias("transfers"))
    best = [F.min_by("o_orderkey", ranking.rank_key(p, "o_orderkey")).alias(f"by_{p}") for p in ("fastest", "transfers", "walking")]
    return j.groupBy("o_custkey").agg(*best)


@register("w15_rank_dedupe", """
WITH j AS (SELECT o_custkey, o_orderkey, o_orderstatus || ':' || o_orderpriority AS signature, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS arrival, (o_orderkey % 13) AS walk, (o_orderkey % 3) AS transfers FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, signature ORDER BY arrival, walk, transfers, o_orderkey) AS k FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY arrival, walk, transfers, o_orderkey) AS rank FROM u WHERE k = 1)
SELECT o_custkey, rank::INTEGER AS rank, o_orderkey, signature FROM r WHERE rank <= 3""")
def w15_rank_dedupe(spark, d):
    j = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("signature"), F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate)").alias("arrival"), (F.col("o_orderkey") % 13).alias("walk"), (F.col("o_orderkey") % 3).alias("transfers"))
    return ranking.ranked(j, ["o_custkey"], "signature", "fastest", "o_orderkey", 3).select("o_custkey", "rank", "o_orderkey", "signature")


@register("o3_search", """
WITH h AS (SELECT p_partkey, p_type, p_name, lower(p_name) LIKE 'sm%' AS prefix FROM part WHERE contains(replace(lower(p_name), ' ', ''), 'sm') AND contains(replace(lower(p_name), ' ', ''), 'ri'))
SELECT p_partkey, p_type, length(p_name) AS name_length FROM (SELECT *, row_number() OVER (ORDER BY prefix DESC, p_type, length(p_name), p_partkey) AS k FROM h) WHERE k <= 10""")
def o3_search(spark, d):
    hits = ranking.search(t(spark, d, "part"), "sm ri", "p_name", "p_type", "p_partkey", 10)
    return hits.select("p_partkey", "p_type", F.length("p_name").cast("bigint").alias("name_length"))


@register("o5_greedy")
def o5_greedy(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", (22.2 + (F.col("embedding")[0].cast("double") + 1) * 0.1).alias("lat"), (113.9 + (F.col("embedding")[1].cast("double") + 1) * 0.1).alias("lon"))
    centre = e.withColumn("metres", geo.flat_metres_mean(F.lit(22.3), F.lit(114.0), F.col("lat"), F.col("lon")))
    return spatial.separated(centre, ["label"], ["metres", "vec_id"], 150.0, 20).select("label", "place", "vec_id")


@register("t_setops", """
WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union_all' AS op, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'except_all', count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)
UNION ALL SELECT 'contained', CASE WHEN (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) = 0 THEN 1 ELSE 0 END
UNION ALL SELECT 'equal_sets', CASE WHEN (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) + (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) = 0 THEN 1 ELSE 0 END""")
def t_setops(spark, d):
    a = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("k"))
    b = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    made = {"union_all": a.unionByName(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "intersect_all": a.intersectAll(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    out = None
    for name, frame in made.items():
        row = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.union(row)
    missing = quality.missing_keys(b, a, "k").agg(F.count("*").alias("n"))
    other = quality.missing_keys(a, b, "k").agg(F.count("*").alias("m"))
    contained = missing.select(F.lit("contained"), F.when(F.col("n") == 0, 1).otherwise(0).cast("bigint"))
    equal = missing.crossJoin(other).select(F.lit("equal_sets"), F.when(F.col("n") + F.col("m") == 0, 1).otherwise(0).cast("bigint"))
    return out.union(contained).union(equal)


@register("j29_preservation", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS new_quantity, l_extendedprice FROM lineitem)
SELECT 'changed_rows' AS rule, count(*) AS n FROM n WHERE l_quantity <> new_quantity UNION ALL SELECT 'lost_rows', 0 UNION ALL SELECT 'added_rows', 0 UNION ALL SELECT 'unapproved', (SELECT count(*) FROM n WHERE l_quantity <> new_quantity AND l_partkey % 100 <> 0)""")
def j29_preservation(spark, d):
    old = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_tax", "l_discount", "l_linestatus")
    new = old.withColumn("l_quantity", F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    keys = [c for c in old.columns if c != "l_quantity"]
    return quality.preservation(old, new, keys, ["l_quantity"], F.col("l_partkey") % 100 == 0)


@register("t7_fingerprint", "SELECT 'lineitem' AS tbl, count(*) AS n, TRUE AS same FROM lineitem UNION ALL SELECT 'orders', count(*), FALSE FROM orders")
def t7_fingerprint(spark, d):
    lines, orders = t(spark, d, "lineitem"), t(spark, d, "orders")
    shuffled = lines.select(*reversed(lines.columns)).select(*lines.columns)
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    a = quality.same_rows(lines, shuffled).select(F.lit("lineitem").alias("tbl"), "n", "same")
    return a.union(quality.same_rows(orders, changed).select(F.lit("orders"), "n", "same"))
