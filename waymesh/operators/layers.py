"""Layers of timetable evidence: where several kinds speak of one moment, the best one is heard.

Published headways and the stretches of listed departures stand over a baseline kept as fallback.
`top_layer` takes intervals of all layers through one sweep of signed events; `rail_schedule` does a path's in arrays.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators import daysets
from waymesh.operators.intervals import quarantine, union_windows

#: Layers from the best on.
PUBLISHED, LISTED, FALLBACK = 0, 1, 2


def top_layer(rows: DataFrame, key: list[str], layers: int = 3) -> DataFrame:
    """(key.., layer, a, b): the stretches of [a, b) of each key where a layer is the best one present.

    rows: (key.., layer, a, b), overlapping as they like. A running count for each layer tells
    which are open after an event; one shuffle by key, whatever the number of layers.
    """
    ends = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))
    events = rows.where("a < b").select(*key, "layer", F.explode(ends).alias("e"))
    change = events.groupBy(*key, F.col("e.at").alias("at")).agg(*[F.sum(F.when(F.col("layer") == k, F.col("e.d")).otherwise(0)).alias(f"d{k}") for k in range(layers)])
    by = Window.partitionBy(*key).orderBy("at")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    best = F.lit(None).cast("int")
    for k in reversed(range(layers)):
        best = F.when(F.sum(f"d{k}").over(so_far) > 0, k).otherwise(best)
    open_ = change.withColumns({"layer": best, "b": F.lead("at").over(by)}).where("layer IS NOT NULL AND b IS NOT NULL")
    return union_windows(open_.select(*key, "layer", F.col("at").alias("a"), "b"), [*key, "layer"])


_SPANS = "array<struct<a:bigint,b:bigint>>"


def united(spans: Column) -> Column:
    """An array of [a, b), sorted, with touching and overlapping ones as one; empty ones are dropped."""
    ends = F.array_sort(F.filter(spans, lambda x: x["a"] < x["b"]))
    start = F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.array().cast(_SPANS).alias("done"))
    one = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))
    more = lambda s, x: F.when(x["a"] <= s["b"], F.struct(s["a"].alias("a"), F.greatest(s["b"], x["b"]).alias("b"), s["done"].alias("done"))).otherwise(F.struct(x["a"].alias("a"), x["b"].alias("b"), F.when(s["a"].isNull(), s["done"]).otherwise(F.array_append(s["done"], one(s))).alias("done")))
    return F.aggregate(ends, start, more, lambda s: F.when(s["a"].isNull(), s["done"]).otherwise(F.array_append(s["done"], one(s))))


def gaps(cover: Column, low: Column, high: Column) -> Column:
    """The parts of [low, high) that united spans leave."""
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    inside = F.filter(cover, lambda x: (x["b"] > low) & (x["a"] < high))
    starts = F.concat(F.array(low), F.transform(inside, lambda x: x["b"]))
    ends = F.concat(F.transform(inside, lambda x: x["a"]), F.array(high))
    return F.filter(F.zip_with(starts, ends, span), lambda x: x["a"] < x["b"])


def rail_schedule(records: DataFrame, baseline: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bands, services, refused) of one build: published records over the baseline, on each date.

    records: (id, path, categories array<int>, kind 'departure' or 'frequency', start_s, end_s,
    headway_s, mixed), path names stops and running times, end_s of a departure is null; baseline:
    (path, start_s, end_s, headway_s, gaps boolean); days: (date, category).

    Records of a path and category that contradict each other are refused with a reason. The
    others are all kept. The baseline stays under them: never where a published headway holds, nor
    between the first and the last listed departure. Where `gaps` it fills all the rest of its
    span, else only the stretches of refused records, since a gap in a source may be meant.

    bands: (path, service_key, origin, start_s, end_s, headway_s, days), one row for equal bands on all
    their dates, so that what several services or tables say twice is kept once; days is the number
    of these dates. services: (service_key, date).

    All is one flow by path: records that already lie by path are not shuffled again, and the
    baseline comes to them. What one path and category has is an array, as its timetable is bounded.
    """
    long = lambda c: F.col(c).cast("bigint")
    judged = quarantine(records.withColumn("category", F.explode(F.array_distinct("categories"))), ["path", "category"], "id")
    good, single = F.col("reason").isNull(), F.col("kind") == "departure"
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    of = judged.groupBy("path", "category").agg(
        F.collect_set(F.when(good & single, long("start_s"))).alias("listed"),
        F.collect_set(F.when(good & (F.col("kind") == "frequency"), F.struct(long("start_s").alias("a"), long("end_s").alias("b"), long("headway_s").alias("headway_s")))).alias("often"),
        F.collect_set(F.when(~good, span(long("start_s"), F.coalesce(long("end_s"), long("start_s") + 1)))).alias("open"),
    )
    base = baseline.groupBy("path").agg(F.collect_list(F.struct(long("start_s").alias("a"), long("end_s").alias("b"), long("headway_s").alias("headway_s"), "gaps")).alias("base"))
    cover = F.concat(F.transform("often", lambda x: span(x["a"], x["b"])), F.when(F.size("listed") > 0, F.array(span(F.array_min("listed"), F.array_max("listed") + 1))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")))
    met = of.join(base, "path", "left").withColumns({"cover": united(cover), "open": united(F.col("open"))})

    def filled(w: Column) -> Column:
        """The baseline's window w without what is covered: all of it, or what of it is open."""
        free = gaps(F.col("cover"), w["a"], w["b"])
        cut = F.flatten(F.transform(free, lambda x: F.transform(F.filter("open", lambda y: (x["a"] < y["b"]) & (y["a"] < x["b"])), lambda y: span(F.greatest(x["a"], y["a"]), F.least(x["b"], y["b"])))))
        return F.transform(F.when(w["gaps"], free).when(~w["gaps"], cut).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")), lambda x: said("retained_fallback", x["a"], x["b"], w["headway_s"]))

    said = lambda origin, a, b, h: F.struct(F.lit(origin).alias("origin"), a.alias("start_s"), b.alias("end_s"), h.alias("headway_s"))
    none = F.array().cast("array<struct<a:bigint,b:bigint,headway_s:bigint,gaps:boolean>>")
    rows = F.concat(
        F.transform("listed", lambda s: said("listed_departure", s, s + 1, F.lit(0).cast("bigint"))), F.transform("often", lambda x: said("published_interval", x["a"], x["b"], x["headway_s"])),
        F.flatten(F.transform(F.coalesce("base", none), filled)),
    )
    # the outer form: before the other one the optimizer puts a filter that computes the array once more
    all_ = met.select("path", "category", F.inline_outer(rows)).where("origin IS NOT NULL")
    key = ["path", "origin", "start_s", "end_s", "headway_s"]
    # eight categories' dates of the build window are a bounded table
    sets = daysets.union(all_.join(F.broadcast(daysets.pages(days, ["category"])), "category").select(*key, "page", "bits"), key)
    named = daysets.signed(sets, key, keep=True).withColumn("service_key", daysets.digest(F.col("signature")))
    services = named.groupBy("service_key").agg(F.first("pages").alias("pages")).select("service_key", F.inline("pages"))
    return named.select("path", "service_key", "origin", "start_s", "end_s", "headway_s", "days"), daysets.dates(services, ["service_key"]), judged.where(~good).select("id", "path", "category", "reason")
