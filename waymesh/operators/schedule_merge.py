"""Published timetables put into a feed: new trips on the dates they hold for, old trips on all others.

Dates are bitmaps (daysets). A service is split only where it has to be: trips of one service
that lose the same dates share a clone of it, and a service that loses no active date is left as
it is. A clone keeps the weekly row and all exceptions but those on lost dates, so that nothing
changes outside of the window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.clock import day_category
from waymesh.operators import calendar as cal
from waymesh.operators import daysets


def categories(start: Column, end: Column, holidays: DataFrame) -> DataFrame:
    """(date, category) of the build window: 0 to 6 from Monday, 7 a public holiday."""
    days = holidays.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    marked = days.join(holidays.select("date", F.lit(True).alias("__h")).distinct(), "date", "left")
    return marked.select("date", day_category(F.col("date"), F.coalesce("__h", F.lit(False))).alias("category"))


def templates(trips: DataFrame, stop_times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template, offsets) of every (route_id, direction): its first trip by id, if all of its trips stop alike.

    template: (route_id, direction, template_id, reason), reason several_patterns,
    no_origin_departure, negative_offset or null; offsets: (template_id, stop_sequence, stop_id,
    offset_arr, offset_dep) from the origin's departure.
    """
    visits = stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id", "arrival_s", "departure_s"))).alias("v"))
    full = trips.join(visits, "trip_id", "left")
    stops = F.transform("v", lambda x: x["stop_id"])
    base = F.element_at("v", 1)["departure_s"]
    low = F.array_min(F.flatten(F.transform("v", lambda x: F.array(x["arrival_s"] - base, x["departure_s"] - base))))
    # patterns are compared by their text: its least and largest are one
    per = full.withColumns({"stops": F.coalesce(F.to_json(stops), F.lit("")), "base": base, "low": low})
    one = per.groupBy("route_id", "direction").agg(F.min_by(F.struct("trip_id", "base", "low", "v"), "trip_id").alias("x"), (F.min("stops") == F.max("stops")).alias("alike"))
    reason = F.when(~F.col("alike"), "several_patterns").when(F.col("x.base").isNull(), "no_origin_departure").when(F.col("x.low") < 0, "negative_offset")
    told = one.select("route_id", "direction", F.col("x.trip_id").alias("template_id"), reason.alias("reason"), F.col("x.v").alias("v"), F.col("x.base").alias("base"))
    rows = told.where("reason IS NULL").select("template_id", "base", F.explode("v").alias("s"))
    offsets = rows.select("template_id", "s.stop_sequence", "s.stop_id", (F.col("s.arrival_s") - F.col("base")).alias("offset_arr"), (F.col("s.departure_s") - F.col("base")).alias("offset_dep"))
    return told.drop("v", "base"), offsets


def chosen(groups: DataFrame, template: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(adopted, refused): which published group serves each (route_id, direction, category).

    groups: (group_id, page, route_id, direction, categories array<int>, layout, valid, departures
    array<int>, periods array<struct(start_s, end_s, headway_secs)>, reason), reason from the gates
    of its page. Of a page's valid groups of a category those by hour and minute are preferred, and
    one must be left; it has departures or periods, not both. The first page in order serves.
    """
    g = groups.join(template.select("route_id", "direction", F.col("template_id"), F.col("reason").alias("__t")), ["route_id", "direction"], "left")
    listed, banded = F.coalesce(F.size("departures"), F.lit(0)) > 0, F.coalesce(F.size("periods"), F.lit(0)) > 0
    each = g.withColumn("category", F.explode(F.array_distinct("categories"))).withColumns({"__l": listed, "__p": banded})
    page = Window.partitionBy("route_id", "direction", "category", "page")
    valid = F.coalesce(F.col("valid"), F.lit(False))
    by_hour = valid & (F.col("layout") == "hour_minute")
    hours, all_ = F.sum(by_hour.cast("int")).over(page), F.sum(valid.cast("int")).over(page)
    preferred = F.when(hours > 0, by_hour).otherwise(valid)
    judged = each.withColumns({"__own": preferred, "__n": F.when(hours > 0, hours).otherwise(all_)})
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("template_id").isNull(), "no_trips").when(F.col("__t").isNotNull(), F.col("__t"))
        .when((F.col("__n") != 1) | ~F.coalesce("__own", F.lit(False)), "no_single_preferred_group").when(F.col("__l") & F.col("__p"), "mixed_periods_and_departures").when(~F.col("__l") & ~F.col("__p"), "no_times")
    )
    open_ = judged.withColumn("reason", reason).join(days.select("category").distinct(), "category", "left_semi")
    first = Window.partitionBy("route_id", "direction", "category").orderBy("page", "group_id")
    ranked = open_.where("reason IS NULL").withColumn("__r", F.row_number().over(first))
    columns = ["route_id", "direction", "category", "page", "group_id", "template_id", "departures", "periods"]
    refused = open_.where("reason IS NOT NULL").select(*columns[:5], "reason").unionByName(ranked.where("__r > 1").select(*columns[:5], F.lit("date_already_covered").alias("reason")))
    return ranked.where("__r = 1").select(*columns), refused


def merge(feed: dict[str, DataFrame], groups: DataFrame, holidays: DataFrame, start: Column, end: Column) -> dict[str, DataFrame]:
    """The feed with published groups in place of old trips; also `refused` (per category) and `replaced` (trip_id, date).

    feed: trips (trip_id, route_id, direction, service_id), stop_times (trip_id, stop_sequence,
    stop_id, arrival_s, departure_s), frequencies (trip_id, start_s, end_s, headway_secs,
    exact_times), calendar and calendar_dates as in `calendar`.
    """
    trips = feed["trips"]
    days = categories(start, end, holidays)
    template, offsets = templates(trips, feed["stop_times"])
    adopted, refused = chosen(groups, template, days)

    # new services: the days of a group's categories
    service = F.concat_ws(":", F.lit("PUBLISHED"), "route_id", "direction", "group_id")
    named = adopted.withColumn("service_id", service)
    by_category = daysets.pages(days, ["category"])
    new_sets = daysets.union(named.select("service_id", "route_id", "direction", "category").join(by_category, "category"), ["service_id", "route_id", "direction"])
    new_dates = daysets.dates(new_sets, ["service_id"]).withColumn("exception_type", F.lit(1))

    # new trips: one a departure or period
    once = named.dropDuplicates(["service_id"]).select("service_id", "route_id", "direction", "template_id", "departures", "periods")
    period = "struct<start_s:int,end_s:int,headway_secs:int>"
    slots = F.when(F.coalesce(F.size("periods"), F.lit(0)) > 0, F.col("periods").cast(f"array<{period}>")).otherwise(F.transform(F.array_sort(F.array_distinct("departures")), lambda x: F.struct(x.cast("int").alias("start_s"), F.lit(None).cast("int").alias("end_s"), F.lit(None).cast("int").alias("headway_secs"))))
    made = once.select("service_id", "route_id", "direction", "template_id", F.posexplode(slots).alias("j", "p")).withColumn("trip_id", F.concat_ws(":", "service_id", F.col("j").cast("string")))
    new_times = made.select("trip_id", "template_id", F.col("p.start_s").alias("s")).join(offsets, "template_id").select("trip_id", "stop_sequence", "stop_id", (F.col("s") + F.col("offset_arr")).alias("arrival_s"), (F.col("s") + F.col("offset_dep")).alias("departure_s"))
    new_bands = made.where("p.headway_secs IS NOT NULL").select("trip_id", "p.start_s", "p.end_s", "p.headway_secs", F.lit(0).alias("exact_times"))

    # old trips: lost dates are those on which their service is active and their direction is replaced
    active = daysets.pages(cal.service_dates(feed["calendar"], feed["calendar_dates"], start, end), ["service_id"])
    gone = daysets.union(new_sets, ["route_id", "direction"])
    pairs = trips.select("route_id", "direction", "service_id").distinct().join(gone, ["route_id", "direction"])
    lost = daysets.both(pairs, active, ["service_id"])
    signed = daysets.signed(lost, ["route_id", "direction", "service_id"])
    clone = F.concat_ws(":", F.lit("RETAIN"), "service_id", daysets.digest(F.col("signature")))
    clones = signed.withColumn("clone_id", clone)
    each = clones.dropDuplicates(["clone_id"]).select("route_id", "direction", "service_id", "clone_id")
    off = daysets.dates(lost.join(each, ["route_id", "direction", "service_id"]), ["clone_id"]).withColumn("exception_type", F.lit(2))
    moved = trips.join(clones.select("route_id", "direction", "service_id", "clone_id"), ["route_id", "direction", "service_id"], "left")
    weekly = feed["calendar"].join(each.select("service_id", "clone_id"), "service_id").withColumn("service_id", F.col("clone_id")).select(*feed["calendar"].columns)
    kept = feed["calendar_dates"].join(each.select("service_id", "clone_id"), "service_id").join(off.select("clone_id", "date"), ["clone_id", "date"], "left_anti").select(F.col("clone_id").alias("service_id"), "date", "exception_type")
    exceptions = feed["calendar_dates"].select("service_id", "date", "exception_type").unionByName(kept).unionByName(off.withColumnRenamed("clone_id", "service_id")).unionByName(new_dates)
    replaced = moved.where("clone_id IS NOT NULL").select("trip_id", "clone_id").join(off.select("clone_id", "date"), "clone_id").select("trip_id", "date")
    trip_columns = ["trip_id", "route_id", "direction", "service_id"]
    return {
        "trips": moved.withColumn("service_id", F.coalesce("clone_id", "service_id")).select(*trip_columns).unionByName(made.select(*[F.col(c).cast(trips.schema[c].dataType) for c in trip_columns])),
        "stop_times": feed["stop_times"].unionByName(new_times.select(*[F.col(c).cast(feed["stop_times"].schema[c].dataType) for c in new_times.columns])),
        "frequencies": feed["frequencies"].unionByName(new_bands),
        "calendar": feed["calendar"].unionByName(weekly),
        "calendar_dates": exceptions,
        "refused": refused,
        "replaced": replaced,
    }
