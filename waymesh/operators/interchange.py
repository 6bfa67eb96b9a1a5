"""Whole journeys with changes, compiled into connections: which dates and times all their sections run.

A journey is cut at its changes into sections; a section's key is its line and stations. The
first section's bands rule. The other sections' availability, moved back to the journey's
departure, is intersected with them, section by section in the path's own arrays, with dates as
bits. Nothing waits between sections, since the recorded total holds the changes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators import daysets
from waymesh.operators.intervals import lanes, union_windows


def checked(journeys: DataFrame) -> DataFrame:
    """Adds `reason` to journeys; null is a journey that can be compiled.

    journeys: (path_id, origin, destination, total_min, marked boolean, nodes array<struct(station,
    line, t_min, link, marked)>); link is RIDE, INTERCHANGE or, at the end, END. Journeys without a
    change have the reason `no_change`: their lines' own timetables serve them.
    """
    n = F.col("nodes")
    links = F.transform(n, lambda x: x["link"])
    inner = F.slice(links, F.lit(1), F.greatest(F.size(n) - 1, F.lit(0)))
    times = F.transform(n, lambda x: F.bround(x["t_min"] * 60).cast("bigint"))
    steps = F.zip_with(F.slice(times, F.lit(2), F.size(n)), times, lambda b, a: b - a)
    rising = F.forall(F.filter(steps, lambda x: x.isNotNull()), lambda x: x > 0) & F.forall(times, lambda x: x.isNotNull())
    ends = (F.element_at(times, 1) == 0) & (F.element_at(times, -1) == F.bround(F.col("total_min") * 60).cast("bigint")) & (F.element_at(n, 1)["station"] == F.col("origin")) & (F.element_at(n, -1)["station"] == F.col("destination"))
    conditional = F.coalesce(F.col("marked"), F.lit(False)) | F.exists(n, lambda x: F.coalesce(x["marked"], F.lit(False)))
    shape = (F.element_at(links, -1) == "END") & F.forall(inner, lambda x: x.isin("RIDE", "INTERCHANGE"))
    reason = (
        F.when(F.coalesce(F.size(n), F.lit(0)) < 2, "no_path")
        .when(~F.exists(links, lambda x: x == "INTERCHANGE"), "no_change")
        .when(conditional, "conditional")
        .when(~F.coalesce(shape, F.lit(False)), "path_type")
        .when(~F.coalesce(rising & ends, F.lit(False)), "invalid_times")
    )
    return journeys.withColumn("reason", reason)


def sections(journeys: DataFrame) -> DataFrame:
    """(path_id, n, section_key, offset_s): the parts of journeys between their changes, from 0 on."""
    i = F.sequence(F.lit(0), F.size("nodes") - 1)
    cut = F.filter(i, lambda k: (k == 0) | (k == F.size("nodes") - 1) | (F.get(F.col("nodes"), k)["link"] == "INTERCHANGE"))
    spans = F.zip_with(F.slice(cut, F.lit(1), F.size(cut) - 1), F.slice(cut, F.lit(2), F.size(cut) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    s = journeys.withColumn("__s", spans).select("path_id", "nodes", F.posexplode("__s").alias("n", "s"))
    first = F.get(F.col("nodes"), F.col("s.a"))
    stations = F.transform(F.slice("nodes", F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1), lambda x: x["station"])
    return s.select("path_id", "n", F.concat(first["line"], F.lit(":"), F.array_join(stations, ">")).alias("section_key"), F.bround(first["t_min"] * 60).cast("bigint").alias("offset_s"))


def _section_windows(bands: DataFrame) -> DataFrame:
    """(section_key, own, runs): a section's bands, and when it runs at all, each an array with dates as bits.

    own: (page, bits, s, e, headway_secs, exact_times, parent); runs: (page, bits, a, b), on no date
    touching each other.
    """
    key = "section_key"
    band = ["start_s", "end_s", "headway_secs", "exact_times", "parent"]
    sets = daysets.pages(bands.select(key, *band, "date"), [key, *band])
    own = sets.groupBy(key).agg(F.collect_list(F.struct("page", "bits", F.col("start_s").cast("bigint").alias("s"), F.col("end_s").cast("bigint").alias("e"), *band[2:])).alias("own"))
    united = union_windows(bands.select(key, "date", F.col("start_s").cast("bigint").alias("a"), F.col("end_s").cast("bigint").alias("b")), [key, "date"])
    runs = daysets.pages(united, [key, "a", "b"]).groupBy(key).agg(F.collect_list(F.struct("page", "bits", "a", "b")).alias("runs"))
    return own.join(runs, key, "left")


def _both(x: Column, y: Column, made) -> Column:
    """Where two arrays of windows with dates overlap: made(x, y, page, bits, low, high) of each pair that does."""
    bits = lambda u, v: u["bits"].bitwiseAND(v["bits"])
    meets = lambda u, v: (u["page"] == v["page"]) & (u["a"] < v["b"]) & (v["a"] < u["b"]) & (u["a"] < u["b"]) & (bits(u, v) != 0)
    pairs = lambda z: F.flatten(F.transform(x, lambda u: F.transform(F.filter(z, lambda v: meets(u, v)), lambda v: made(u, v, u["page"], bits(u, v), F.greatest(u["a"], v["a"]), F.least(u["b"], v["b"])))))
    # y is bound to a name, as an expression in its place would be computed for each element of x
    return F.transform(F.array(y), pairs)[0]


def _found(parts: DataFrame, bands: DataFrame) -> DataFrame:
    """(path_id, missing, found) of every path: found holds (page, bits, start_s, end_s, headway_secs, exact_times, parent).

    A part meets its section's bands once and its path once; dates stay bits on the way. In a
    path the sections' windows are intersected in turn: as windows of a section do not touch,
    those of an intersection do not either, so none has to be united again. A path's parts and
    a section's bands are arrays: both are bounded, as timetables and journeys are.
    """
    known = parts.join(_section_windows(bands).withColumn("__known", F.lit(True)), "section_key", "left")
    first = F.col("n") == 0
    # only a first section's bands travel whole, and only the others' windows
    part = F.struct("n", F.col("offset_s").cast("bigint").alias("off"), F.when(~first, F.col("runs")).alias("runs"))
    one = known.groupBy("path_id").agg(
        F.array_sort(F.collect_list(F.when(~first, part))).alias("later"), F.flatten(F.collect_list(F.when(first, F.col("own")))).alias("own"),
        F.sum(F.col("__known").isNull().cast("int")).alias("__lost"), F.sum(first.cast("int")).alias("__firsts"),
    )
    moved = F.transform("later", lambda p: F.transform(F.coalesce(p["runs"], F.array().cast("array<struct<page:int,bits:bigint,a:bigint,b:bigint>>")), lambda w: F.struct(w["page"].alias("page"), w["bits"].alias("bits"), (w["a"] - p["off"]).alias("a"), (w["b"] - p["off"]).alias("b"))))
    window = lambda u, v, page, bits, a, b: F.struct(page.alias("page"), bits.alias("bits"), a.alias("a"), b.alias("b"))
    free = F.aggregate(F.slice("__m", F.lit(2), F.greatest(F.size("__m") - 1, F.lit(0))), F.element_at("__m", 1), lambda s, x: _both(s, x, window))
    band = lambda page, bits, a, b, u: F.struct(page.alias("page"), bits.alias("bits"), a.alias("start_s"), b.alias("end_s"), u["headway_secs"].alias("headway_secs"), u["exact_times"].alias("exact_times"), u["parent"].alias("parent"))
    alone = F.transform("own", lambda u: band(u["page"], u["bits"], u["s"], u["e"], u))
    # own bands under the names that _both compares
    ruling = F.transform("own", lambda u: F.struct(u["page"].alias("page"), u["bits"].alias("bits"), u["s"].alias("a"), u["e"].alias("b"), u["headway_secs"].alias("headway_secs"), u["exact_times"].alias("exact_times"), u["parent"].alias("parent")))
    cut = _both(ruling, F.col("__free"), lambda u, v, page, bits, a, b: band(page, bits, a, b, u))
    single = F.col("__firsts") == 1
    told = one.withColumn("__m", moved).withColumn("__free", F.when(F.size("__m") > 0, free))
    found = F.when((F.col("__lost") == 0) & single, F.when(F.size("__m") == 0, alone).otherwise(cut))
    return told.select("path_id", (F.col("__lost") > 0).alias("missing"), found.alias("found"))


def window_sets(parts: DataFrame, bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """windows() with dates as bits: (path_id, page, bits, start_s, end_s, headway_secs, exact_times, parent), equal windows of several parents as they are, and the refused paths."""
    told = _found(parts, bands)
    # the outer form, as before the other one the optimizer puts a filter that computes the array once more
    each = told.select("path_id", F.inline_outer("found")).where("page IS NOT NULL")
    refused = told.where(F.col("missing") | (F.coalesce(F.size("found"), F.lit(0)) <= 0)).select("path_id", F.when(F.col("missing"), "no_timetable").otherwise("no_common_window").alias("reason"))
    return each, refused


def windows(parts: DataFrame, bands: DataFrame, size: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(path_id, date, start_s, end_s, headway_secs, exact_times, parent) and (path_id, reason) of paths that have none.

    parts: sections(); bands: (section_key, date, start_s, end_s, headway_secs, exact_times,
    parent), headway 0 for a single departure. Of equal windows with several parents the smallest
    counts. `size` is no longer used: windows meet in their path's arrays, not in bins of time.
    """
    each, refused = window_sets(parts, bands)
    dated = daysets.dates(each, ["path_id", "start_s", "end_s", "headway_secs", "exact_times", "parent"])
    got = dated.groupBy("path_id", "date", "start_s", "end_s", "headway_secs", "exact_times").agg(F.min("parent").alias("parent"))
    return got, refused


def service_key(dates: Column) -> Column:
    """The name of a set of dates: a digest of its sorted days."""
    return F.substring(F.sha2(F.array_join(F.transform(F.array_sort(dates), lambda x: F.date_format(x, "yyyyMMdd")), ","), 256), 1, 16)


def bundle(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bands, services) of windows() or window_sets(): equal bands over their dates, dealt to lanes.

    bands: (path_id, service_key, exact_times, start_s, end_s, headway_secs, parent, lane): bands of one
    lane follow each other, so that one trip holds them; a single departure is a lane of its own.
    services: (service_key, date), one key for equal sets of dates.
    """
    key = ["path_id", "start_s", "end_s", "headway_secs", "exact_times"]
    if "bits" in found.columns:
        sets = found.groupBy(*key).agg(F.collect_set(F.struct("page", "bits")).alias("__s"), F.min("parent").alias("parent"))
        day = sets.select(*key, F.array_distinct(F.flatten(F.transform("__s", lambda x: daysets.dates_of(x["page"], x["bits"])))).alias("dates"), "parent")
    else:
        day = found.groupBy(*key).agg(F.collect_set("date").alias("dates"), F.min("parent").alias("parent"))
    keyed = day.withColumn("service_key", service_key(F.col("dates")))
    services = keyed.dropDuplicates(["service_key"]).select("service_key", F.explode("dates").alias("date"))
    # both kinds in one flow, as two would compute all windows twice
    rows = keyed.drop("dates").where("headway_secs >= 0").withColumn("__often", F.col("headway_secs") > 0)
    own = ["path_id", "service_key", "exact_times", "__often"]
    by = Window.partitionBy(*own).orderBy("start_s", "end_s", "parent")
    dealt = lanes(rows, own, ["headway_secs", "parent"], "start_s", "end_s")
    return dealt.withColumn("lane", F.when(F.col("__often"), F.col("lane")).otherwise(-F.row_number().over(by))).drop("__often"), services


def connections(bands: DataFrame, journeys: DataFrame, trips: DataFrame) -> dict[str, DataFrame]:
    """trips, frequencies and stop_times of the bundled bands.

    journeys: (path_id, origin, destination, total_s); trips: (parent, route_id). A connection runs
    from its first to its last station in the recorded total; its route is named by the parent's
    route and the total, so that fast and slow paths of equal departures stay apart.
    """
    name = F.concat_ws(":", "path_id", "service_key", "exact_times", F.col("lane").cast("string"))
    rows = bands.join(journeys.select("path_id", "origin", "destination", "total_s"), "path_id").withColumn("trip_id", name)
    lead = rows.groupBy("trip_id", "path_id", "origin", "destination", "total_s", "service_key").agg(F.min_by(F.struct("parent", "start_s", "headway_secs"), F.struct("start_s", "end_s")).alias("first"))
    made = lead.join(trips, F.col("first.parent") == trips["parent"]).drop("parent")
    out = made.select("trip_id", F.concat("route_id", F.lit(":PATH:"), F.col("total_s").cast("string")).alias("route_id"), F.col("service_key").alias("service_id"), "path_id")
    start = F.when(F.col("first.headway_secs") > 0, F.lit(0)).otherwise(F.col("first.start_s"))
    stops = F.array(F.struct(F.lit(1).alias("stop_sequence"), F.col("origin").alias("stop_id"), start.alias("s")), F.struct(F.lit(2).alias("stop_sequence"), F.col("destination").alias("stop_id"), (start + F.col("total_s")).alias("s")))
    times = made.select("trip_id", F.explode(stops).alias("x")).select("trip_id", "x.stop_sequence", "x.stop_id", F.col("x.s").alias("arrival_s"), F.col("x.s").alias("departure_s"))
    return {"trips": out, "stop_times": times, "frequencies": rows.where("headway_secs > 0").select("trip_id", "start_s", "end_s", "headway_secs", "exact_times")}
