"""Service calendars: date expansion, replacement algebra, published schedules by day.

Relations: calendar (service_id, monday..sunday, start_date, end_date), calendar_dates
(service_id, date, exception_type), holidays (date). Dates are DateType.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.clock import DAY, day_category
from waymesh.operators.intervals import coalesce_bands, union_windows

WEEK = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def service_dates(calendar: DataFrame, calendar_dates: DataFrame, start: Column, end: Column) -> DataFrame:
    """(service_id, date) of every active day in [start, end]: weekly bits, then exceptions."""
    low, high = F.greatest("start_date", start), F.least("end_date", end)
    days = calendar.withColumn("date", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<date>"))))
    weekly = days.where(F.element_at(F.array(*[F.col(w).cast("int") for w in WEEK]), F.weekday("date") + 1) == 1).select("service_id", "date")
    dated = calendar_dates.where(F.col("date").between(start, end))
    kept = weekly.join(dated.where("exception_type = 2").select("service_id", "date"), ["service_id", "date"], "left_anti")
    return kept.union(dated.where("exception_type = 1").select("service_id", "date")).distinct()


def replace_dates(trips: DataFrame, calendar: DataFrame, calendar_dates: DataFrame, replaced: DataFrame, suffix: str = ":RETAIN") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move replaced trips to a clone of their service that leaves out the replaced dates.

    replaced: (trip_id, date). The clone keeps weekly row and exceptions, plus exception 2 on
    each replaced date (an addition on that date goes). Trips of one service with the same
    replaced dates share a clone, named by a hash of those dates. Returns (trips, calendar, calendar_dates).
    """
    per = replaced.distinct().groupBy("trip_id").agg(F.array_sort(F.collect_list("date")).alias("dates"))
    name = F.concat("service_id", F.lit(suffix + ":"), F.substring(F.sha2(F.array_join(F.transform("dates", lambda d: F.date_format(d, "yyyyMMdd")), ","), 256), 1, 8))
    moved = trips.join(per, "trip_id", "left").withColumn("__new", F.when(F.col("dates").isNotNull(), name))
    clones = moved.where("dates is not null").select("service_id", "__new", "dates").dropDuplicates(["__new"])
    new_trips = moved.withColumn("service_id", F.coalesce("__new", "service_id")).select(*trips.columns)
    new_calendar = calendar.unionByName(calendar.join(clones.select("service_id", "__new"), "service_id").withColumn("service_id", F.col("__new")).select(*calendar.columns))
    off = clones.select(F.col("__new").alias("service_id"), F.explode("dates").alias("date")).withColumn("exception_type", F.lit(2))
    copied = calendar_dates.join(clones.select("service_id", "__new"), "service_id").withColumn("service_id", F.col("__new")).select(*calendar_dates.columns)
    copied = copied.join(off.select("service_id", "date"), ["service_id", "date"], "left_anti")
    return new_trips, new_calendar, calendar_dates.unionByName(copied.select(*calendar_dates.columns)).unionByName(off.select(*calendar_dates.columns))


def holidays_complete(holidays: DataFrame, least: int = 15) -> DataFrame:
    """(year, n, complete): a year counts only with New Year's Day, Christmas Day and enough dates."""
    y = holidays.select("date").distinct().groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.bool_or((F.month("date") == 1) & (F.dayofmonth("date") == 1)).alias("new_year"), F.bool_or((F.month("date") == 12) & (F.dayofmonth("date") == 25)).alias("christmas"))
    return y.select("year", "n", (F.col("new_year") & F.col("christmas") & (F.col("n") >= least)).alias("complete"))


def schedule_rows(headways: DataFrame, dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """Published rows on each date: on a holiday only rows for holidays, else those of the weekday.

    headways: (key, weekdays array<boolean>(7 from Monday), public_holiday, kind, start_s, end_s, low, high).
    """
    days = dates.join(holidays.select("date", F.lit(True).alias("holiday")), "date", "left").withColumn("category", day_category(F.col("date"), F.coalesce("holiday", F.lit(False))))
    holiday = F.col("category") == 7
    runs = F.when(holiday, F.col("public_holiday")).otherwise(F.try_element_at("weekdays", F.col("category") + 1))
    # dates of a build window: a few hundred rows against the published rows
    return headways.join(F.broadcast(days.select("date", "category")), F.coalesce(runs, F.lit(False)))


def compile_schedule(headways: DataFrame, dates: DataFrame, holidays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bands, rejects): per (key, date) frequency bands coalesced, departures outside of them.

    A key is rejected as a whole for: no complete holiday year, overlapping bands of different
    headway, a departure inside a band, or bands of neighbouring days that meet in absolute time.
    """
    years = dates.select(F.year("date").alias("year")).distinct().join(holidays_complete(holidays).where("complete"), "year", "left_anti")
    rows = schedule_rows(headways, dates, holidays)
    bands = coalesce_bands(rows.where("kind = 'frequency'").select("key", "date", "start_s", "end_s", "low", "high"), ["key", "date"])
    clash = bands.where("reason is not null").select("key", F.lit("overlapping_bands").alias("reason"))
    good = bands.where("reason is null").drop("reason")
    listed = rows.where("kind = 'departure'").select("key", "date", "start_s").distinct()
    b = good.select(F.col("key").alias("__k"), F.col("date").alias("__d"), F.col("start_s").alias("a"), F.col("end_s").alias("b"))
    inside = listed.join(b, (F.col("key") == F.col("__k")) & (F.col("date") == F.col("__d")) & (F.col("a") <= F.col("start_s")) & (F.col("start_s") < F.col("b")), "left_semi").select("key", F.lit("departure_in_band").alias("reason"))
    # a band past midnight against the next day's bands
    night = good.where(F.col("end_s") > DAY).select("key", F.date_add("date", 1).alias("date"), (F.col("end_s") - DAY).alias("until"))
    met = good.join(night, ["key", "date"]).where("start_s < until").select("key", F.lit("overlaps_next_day").alias("reason"))
    none = headways.select("key").distinct().crossJoin(F.broadcast(years.limit(1))).select("key", F.lit("holiday_data_incomplete").alias("reason"))
    bad = clash.union(inside).union(met).union(none).groupBy("key").agg(F.min("reason").alias("reason"))
    out = good.withColumn("exact_times", F.lit(0)).select("key", "date", "start_s", "end_s", F.col("high").alias("headway_secs"), "low", "exact_times")
    single = listed.select("key", "date", "start_s", (F.col("start_s") + 1).alias("end_s"), F.lit(1).alias("headway_secs"), F.lit(1).alias("low"), F.lit(1).alias("exact_times"))
    return out.unionByName(single).join(bad.select("key"), "key", "left_anti"), bad


def explicit_matches_bands(listed: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """(key, same): whether a listed set of departures is just what bands (start, end inclusive, step) expand to."""
    made = bands.select(key, F.explode(F.sequence("start_s", "end_s", "headway_secs")).alias("t")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("made"))
    given = listed.select(key, F.col("start_s").alias("t")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("given"))
    return given.join(made, key, "full_outer").select(key, (F.col("given").eqNullSafe(F.col("made"))).alias("same"))


def coverage_windows(rows: DataFrame, key: list[str]) -> DataFrame:
    return union_windows(rows, key, "start_s", "end_s")
