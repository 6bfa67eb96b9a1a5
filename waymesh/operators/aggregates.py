"""Aggregations with a rule of acceptance: consensus, completeness, envelopes, profiles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus(rows: DataFrame, key: str, origin: str, value: str, least: int = 3, share: float = 0.9) -> DataFrame:
    """(key, value, votes, origins, share, accepted): one vote an origin, from origins that agree with themselves.

    The winner has the most votes, ties go to the smaller value; inconsistent origins have no vote
    but count in the share.
    """
    per = rows.groupBy(key, origin).agg(F.min(value).alias("v"), F.max(value).alias("w"))
    total = per.groupBy(key).agg(F.count("*").alias("origins"))
    votes = per.where(F.col("v") == F.col("w")).groupBy(key, "v").agg(F.count("*").alias("votes"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("m"), F.col("v"))).alias("x"))
    got = best.join(total, key).select(key, F.col("x.v").alias("value"), (-F.col("x.m")).alias("votes"), "origins")
    ratio = F.col("votes") / F.col("origins")
    return got.withColumns({"share": ratio, "accepted": (F.col("votes") >= least) & (ratio >= share)})


def complete_sum(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key.., n, total): the sum only where every row has a value."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.when(F.count(value) == F.count("*"), F.sum(value)).alias("total"))


def hour_envelope(gaps: DataFrame, key: list[str]) -> DataFrame:
    """(key.., hour, max_gap_s, n): the longest gap [a, b) that touches an hour of the day."""
    spread = gaps.where("a < b").withColumn("hour", F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor((F.col("b") - 1) / 3600)))).withColumn("hour", F.col("hour") % 24)
    return spread.groupBy(*key, "hour").agg(F.max(F.col("b") - F.col("a")).alias("max_gap_s"), F.count("*").alias("n"))


def headway(rows: DataFrame, key: list[str], numbers: str, floor_seconds) -> DataFrame:
    """Longest of the published numbers (array), not under the night floor."""
    return rows.select(*key, F.greatest(F.array_max(numbers), floor_seconds).alias("headway_s"))


def one_profile(rows: DataFrame, key: list[str], trip: str, seq: str, time: str) -> DataFrame:
    """(key.., n_profiles, template): how many relative time profiles a key's trips have; its first trip where just one."""
    trips = rows.groupBy(*key, trip).agg(F.array_sort(F.collect_list(F.struct(seq, time))).alias("s"))
    shaped = trips.withColumn("profile", F.transform("s", lambda x: x[time] - F.col("s")[0][time]))
    got = shaped.groupBy(*key).agg(F.count_distinct("profile").alias("n_profiles"), F.min(trip).alias("__t"))
    return got.select(*key, "n_profiles", F.when(F.col("n_profiles") == 1, F.col("__t")).alias("template"))


def grouped_days(rows: DataFrame, key: list[str], day: str, item: list[str]) -> DataFrame:
    """(key.., schedule, days): dates with the identical sorted set of items."""
    per = rows.groupBy(*key, day).agg(F.to_json(F.array_sort(F.collect_set(F.struct(*item)))).alias("schedule"))
    return per.groupBy(*key, "schedule").agg(F.array_sort(F.collect_list(day)).alias("days"))


def first_sources(rows: DataFrame, key: list[str], url: str, most: int = 5) -> DataFrame:
    return rows.groupBy(*key).agg(F.slice(F.array_sort(F.collect_set(url)), 1, most).alias("sources"))


def holiday_services(calendar_dates: DataFrame, calendar: DataFrame, least: int = 15) -> DataFrame:
    """Sunday-only services with at least `least` added dates."""
    added = calendar_dates.where("exception_type = 1").groupBy("service_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sunday = calendar.where("sunday = 1 and monday + tuesday + wednesday + thursday + friday + saturday = 0")
    return sunday.join(added, "service_id", "left_semi").select("service_id")


def progress(jobs: DataFrame, state: str, finished: str, seconds: str, last: int = 50) -> DataFrame:
    """One row: jobs by state, mean of the last finished durations, and the estimated time left."""
    counts = jobs.groupBy(state).agg(F.count("*").alias("n"))
    recent = jobs.where(F.col(seconds).isNotNull()).orderBy(F.desc(finished)).limit(last).agg(F.avg(seconds).alias("mean_s"))
    waiting = counts.where(F.col(state).isin("pending", "running")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left"))
    states = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(state, "n")))).alias("states"))
    return states.crossJoin(recent).crossJoin(waiting).withColumn("eta_s", F.col("mean_s") * F.col("left"))
