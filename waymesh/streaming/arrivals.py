"""Live arrivals: identity, freshness, horizon, dedupe and the first few, as batch or stream.

`now` is a column or a literal, so a recorded payload gives the same result whenever it is
replayed; a stream uses the event's own processing clock.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds; fixed values.
PAYLOAD_AGE, RECORD_AGE, HORIZON = (-60, 120), (-60, 300), (-30, 10_800)
FIRST = 3


def age(now: Column, at: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(at)).cast("bigint")


def judged(records: DataFrame, now: Column) -> DataFrame:
    """Adds `status`: stale_payload, stale_record, other_service, out_of_horizon or live.

    records: (operator, route, direction, service_type, seq, stop, generated, updated, eta,
    remark) with the wanted identity as want_*; null service types are not compared.
    """
    same = F.coalesce((F.col("route") == F.col("want_route")) & (F.col("direction") == F.col("want_direction")) & (F.col("seq") == F.col("want_seq")) & (F.col("want_service_type").isNull() | (F.col("service_type") == F.col("want_service_type"))), F.lit(False))
    fresh = F.coalesce(age(now, F.col("generated")).between(*PAYLOAD_AGE), F.lit(False))
    recent = (F.col("operator") == "gmb") | F.coalesce(age(now, F.col("updated")).between(*RECORD_AGE), F.lit(False))
    ahead = F.coalesce((-age(now, F.col("eta"))).between(*HORIZON), F.lit(False))
    return records.withColumn("status", F.when(~fresh, "stale_payload").when(~recent, "stale_record").when(~same, "other_service").when(~ahead, "out_of_horizon").otherwise("live"))


def arrivals(records: DataFrame, now: Column, key: list[str]) -> DataFrame:
    """(key.., place, eta, kind, wait_min): live records, last of each (eta, kind) kept, first three."""
    kind = F.when(F.coalesce(F.col("remark").rlike("(?i)schedul|原定"), F.lit(False)), "scheduled").otherwise("live")
    live = judged(records, now).where("status = 'live'").withColumn("kind", kind)
    last = live.groupBy(*key, "eta", "kind").agg(F.max("updated").alias("updated"))
    w = Window.partitionBy(*key).orderBy("eta", "kind")
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= FIRST).select(*key, "place", "eta", "kind", F.greatest(F.lit(0), F.ceil(-age(now, F.col("eta")) / 60)).cast("int").alias("wait_min"))


def identity_problems(requests: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(request, reason): operator and route form, a verified occurrence, and no stop visited twice."""
    form = F.when(~F.coalesce(F.col("operator").isin("kmb", "ctb", "nlb", "gmb", "mtr"), F.lit(False)), "operator").when(~F.coalesce(F.col("route").rlike("^[0-9A-Z]{1,6}$"), F.lit(False)), "route").when(~F.coalesce(F.col("direction").isin("I", "O"), F.lit(False)), "direction")
    visits = crosswalk.groupBy("operator", "route", "direction", "stop").agg(F.count("*").alias("visits"))
    got = requests.join(visits, ["operator", "route", "direction", "stop"], "left")
    return got.select("request", F.coalesce(form, F.when(F.col("visits").isNull(), "not_verified"), F.when(F.col("visits") > 1, "stop_repeats")).alias("reason")).where("reason is not null")


def tumbling(events: DataFrame, time: str, size: str, key: list[str]) -> DataFrame:
    """(start, key.., n): counts in tumbling windows; the same for batch and stream."""
    return events.groupBy(F.window(time, size).alias("w"), *key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *key, "n")


def sliding(events: DataFrame, time: str, size: str, step: str, key: list[str]) -> DataFrame:
    return events.groupBy(F.window(time, size, step).alias("w"), *key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *key, "n")


def sessions(events: DataFrame, time: str, gap: str, key: list[str]) -> DataFrame:
    """(key.., start, end, n): sessions that end when `gap` passes without an event."""
    return events.groupBy(F.session_window(time, gap).alias("w"), *key).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def late(events: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarked events: what is later than `delay` is dropped by stateful operators downstream."""
    return events.withWatermark(time, delay)


def distinct_live(events: DataFrame, time: str, delay: str, key: list[str]) -> DataFrame:
    return late(events, time, delay).dropDuplicatesWithinWatermark(key)


def latest_with_ttl(events: DataFrame, key: str, time: str, value: str, seconds: int = 15) -> DataFrame:
    """Streaming keyed cache: each key's newest value, forgotten `seconds` after its event time passes.

    Input needs a watermark on `time`. Emits (key, value, at) at each change.
    """
    kind, what = events.schema[key].dataType.simpleString(), events.schema[value].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        before = best
        for frame in frames:
            for at, v in zip(frame[time], frame[value]):
                if best is None or at.timestamp() >= best[0]:
                    best = (at.timestamp(), v)
        if best is not None and best != before:
            state.update(best)
            at = int(best[0] * 1000) + seconds * 1000
            if at > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(at)
            yield pd.DataFrame({key: [k[0]], value: [best[1]], "at": [pd.Timestamp(best[0], unit="s")]})

    schema = f"{key} {kind}, {value} {what}, at timestamp"
    return events.groupBy(key).applyInPandasWithState(step, schema, f"at double, v {what}", "update", "EventTimeTimeout")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over what is there now into a memory table and return it; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def progress_since(log: DataFrame, cursor: int) -> DataFrame:
    """Append-only progress events after a cursor."""
    return log.where(F.col("seq") > cursor).orderBy("seq")
