"""Journeys for a window of departures: Pareto labels instead of one earliest arrival.

A label at a stop is (departure, arrival, rides, walk): leaving later, arriving earlier, riding
and walking less are better, and only labels that no other one beats in all four are kept. A
round boards all labels of one ride fewer. Requests that find nothing are searched again, alone,
in the next wider window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators.routing import cut

#: What a ranking compares first.
PREFERENCES = {"fastest": ["arr_s", "rides", "walk_s"], "transfers": ["rides", "arr_s", "walk_s"], "walking": ["walk_s", "arr_s", "rides"]}
_LEG = "array<struct<trip_id:string,from_stop:string,to_stop:string,dep_s:bigint,arr_s:bigint>>"


def undominated(labels: DataFrame, key: list[str]) -> DataFrame:
    """The labels (key.., dep_s, t, rides, walk_s, ..) of each key that no other one beats; of equals the smallest.

    A key holds the labels of one request at one stop: as many as departures of its window and
    rides, at most. Dominance is judged inside the JVM, in the key's own array.
    """
    rest = [c for c in labels.columns if c not in key]
    own = F.collect_list(F.struct(*rest))
    # one on foot so far must still board inside the window, which one that has boarded need not
    no_later = lambda y, x: F.coalesce(y["dep_s"] >= x["dep_s"], y["dep_s"].isNull() & x["dep_s"].isNull())
    beats = lambda y, x: no_later(y, x) & (y["t"] <= x["t"]) & (y["rides"] <= x["rides"]) & (y["walk_s"] <= x["walk_s"]) & ~(no_later(x, y) & (x["t"] <= y["t"]) & (x["rides"] <= y["rides"]) & (x["walk_s"] <= y["walk_s"]))
    # first the earliest of each departure, rides and walk, by partial aggregates: few labels are left to compare
    same = [*key, "dep_s", "rides", "walk_s"]
    best = labels.groupBy(*same).agg(F.min(F.struct("t", *[c for c in rest if c not in ("dep_s", "t", "rides", "walk_s")])).alias("__b")).select(*same, "__b.*").select(*key, *rest)
    kept = best.groupBy(*key).agg(own.alias("__x")).withColumn("__k", F.filter("__x", lambda x: ~F.exists("__x", lambda y: beats(y, x))))
    return kept.select(*key, F.inline("__k"))


def search(requests: DataFrame, rides: DataFrame, transfers: DataFrame | None, window: int, horizon: int, most_rides: int) -> DataFrame:
    """(request, dep_s, arr_s, rides, walk_s, legs): undominated journeys that leave within `window` and arrive within `horizon`.

    requests: (request, stop, destination, t); rides: (trip_id, from_stop, to_stop, dep_s, arr_s);
    transfers: (from_stop, to_stop, seconds) on foot, between rides, to the first and from the last.
    Both times count from the requested one. Exact: a label that is beaten at a stop cannot lead
    to a journey that is not beaten.
    """
    legs = F.array().cast(_LEG)
    text = lambda c: F.col(c).cast("string")
    long = lambda c: F.col(c).cast("bigint")
    # labels belong to the stop and time they start from, whoever asks and wherever to
    start = ["origin", "asked"]

    def walked(labels: DataFrame) -> DataFrame:
        if transfers is None:
            return labels
        steps = labels.join(transfers, labels["stop"] == transfers["from_stop"]).select(*start, F.col("to_stop").alias("stop"), "dep_s", (F.col("t") + F.col("seconds")).alias("t"), "rides", (F.col("walk_s") + F.col("seconds")).alias("walk_s"), "legs")
        return labels.unionByName(steps)

    starts = requests.select(F.col("stop").alias("origin"), long("t").alias("asked")).distinct()
    front = walked(starts.select(*start, F.col("origin").alias("stop"), F.lit(None).cast("bigint").alias("dep_s"), F.col("asked").alias("t"), F.lit(0).alias("rides"), F.lit(0).cast("bigint").alias("walk_s"), legs.alias("legs")))
    known = front = cut(undominated(front, [*start, "stop"]))
    for k in range(1, most_rides + 1):
        at = front.join(rides.withColumnsRenamed({"dep_s": "__d", "arr_s": "__a"}), front["stop"] == rides["from_stop"])
        first = (F.col("__d") < F.col("asked") + window) if k == 1 else F.lit(True)
        leg = F.struct(text("trip_id").alias("trip_id"), text("from_stop").alias("from_stop"), text("to_stop").alias("to_stop"), long("__d").alias("dep_s"), long("__a").alias("arr_s"))
        # a walk to the first stop leaves in time for its departure
        boarded = at.where((F.col("__d") >= F.col("t")) & first & (F.col("__a") <= F.col("asked") + horizon)).select(
            *start, F.col("to_stop").alias("stop"), F.coalesce("dep_s", long("__d") - F.col("walk_s")).alias("dep_s"), long("__a").alias("t"), (F.col("rides") + 1).alias("rides"), "walk_s", F.concat("legs", F.array(leg)).alias("legs")
        )
        known = cut(undominated(known.unionByName(walked(boarded)), [*start, "stop"]))
        front = known.where(F.col("rides") == k)
    goal = requests.select("request", F.col("stop").alias("origin"), long("t").alias("asked"), F.col("destination").alias("stop"))
    return known.where("rides > 0").join(goal, [*start, "stop"]).select("request", "dep_s", F.col("t").alias("arr_s"), "rides", "walk_s", "legs")


def plan(requests: DataFrame, rides: DataFrame, transfers: DataFrame | None = None, windows: tuple[int, ...] = (3600, 7200, 14400), horizon: int = 14400, most_rides: int = 3) -> DataFrame:
    """search() in the first window that finds a journey, with the window; only open requests go on to the next.

    Requests from one stop at one time to one destination find the same journeys, so that each such
    question is searched once and its journeys are given to all requests that ask it. Labels grow with
    the different questions, not with the requests.
    """
    asks = ["stop", "destination", "t"]
    questions = cut(requests.select(*asks).distinct().select(F.struct(*asks).alias("request"), *asks))
    open_, found = questions, None
    for w in windows:
        got = cut(search(open_, rides, transfers, w, w + horizon, most_rides).withColumn("window", F.lit(w)))
        found = got if found is None else found.unionByName(got)
        open_ = cut(open_.join(got.select("request").distinct(), "request", "left_anti"))
        if open_.isEmpty():
            break
    told = found.select(*[F.col(f"request.{c}").alias(c) for c in asks], *[c for c in found.columns if c != "request"])
    return requests.join(told, asks).select("request", *[c for c in found.columns if c != "request"])


def normalised(journeys: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds to journeys: asked, first_wait_s, waits_s (at changes, walks taken off), boardings, transfers, ride_s, elapsed_s, gaps.

    elapsed runs from the requested time and holds all waits; what is neither riding nor walking
    is waiting. gaps: changes whose next ride starts elsewhere, so that a walk lies between.
    """
    legs = F.col("legs")
    ride = F.aggregate(legs, F.lit(0).cast("bigint"), lambda s, x: s + x["arr_s"] - x["dep_s"])
    moved = F.zip_with(F.slice(legs, F.lit(1), F.greatest(F.size(legs) - 1, F.lit(0))), F.slice(legs, F.lit(2), F.greatest(F.size(legs) - 1, F.lit(0))), lambda a, b: F.when(a["to_stop"] != b["from_stop"], 1).otherwise(0))
    out = journeys.join(requests.select("request", F.col("t").cast("bigint").alias("asked")), "request")
    out = out.withColumns({"ride_s": ride, "boardings": F.size(legs), "transfers": F.size(legs) - 1, "first_wait_s": F.col("dep_s") - F.col("asked"), "elapsed_s": F.col("arr_s") - F.col("asked"), "gaps": F.aggregate(moved, F.lit(0), lambda s, x: s + x)})
    return out.withColumn("waits_s", F.col("elapsed_s") - F.col("first_wait_s") - F.col("ride_s") - F.col("walk_s"))


def ranked(journeys: DataFrame, preference: Column | str = "fastest", top: int = 6) -> DataFrame:
    """The best `top` journeys of each request as place 1, 2, ..; ties go to the later departure, then to the legs."""
    order = [F.col(c) for c in PREFERENCES[preference]] if isinstance(preference, str) else [F.when(preference == name, F.col(c[i])).otherwise(0) for name, c in PREFERENCES.items() for i in range(3)]
    w = Window.partitionBy("request").orderBy(*order, F.col("dep_s").desc(), F.to_json("legs"))
    return journeys.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
