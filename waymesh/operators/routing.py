"""Timetable routing as rounds of joins, itinerary handling, and travel-time matrices.

A round boards every reachable connection and keeps the earliest arrival for each (request,
stop): k rounds are journeys of up to k rides. Reached labels are small against the timetable;
each round's labels are written when a checkpoint folder is set, so plans do not grow.
"""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.clock import frequency_wait


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() where a folder is set, else the plan as it is."""
    spark = df.sparkSession
    return df.checkpoint() if spark.sparkContext.getConf().get("spark.checkpoint.dir") else df


def connections(stop_times: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(trip_id, from_stop, to_stop, dep_s, arr_s, end_s, headway, exact): every ride i < j of every trip.

    A trip with frequencies becomes one connection a band; its wait is bounded by the headway.
    """
    one = stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id", "arrival_s", "departure_s"))).alias("v"))
    first = one.select("trip_id", "v", F.posexplode("v").alias("i", "x"))
    ride = first.select("trip_id", F.col("v")[0]["departure_s"].alias("base"), "x", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("y"))
    c = ride.select("trip_id", F.col("x.stop_id").alias("from_stop"), F.col("y.stop_id").alias("to_stop"), F.col("x.departure_s").alias("dep_s"), F.col("y.arrival_s").alias("arr_s"), "base")
    none = F.lit(None).cast("int")
    if frequencies is None:
        return c.select("trip_id", "from_stop", "to_stop", "dep_s", "arr_s", none.alias("end_s"), none.alias("headway"), none.alias("exact"))
    f = frequencies.select("trip_id", "start_s", F.col("end_s").alias("band_end"), "headway_secs", "exact_times")
    both = c.join(f, "trip_id", "left")
    shift = F.col("start_s") - F.col("base")
    has = F.col("start_s").isNotNull()
    return both.select("trip_id", "from_stop", "to_stop", F.when(has, F.col("dep_s") + shift).otherwise(F.col("dep_s")).alias("dep_s"), F.when(has, F.col("arr_s") + shift).otherwise(F.col("arr_s")).alias("arr_s"), F.when(has, F.col("dep_s") - F.col("base") + F.col("band_end")).alias("end_s"), F.col("headway_secs").alias("headway"), F.col("exact_times").alias("exact"))


def _ridden(labels: DataFrame, rides: DataFrame) -> DataFrame:
    """Labels after one ride: scheduled trips from their departure, bands with their wait."""
    at = labels.join(rides, labels["stop"] == rides["from_stop"])
    wait = F.when(F.col("headway").isNull(), F.when(F.col("dep_s") >= F.col("t"), F.col("dep_s") - F.col("t"))).otherwise(frequency_wait(F.col("t"), F.col("dep_s"), F.col("end_s"), F.col("headway"), F.col("exact")))
    board = F.col("t") + wait
    return at.where(wait.isNotNull()).select("request", F.col("to_stop").alias("stop"), (board + F.col("arr_s") - F.col("dep_s")).cast("int").alias("t"), F.col("rides") + 1, F.concat("path", F.array(F.concat_ws("|", "trip_id", "from_stop", "to_stop"))).alias("path"))


def earliest(requests: DataFrame, rides: DataFrame, transfers: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """(request, stop, t, rides, path): earliest arrival at every stop within `rounds` rides.

    requests: (request, stop, t); transfers: (from_stop, to_stop, seconds). Ties prefer fewer
    rides, then the smaller path.
    """
    best = requests.select("request", "stop", F.col("t").cast("int").alias("t"), F.lit(0).alias("rides"), F.array().cast("array<string>").alias("path"))

    def improved(rows: DataFrame) -> DataFrame:
        return rows.groupBy("request", "stop").agg(F.min(F.struct("t", "rides", "path")).alias("x")).select("request", "stop", "x.*")

    def walked(rows: DataFrame) -> DataFrame:
        if transfers is None:
            return rows
        steps = rows.join(transfers, rows["stop"] == transfers["from_stop"]).select("request", F.col("to_stop").alias("stop"), (F.col("t") + F.col("seconds")).cast("int").alias("t"), "rides", "path")
        return improved(rows.unionByName(steps))

    best = walked(best)
    for _ in range(rounds):
        best = cut(walked(improved(best.union(_ridden(best, rides)))))
    return best


def plan(requests: DataFrame, rides: DataFrame, transfers: DataFrame | None = None, rounds: int = 3, windows: tuple[int, ...] = (3600, 7200, 14400)) -> DataFrame:
    """(request, t, rides, path, window) at each request's destination within the first window that finds any.

    requests: (request, stop, destination, t). A journey counts in a window when it arrives
    within it of the requested departure; the next, wider window only serves what is still open.
    """
    labels = earliest(requests.select("request", "stop", "t"), rides, transfers, rounds)
    goal = requests.select("request", F.col("destination").alias("stop"), F.col("t").alias("asked"))
    got = labels.where("rides > 0").join(goal, ["request", "stop"])
    spent = F.col("t") - F.col("asked")
    window = F.coalesce(*[F.when(spent <= w, F.lit(w)) for w in windows])
    return got.withColumn("window", window).where("window is not null").select("request", "t", "rides", "path", "window", spent.alias("elapsed"))


def recovery_requests(origins: DataFrame, destinations: DataFrame, most: int = 16) -> DataFrame:
    """Station pairs for constrained searches: nearest combinations of a request first, `most` of each."""
    pairs = origins.select("request", F.col("station").alias("board"), F.col("metres").alias("m1")).join(destinations.select("request", F.col("station").alias("alight"), F.col("metres").alias("m2")), "request").where("board <> alight")
    w = Window.partitionBy("request").orderBy(F.col("m1") + F.col("m2"), "board", "alight")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("m1", "m2")


def with_minute_search(found: DataFrame, minute: DataFrame, inexact: DataFrame) -> DataFrame:
    """Journeys (request, trips array, ..) plus, for requests that ride a trip of non-exact frequency, those of the one-minute search.

    A journey that both searches find comes once.
    """
    rides = found.select("request", F.explode("trips").alias("trip_id")).join(inexact.select("trip_id"), "trip_id", "left_semi")
    more = minute.join(rides.select("request").distinct(), "request", "left_semi").join(found.select("request", "trips"), ["request", "trips"], "left_anti")
    return found.unionByName(more)


def crawl(start: DataFrame, links: DataFrame, levels: int) -> tuple[DataFrame, bool]:
    """((node, level) reached breadth first over links (a, b), whether nothing was left after `levels`)."""
    seen = front = start.select("node").distinct().withColumn("level", F.lit(0)).persist()
    for k in range(1, levels + 1):
        new = front.join(links, front["node"] == links["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front = new.withColumn("level", F.lit(k)).persist()
        if front.isEmpty():
            return seen, True
        seen = cut(seen.union(front).persist())
    left = front.join(links, front["node"] == links["a"]).select(F.col("b").alias("node")).join(seen, "node", "left_anti")
    return seen, left.isEmpty()


def percentile_matrix(arrivals: DataFrame, share: float = 0.9) -> DataFrame:
    """(origin, destination, seconds): a percentile of travel time over departures; null unless every departure arrives."""
    return arrivals.groupBy("origin", "destination").agg(F.when(F.count("seconds") == F.count("*"), F.percentile("seconds", F.lit(share))).alias("seconds"))


def relax(edges: DataFrame, sources: DataFrame, steps: int) -> DataFrame:
    """(source, node, cost): cheapest cost over at most `steps` directed edges (a, b, w), by min-plus rounds."""
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("bigint").alias("cost"))
    for _ in range(steps):
        more = best.join(edges, best["node"] == edges["a"]).select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).cast("bigint").alias("cost"))
        best = cut(best.union(more).groupBy("source", "node").agg(F.min("cost").alias("cost")))
    return best


def dijkstra(arcs: dict, start, goals=None) -> tuple[dict, dict]:
    """(cost, previous) from start over {a: [(b, w)]}; stops when all goals are settled."""
    cost, back, done, heap = {start: 0}, {}, set(), [(0, start)]
    left = set(goals) if goals is not None else None
    while heap:
        c, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        if left is not None:
            left.discard(x)
            if not left:
                break
        for y, w in arcs.get(x, ()):
            if c + w < cost.get(y, float("inf")):
                cost[y], back[y] = c + w, x
                heapq.heappush(heap, (c + w, y))
    return cost, back


def shortest_in_groups(edges: DataFrame, wanted: DataFrame, group: str) -> DataFrame:
    """(group, a, b, cost, path) of wanted pairs in each group's own graph; one bounded group is a task.

    edges: (group, a, b, w) directed; wanted: (group, a, b). Unreachable pairs have null cost.
    """
    g = wanted.schema[group].dataType.simpleString()

    def run(key, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        arcs: dict = {}
        for a, b, w in zip(e["a"], e["b"], e["w"]):
            arcs.setdefault(a, []).append((b, w))
        out = []
        for a, own in q.groupby("a"):
            cost, back = dijkstra(arcs, a, own["b"].tolist())
            for b in own["b"]:
                path, x = [b], b
                while x in back and x != a:
                    x = back[x]
                    path.append(x)
                ok = b in cost
                out.append((key[0], a, b, cost.get(b), path[::-1] if ok else None))
        return pd.DataFrame(out, columns=[group, "a", "b", "cost", "path"])

    node = wanted.schema["a"].dataType.simpleString()
    return edges.groupBy(group).cogroup(wanted.groupBy(group)).applyInPandas(run, f"{group} {g}, a {node}, b {node}, cost double, path array<{node}>")


def trip_fold(legs: DataFrame, journey: str) -> DataFrame:
    """Ordered legs with stays: each starts when the one before has ended and its stay is over.

    legs: (journey, order, travel_s, stay_s, request_s). Adds start_s, end_s and the journey's total.
    """
    w = Window.partitionBy(journey).orderBy("order")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col("travel_s") + F.col("stay_s")).over(before), F.lit(0))
    first = F.min("request_s").over(Window.partitionBy(journey))
    return legs.withColumns({"start_s": first + spent, "end_s": first + spent + F.col("travel_s")})
