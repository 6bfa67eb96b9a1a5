"""Ordered-sequence operators: edges, anchors, folds with clamps, sections and waits.

Plain differences and running sums are window functions. What depends on the result for the row
before (clamps, rollovers) is a fold, `aggregate()`, over the sorted array of one sequence: it
stays in the JVM, and a trip is one bounded row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(rows: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_<column> of the row before in the group."""
    by = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(by) for c in columns})


def running(rows: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    by = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(column).over(by))


def clamp_fill(begin: Column, finish: Column, shares: Column) -> Column:
    """Times of the interior places of a span at the given shares (0..1) of its duration.

    Rounded half to even, each at least a second after the one before and early enough that
    every later place keeps a second.
    """
    n = F.size(shares)
    places = F.transform(shares, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    start = F.struct(begin.cast("int").alias("prev"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        raw = F.bround(begin + (finish - begin) * p["s"]).cast("int")
        t = F.greatest(acc["prev"] + 1, F.least(raw, (finish - (n - p["i"])).cast("int")))
        return F.struct(t.cast("int").alias("prev"), F.array_append(acc["out"], t.cast("int")).alias("out"))

    return F.aggregate(places, start, step, lambda acc: acc["out"])


def interpolate(visits: DataFrame, trip: str = "trip_id", seq: str = "stop_sequence") -> DataFrame:
    """Fill blank times between anchors in proportion to distance.

    visits: (trip, seq, arrival_s, departure_s, distance). A visit with one of its times gets the
    other; visits with both are anchors and stay as they are. The first and last visit must be
    anchors, distance must grow over a span that has blanks, and it must leave a second a hop,
    else the whole trip comes back unchanged with a reason. `timepoint` is 0 where filled.
    """
    v = visits.select(trip, seq, F.coalesce("arrival_s", "departure_s").cast("int").alias("arr"), F.coalesce("departure_s", "arrival_s").cast("int").alias("dep"), F.col("distance").cast("double").alias("distance"), (F.col("arrival_s").isNotNull() & F.col("departure_s").isNotNull()).alias("full"))
    by = Window.partitionBy(trip).orderBy(seq)
    anchored = v.withColumn("anchor", F.col("arr").isNotNull())
    upto, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    at = F.struct("arr", "dep", "distance", seq)
    marked = anchored.withColumns({
        "left": F.last(F.when(F.col("anchor"), at), ignorenulls=True).over(upto),
        "right": F.first(F.when(F.col("anchor"), at), ignorenulls=True).over(after),
        "span": F.sum(F.col("anchor").cast("int")).over(upto),
    })
    whole = Window.partitionBy(trip)
    hops = F.count("*").over(Window.partitionBy(trip, "span")).cast("int")
    blank = ~F.col("anchor")
    bad = F.when(F.col("left").isNull() | F.col("right").isNull(), "no_end_anchor").when(F.col("right.distance") - F.col("left.distance") <= 0, "no_distance").when(F.col("right.arr") - F.col("left.dep") < hops, "too_short")
    judged = marked.withColumn("__bad", F.when(blank, bad)).withColumn("reason", F.min("__bad").over(whole))
    filled = judged.where(blank & F.col("reason").isNull()).groupBy(trip, "span", "left", "right").agg(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col("distance")))).alias("v"))
    share = F.transform("v", lambda x: (x["distance"] - F.col("left.distance")) / (F.col("right.distance") - F.col("left.distance")))
    times = filled.withColumn("t", clamp_fill(F.col("left.dep"), F.col("right.arr"), share))
    flat = times.select(trip, F.explode(F.arrays_zip(F.transform("v", lambda x: x[seq]).alias("s"), F.col("t"))).alias("x")).select(trip, F.col("x.s").alias(seq), F.col("x.t").alias("__t"))
    out = judged.join(flat, [trip, seq], "left")
    return out.select(trip, seq, F.coalesce("__t", "arr").alias("arrival_s"), F.coalesce("__t", "dep").alias("departure_s"), "distance", F.when(F.col("full"), 1).otherwise(0).alias("timepoint"), "reason")


def reweight(visits: DataFrame, weights: DataFrame, trip: str = "trip_id", seq: str = "stop_sequence") -> tuple[DataFrame, DataFrame]:
    """Replace interior times of spans by historical proportions; (visits, report of spans).

    visits: (trip, seq, t, anchor, supplied, distance); weights: (trip, seq, w, conflict), the
    seconds of the hop that ends at seq. A span between neighbouring anchors of two or more hops
    is accepted as a whole or rejected for the first reason of: conflicting_pair,
    missing_or_invalid_weight (5..3960 s), ratio (a second a hop, and sum of weights within
    2/3..1.5 of the duration), no_distance, speed (1..100 km/h on hops beyond 100 m), supplied.
    """
    by = Window.partitionBy(trip).orderBy(seq)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    v = visits.join(weights, [trip, seq], "left").withColumn("span", F.sum(F.col("anchor").cast("int")).over(before))
    lead = v.where("anchor").select(trip, F.col(seq).alias("s0"), F.col("t").alias("t0"), F.col("distance").alias("d0"), F.sum(F.lit(1)).over(Window.partitionBy(trip).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)).alias("span"))
    item = F.struct(F.col(seq).alias("s"), "t", F.col("w").cast("double").alias("w"), "conflict", "supplied", "distance", "anchor")
    spans = v.where("span > 0").groupBy(trip, "span").agg(F.array_sort(F.collect_list(item)).alias("v")).join(lead, [trip, "span"])
    spans = spans.where((F.size("v") >= 2) & F.element_at("v", -1)["anchor"])
    end = F.element_at("v", -1)
    duration = end["t"] - F.col("t0")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x["w"], F.lit(0.0)))
    upto = F.transform("v", lambda x, i: F.aggregate(F.slice("v", F.lit(1), i + 1), F.lit(0.0), lambda s, y: s + F.coalesce(y["w"], F.lit(0.0))))
    inner = F.slice(upto, F.lit(1), F.size("v") - 1)
    spans = spans.withColumns({"total": total, "duration": duration, "new": clamp_fill(F.col("t0"), end["t"], F.transform(inner, lambda c: c / total))})
    clocks = F.concat(F.array(F.col("t0")), F.col("new"), F.array(end["t"]))
    places = F.concat(F.array(F.col("d0")), F.transform("v", lambda x: x["distance"]))
    hop = F.transform(F.sequence(F.lit(1), F.size("v")), lambda k: F.struct((F.element_at(places, k + 1) - F.element_at(places, k)).alias("m"), (F.element_at(clocks, k + 1) - F.element_at(clocks, k)).alias("s")))
    reason = (
        F.when(F.exists("v", lambda x: F.coalesce(x["conflict"], F.lit(False))), "conflicting_pair")
        .when(F.exists("v", lambda x: ~F.coalesce(x["w"].between(5, 3960), F.lit(False))), "missing_or_invalid_weight")
        .when((F.col("duration") < F.size("v")) | ~(F.col("total") / F.col("duration")).between(2 / 3, 1.5), "ratio")
        .when(F.exists(places, lambda d: d.isNull()), "no_distance")
        .when(F.exists(hop, lambda h: (h["m"] > 100) & ~(h["m"] / h["s"] * 3.6).between(1, 100)), "speed")
        .when(F.exists(F.slice("v", F.lit(1), F.size("v") - 1), lambda x: F.coalesce(x["supplied"], F.lit(False))), "supplied")
    )
    judged = spans.withColumn("reason", reason)
    new = judged.where("reason is null").select(trip, F.explode(F.arrays_zip(F.transform(F.slice("v", F.lit(1), F.size("v") - 1), lambda x: x["s"]).alias("s"), F.col("new").alias("n"))).alias("x")).select(trip, F.col("x.s").alias(seq), F.col("x.n").alias("__t"))
    out = visits.join(new, [trip, seq], "left").withColumn("t", F.coalesce("__t", "t")).drop("__t")
    report = judged.select(trip, F.col("s0").alias("from_seq"), F.size("v").alias("hops"), "total", "duration", (~(F.col("total") / F.col("duration")).between(2 / 3, 1.5)).alias("total_conflict"), "reason")
    return out, report


def rollover(clocks: Column) -> Column:
    """struct(out, error): clocks of a column read downwards, moved on a day once midnight passes.

    A step back counts as midnight once, from 18:00 or later to before 06:00; any other is an
    error of the whole list.
    """
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("shift"), F.array().cast("array<int>").alias("out"), F.lit(False).alias("error"))

    def step(acc: Column, v: Column) -> Column:
        back = F.coalesce(v + acc["shift"] < acc["last"], F.lit(False))
        night = (acc["shift"] == 0) & (acc["last"] % 86_400 >= 64_800) & (v < 21_600)
        shift = acc["shift"] + F.when(back & night, 86_400).otherwise(0)
        return F.struct((v + shift).cast("int").alias("last"), shift.cast("int").alias("shift"), F.array_append(acc["out"], (v + shift).cast("int")).alias("out"), (acc["error"] | (back & ~night)).alias("error"))

    return F.aggregate(clocks, start, step, lambda acc: F.struct(F.when(~acc["error"], F.array_sort(F.array_distinct(acc["out"]))).alias("out"), acc["error"].alias("error")))


def midnight_bands(bands: Column) -> Column:
    """Bands struct(start, end) by source sequence: one that starts where the last ended past 24:00 goes on from there."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        on = F.coalesce((acc["last"] >= 86_400) & (b["start"] == acc["last"] - 86_400), F.lit(False))
        shift = F.when(on, 86_400).otherwise(0)
        a, e = (b["start"] + shift).cast("int"), (F.when(b["end"] < b["start"], b["end"] + 86_400).otherwise(b["end"]) + shift).cast("int")
        return F.struct(e.alias("last"), F.array_append(acc["out"], F.struct(a.alias("start"), e.alias("end"))).alias("out"))

    return F.aggregate(bands, start, step, lambda acc: acc["out"])


def collapse_repeats(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """Only the first of consecutive rows with equal values (null equals null)."""
    by = Window.partitionBy(*group).orderBy(*order)
    marked = rows.withColumns({"__n": F.row_number().over(by), "__p": F.lag(column).over(by)})
    return marked.where((F.col("__n") == 1) | ~F.col(column).eqNullSafe(F.col("__p"))).drop("__n", "__p")


def sections(rows: DataFrame, group: list[str], order: list[str], boundary: Column) -> DataFrame:
    """Adds `section`: the number of boundary rows up to here; boundary rows also end the section before (shared)."""
    by = Window.partitionBy(*group).orderBy(*order)
    numbered = rows.withColumns({"__b": F.coalesce(boundary, F.lit(False)).cast("int"), "__n": F.row_number().over(by)})
    numbered = numbered.withColumn("section", F.sum("__b").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    shared = F.when((F.col("__b") == 1) & (F.col("__n") > 1), F.array(F.col("section") - 1, F.col("section"))).otherwise(F.array("section"))
    return numbered.withColumn("section", F.explode(shared)).drop("__b", "__n")


def waits(legs: DataFrame, journey: str, order: str) -> DataFrame:
    """Per journey: initial_wait, transfer_wait, boardings, transfers, elapsed from the request.

    legs: (journey, order, start_s, end_s, transit, request_s). The gap before the first boarding
    is the initial wait, gaps before later ones are transfer waits.
    """
    by = Window.partitionBy(journey).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    g = legs.withColumns({"gap": F.col("start_s") - F.coalesce(F.lag("end_s").over(by), F.col("request_s")), "boarding": F.sum(F.col("transit").cast("int")).over(upto)})
    first = F.col("transit") & (F.col("boarding") == 1)
    return g.groupBy(journey).agg(
        F.coalesce(F.sum(F.when(first, F.col("gap"))), F.lit(0)).alias("initial_wait"), F.coalesce(F.sum(F.when(F.col("transit") & ~first, F.col("gap"))), F.lit(0)).alias("transfer_wait"),
        F.sum(F.col("transit").cast("int")).alias("boardings"), F.greatest(F.lit(0), F.sum(F.col("transit").cast("int")) - 1).alias("transfers"),
        (F.max("end_s") - F.min("request_s")).alias("elapsed"),
    )


def idle(events: DataFrame, worker: list[str], a: str, b: str, low: Column, high: Column) -> DataFrame:
    from .intervals import complement

    return complement(events, worker, low, high, a, b)


def bracket(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Adds `filled`: value where known, linear between the known neighbours by order, else null."""
    by = Window.partitionBy(*group).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    got = rows.withColumns({"__l": F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "__r": F.first(known, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("__l.y") + (F.col("__r.y") - F.col("__l.y")) * (F.col(order) - F.col("__l.x")) / (F.col("__r.x") - F.col("__l.x"))
    return got.withColumn("filled", F.coalesce(value, F.when(F.col("__r.x") > F.col("__l.x"), line))).drop("__l", "__r")


def last_n(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    by = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= n).drop("__r")


def propagate(rows: DataFrame, trip: str, seq: str) -> DataFrame:
    """New arrival and departure from replaced edge seconds and kept dwell: running sum from the first departure."""
    by = Window.partitionBy(trip).orderBy(seq)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("departure_s").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hop = F.coalesce(F.col("edge_s"), F.col("arrival_s") - F.lag("departure_s").over(by), F.lit(0))
    dwell = F.when(F.lag(seq).over(by).isNull(), 0).otherwise(F.col("departure_s") - F.col("arrival_s"))
    moved = rows.withColumns({"__h": hop, "__d": dwell, "__f": first})
    return moved.withColumns({"departure_s": (F.col("__f") + F.sum(F.col("__h") + F.col("__d")).over(upto)).cast("int"), "arrival_s": (F.col("__f") + F.sum(F.col("__h") + F.col("__d")).over(upto) - F.col("__d")).cast("int")}).drop("__h", "__d", "__f")
