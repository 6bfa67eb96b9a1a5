"""Railway evidence and compilation from recorded journeys.

Journeys are rows (origin, destination, total_s, conditional, nodes) with nodes an array of
struct(station, line, t_min, link): link is RIDE, WALK or END, t_min minutes from departure.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.clock import minutes_to_seconds
from waymesh.operators.aggregates import consensus


def same_train(journeys: DataFrame) -> DataFrame:
    """(origin, edge, seconds): hops observed inside one ride.

    Of three consecutive nodes the first two ride the same line and the third rides it or ends;
    the first ridden edge of a journey, interchange edges and conditional journeys do not count;
    a hop takes half a minute to twenty minutes.
    """
    n = journeys.where(~F.coalesce("conditional", F.lit(False))).select("origin", "destination", F.posexplode("nodes").alias("i", "x")).select("origin", "destination", "i", "x.*")
    w = Window.partitionBy("origin", "destination").orderBy("i")
    p = n.withColumns({"p_line": F.lag("line").over(w), "p_link": F.lag("link").over(w), "n_station": F.lead("station").over(w), "n_line": F.lead("line").over(w), "n_link": F.lead("link").over(w), "n_t": F.lead("t_min").over(w)})
    ride = (F.col("p_link") == "RIDE") & (F.col("link") == "RIDE") & (F.col("p_line") == F.col("line")) & (((F.col("n_link") == "RIDE") & (F.col("n_line") == F.col("line"))) | (F.col("n_link") == "END"))
    hop = F.col("n_t") - F.col("t_min")
    return p.where(ride & hop.between(0.5, 20)).select("origin", F.concat_ws(":", "line", F.concat("station", F.lit(">"), "n_station")).alias("edge"), minutes_to_seconds(hop).alias("seconds"))


def segment_evidence(journeys: DataFrame, least: int = 3, share: float = 0.9) -> DataFrame:
    """Consensus seconds of every edge, one vote an origin."""
    return consensus(same_train(journeys), "edge", "origin", "seconds", least, share)


def prefix_evidence(paths: DataFrame) -> DataFrame:
    """(edge, origin, seconds) from a path's total minus its exact prefix's, 30..1200 s.

    paths: (origin, path array<string>, total_s, lines array<array<string>>, the lines of each
    station); the difference counts for every line both stations of the last hop are on.
    """
    short = paths.select(F.col("origin").alias("__o"), F.col("path").alias("__p"), F.col("total_s").alias("__t"))
    n = F.size("path")
    got = paths.where(n > 1).join(short, (F.col("origin") == F.col("__o")) & (F.slice("path", F.lit(1), n - 1) == F.col("__p")))
    delta = (F.col("total_s") - F.col("__t")).cast("int")
    line = F.explode(F.array_intersect(F.element_at("lines", -1), F.element_at("lines", -2)))
    return got.withColumn("seconds", delta).where(F.col("seconds").between(30, 1200)).withColumn("line", line).select(F.concat_ws(":", "line", F.concat(F.element_at("path", -2), F.lit(">"), F.element_at("path", -1))).alias("edge"), "origin", "seconds")


def all_pairs(trips: DataFrame, costs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every i < j of a trip as a connection with its own journey's cost; (connections, missing).

    trips: (trip_id, line, stops array<string>, departures array<int>); costs: (path_key, total_s).
    A pair without an exact path has no connection: costs are never subtracted.
    """
    n = F.size("stops")
    index = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    pairs = trips.where(n > 1).withColumn("p", F.explode(index)).select("*", "p.i", "p.j")
    key = F.concat_ws(":", "line", F.array_join(F.slice("stops", F.col("i") + 1, F.col("j") - F.col("i") + 1), ">"))
    cost = costs.groupBy("path_key").agg(F.min("total_s").alias("total_s"))
    got = pairs.withColumn("path_key", key).join(cost, "path_key", "left")
    full = (F.col("i") == 0) & (F.col("j") == n - 1)
    name = F.when(full, F.col("trip_id")).otherwise(F.concat_ws(":", "trip_id", F.lit("OD"), F.col("i").cast("string"), F.col("j").cast("string")))
    start = F.element_at("departures", F.col("i") + 1)
    out = got.where("total_s is not null").select(F.col("trip_id").alias("parent_id"), name.alias("trip_id"), F.element_at("stops", F.col("i") + 1).alias("from_stop"), F.element_at("stops", F.col("j") + 1).alias("to_stop"), start.alias("departure_s"), (start + F.col("total_s")).alias("arrival_s"), (start - F.col("departures")[0]).alias("shift_s"))
    return out, got.where("total_s is null").select("trip_id", "i", "j", "path_key")


def shift_bands(connections: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The parents' bands for each connection, moved by its boarding offset."""
    f = frequencies.withColumnRenamed("trip_id", "parent_id")
    return connections.select("trip_id", "parent_id", "shift_s").join(f, "parent_id").select("trip_id", (F.col("start_s") + F.col("shift_s")).alias("start_s"), (F.col("end_s") + F.col("shift_s")).alias("end_s"), "headway_secs", "exact_times")


def apply_edges(stop_times: DataFrame, evidence: DataFrame, edge) -> DataFrame:
    """stop_times (trip_id, stop_sequence, stop_id, arrival_s, departure_s) re-timed with evidence seconds where an edge has them."""
    from waymesh.operators.sequences import propagate

    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    keyed = stop_times.withColumn("__from", F.lag("stop_id").over(w)).withColumn("edge", edge(F.col("__from"), F.col("stop_id")))
    known = evidence.where("accepted").select("edge", F.col("value").alias("edge_s"))
    return propagate(keyed.join(known, "edge", "left").drop("edge", "__from"), "trip_id", "stop_sequence").drop("edge_s")


def branch_variants(notes: DataFrame) -> DataFrame:
    """(path_id, variant): a service note 'A or B' makes a variant of each branch."""
    return notes.select("path_id", F.explode(F.transform(F.split("note", r"(?i)\s+or\s+|/"), lambda x: F.trim(x))).alias("variant")).where("variant <> ''")
