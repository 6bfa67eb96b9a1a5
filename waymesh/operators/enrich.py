"""Feed stages: base rail tables, coordinates, identity, geographic enrichment, indoor networks, provenance.

Each stage is dict of tables in, dict of tables out; what is refused comes back with a reason.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import clock, geo, structs, text
from waymesh.operators import matching, routing, sequences, spatial


def resolve_coordinates(stations: DataFrame, official: DataFrame, cache: DataFrame, osm: DataFrame, far: float = 500.0) -> DataFrame:
    """(station, lat, lon, tier): official, else cached unless OSM lies over `far` metres off, else OSM; else an error row."""
    put = lambda d, p: d.select("station", F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    got = stations.join(put(official, "o"), "station", "left").join(put(cache, "c"), "station", "left").join(put(osm, "m"), "station", "left")
    off = geo.haversine(F.col("c_lat"), F.col("c_lon"), F.col("m_lat"), F.col("m_lon"))
    tier = F.when(F.col("o_lat").isNotNull(), "official").when(F.col("c_lat").isNotNull() & F.col("m_lat").isNotNull() & (off > far), "osm_replaces_cache").when(F.col("c_lat").isNotNull(), "cache").when(F.col("m_lat").isNotNull(), "osm").otherwise("missing")
    pick = lambda axis: F.when(tier == "official", F.col(f"o_{axis}")).when(tier == "cache", F.col(f"c_{axis}")).when(tier != "missing", F.col(f"m_{axis}"))
    return got.select("station", pick("lat").alias("lat"), pick("lon").alias("lon"), tier.alias("tier"))


def base_rail(lines: DataFrame, stations: DataFrame, hours: DataFrame, headways: DataFrame, edges: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """Rail tables (routes, trips, stop_times, frequencies) of line sequences.

    lines: (line, direction, seq, station); stations: (station, lat, lon); hours: (line, start_s,
    end_s); headways: (line, headway_s); edges: (edge, value, accepted) evidence. Hops without
    accepted evidence are estimated from the distance, which strict mode refuses.
    """
    w = Window.partitionBy("line", "direction").orderBy("seq")
    p = lines.join(stations, "station").withColumns({"from": F.lag("station").over(w), "la": F.lag("lat").over(w), "lo": F.lag("lon").over(w)})
    hop = geo.running_seconds(geo.haversine(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")))
    p = p.withColumn("edge", F.concat_ws(":", "line", F.concat("from", F.lit(">"), "station")))
    known = edges.where("accepted").select("edge", F.col("value").alias("known")) if edges is not None else None
    p = p.join(known, "edge", "left") if known is not None else p.withColumn("known", F.lit(None).cast("int"))
    missing = F.col("from").isNotNull() & F.col("known").isNull()
    if strict:
        hop = F.when(missing, F.raise_error(F.concat(F.lit("no evidence for "), "edge")).cast("int")).otherwise(hop)
    p = p.withColumn("hop", F.when(F.col("from").isNull(), 0).otherwise(F.coalesce("known", hop)))
    trip = F.concat_ws(":", F.lit("RAIL"), F.lit("MTR"), "line", "direction")
    run = p.join(hours.select("line", "start_s"), "line").withColumns({"trip_id": trip, "t": (F.col("start_s") + F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")})
    stop_times = run.select("trip_id", F.col("t").alias("arrival_s"), F.col("t").alias("departure_s"), F.concat_ws(":", F.lit("RAIL"), F.lit("MTR"), "station", "line").alias("stop_id"), F.col("seq").alias("stop_sequence"), F.when(missing, "estimated").otherwise("evidence").alias("timing"))
    ids = lines.select("line", "direction").distinct().withColumn("trip_id", trip)
    return {
        "routes": lines.select("line").distinct().select(F.concat(F.lit("RAIL:MTR:"), "line").alias("route_id"), F.col("line").alias("route_short_name"), F.lit(1).alias("route_type")),
        "trips": ids.select(F.concat(F.lit("RAIL:MTR:"), "line").alias("route_id"), "trip_id", F.col("direction").alias("direction_id")),
        "stop_times": stop_times,
        "frequencies": ids.join(hours, "line").join(headways, "line").select("trip_id", "start_s", "end_s", F.col("headway_s").alias("headway_secs"), F.lit(0).alias("exact_times")),
    }


def transfer_links(stops: DataFrame, metres: float = 500.0) -> DataFrame:
    """(from_stop_id, to_stop_id, kind): platforms of one parent, and same-named stations within `metres`."""
    a = stops.select(F.col("stop_id").alias("from_stop_id"), "parent_station", "name_key", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = stops.select(F.col("stop_id").alias("to_stop_id"), F.col("parent_station").alias("p2"), F.col("name_key").alias("k2"), F.col("lat").alias("lb"), F.col("lon").alias("lc"))
    inside = a.join(b, F.col("parent_station") == F.col("p2")).where("from_stop_id <> to_stop_id").select("from_stop_id", "to_stop_id", F.lit("platform").alias("kind"))
    near = a.join(b, F.col("name_key") == F.col("k2")).where("from_stop_id <> to_stop_id and not (parent_station <=> p2)").where(geo.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lc")) <= metres).select("from_stop_id", "to_stop_id", F.lit("station").alias("kind"))
    return inside.union(near)


def patterns(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """(pattern_key, route_id, stop_ids, directions, trip_count): distinct ordered stop lists."""
    seq = stop_times.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))), lambda x: x["stop_id"]).alias("stop_ids"))
    keyed = trips.select("trip_id", "route_id", "direction_id").join(seq, "trip_id").withColumn("pattern_key", structs.pattern_key(F.col("route_id"), F.col("stop_ids")))
    return keyed.groupBy("pattern_key", "route_id", "stop_ids").agg(F.array_sort(F.collect_set("direction_id")).alias("directions"), F.count("*").alias("trip_count"))


def identify(feed: DataFrame, official: DataFrame, fallback: DataFrame) -> DataFrame:
    """(pattern_key, match, source, reason): one operator pattern for each feed pattern, or why not.

    All have operator, route and stops array<struct<lat, lon, name>>; feed has pattern_key, the
    others signature. If the official inventory has the operator, only its patterns count. One
    distinct fitting signature is a match; more are ambiguous.
    """
    inventory = official.select("operator").distinct().withColumn("__in", F.lit(True))
    pool = official.withColumn("source", F.lit("official")).unionByName(fallback.join(inventory.select("operator"), "operator", "left_anti").withColumn("source", F.lit("fallback")))
    c = pool.select(F.col("operator").alias("__op"), F.col("route").alias("__route"), F.col("stops").alias("__stops"), "signature", "source")
    at = feed.join(c, (F.col("operator") == F.col("__op")) & (F.col("route") == F.col("__route")) & (F.size("stops") == F.size("__stops")), "left")
    fit = at.withColumn("fit", F.coalesce(matching.stops_agree(F.col("stops"), F.col("__stops")), F.lit(False)))
    got = fit.groupBy("pattern_key", "operator").agg(F.count_distinct(F.when(F.col("fit"), F.col("signature"))).alias("n"), F.min(F.when(F.col("fit"), F.col("signature"))).alias("m"), F.min(F.when(F.col("fit"), F.col("source"))).alias("source"), F.count("signature").alias("seen"))
    got = got.join(inventory, "operator", "left")
    reason = F.when(F.col("n") == 1, None).when(F.col("n") > 1, "ambiguous_service_variants").when(F.col("__in") & (F.col("seen") == 0), "absent_from_official_inventory").when(F.col("__in"), "official_conflict").when(F.col("seen") > 0, "no_verified_sequence").otherwise("no_candidate")
    one = F.col("n") == 1
    return got.select("pattern_key", F.when(one, F.col("m")).alias("match"), F.when(one, F.col("source")).alias("source"), reason.alias("reason"))


def geometry_veto(parts: DataFrame) -> DataFrame:
    """(pair, n, conflict): stop pairs whose lines (array<struct<x, y>>) disagree with the first by operator order."""
    import numpy as np

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("operator", kind="stable")
        lines = [np.array([(p["x"], p["y"]) for p in line]) for line in frame["line"]]
        bad = any(geo.geometry_conflict(lines[0], other) for other in lines[1:])
        return pd.DataFrame({"pair": [frame["pair"].iloc[0]], "n": [len(frame)], "conflict": [bad]})

    return parts.groupBy("pair").applyInPandas(run, "pair string, n bigint, conflict boolean")


def geographic(stations: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, withheld): venues joined by exact name key; a key with two venues or two stations is withheld."""
    s = stations.withColumn("key", text.station_key(F.col("name")))
    v = venues.withColumn("key", text.station_key(F.col("venue_name")))
    ones = s.groupBy("key").agg(F.count("*").alias("ns")).join(v.groupBy("key").agg(F.count("*").alias("nv")), "key")
    good = ones.where("ns = 1 and nv = 1").select("key")
    matched = s.join(good, "key").join(v.drop("name"), "key")
    held = s.join(good, "key", "left_anti").join(ones, "key", "left").select("station", F.when(F.col("nv").isNull(), "no_venue").otherwise("ambiguous").alias("reason"))
    return matched, held


def indoor_edges(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects) of features (venue, id, a, b, mode, metres, rise, direction, enabled, known_type, restricted).

    First failing rule decides: geometry, disabled, direction, type, time restriction. Direction
    -1 turns an edge, 0 makes it run both ways. A lift that rises under 5 mm is walking.
    """
    reason = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b")), "geometry").when(~F.coalesce("enabled", F.lit(False)), "disabled").when(~F.coalesce(F.col("direction").isin(-1, 0, 1), F.lit(False)), "direction").when(~F.coalesce("known_type", F.lit(False)), "type").when(F.coalesce("restricted", F.lit(False)), "time_restricted")
    judged = features.withColumn("reason", reason).withColumn("mode", F.when((F.col("mode") == "lift") & (F.abs("rise") <= 0.005), "walk").otherwise(F.col("mode")))
    good = judged.where("reason is null").withColumn("w", geo.edge_seconds(F.col("mode"), F.col("metres"), F.col("rise")))
    on = good.where("direction >= 0").select("venue", "a", "b", "w", "mode")
    back = good.where("direction <= 0").select("venue", F.col("b").alias("a"), F.col("a").alias("b"), "w", "mode")
    return on.unionByName(back), judged.where("reason is not null").select("venue", "id", "reason")


def collapse_lifts(edges: DataFrame, wait: int = 20) -> DataFrame:
    """Chains of two-way lift edges through nodes of degree two become one edge with one wait; a venue is a task."""
    venue, node = edges.schema["venue"].dataType.simpleString(), edges.schema["a"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        arcs = {(a, b): (w, m) for a, b, w, m in zip(frame["a"], frame["b"], frame["w"], frame["mode"])}
        near: dict = {}
        for a, b in arcs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for x in sorted(near):
            own = sorted(near[x])
            if len(own) != 2:
                continue
            a, b = own
            pairs = [(a, x), (x, a), (x, b), (b, x)]
            if a == b or any(p not in arcs or arcs[p][1] != "lift" for p in pairs) or (a, b) in arcs or (b, a) in arcs:
                continue
            arcs[a, b] = (arcs[a, x][0] + arcs[x, b][0] - wait, "lift")
            arcs[b, a] = (arcs[b, x][0] + arcs[x, a][0] - wait, "lift")
            for p in pairs:
                del arcs[p]
            near[a].discard(x)
            near[b].discard(x)
            near[a].add(b)
            near[b].add(a)
            near[x] = set()
        v = frame["venue"].iloc[0]
        return pd.DataFrame([(v, a, b, w, m) for (a, b), (w, m) in sorted(arcs.items())], columns=["venue", "a", "b", "w", "mode"])

    return edges.groupBy("venue").applyInPandas(run, f"venue {venue}, a {node}, b {node}, w int, mode string")


def indoor_paths(edges: DataFrame, entrances: DataFrame, platforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pathways, status): cheapest ways between entrances and platforms that exist both ways.

    entrances, platforms: (venue, node). A venue is withheld without a connected pair, partial if
    any pair is missing, else activated.
    """
    e, p = entrances.select("venue", F.col("node").alias("e")), platforms.select("venue", F.col("node").alias("p"))
    pairs = e.join(p, "venue")  # within one venue: its few entrances and platforms
    wanted = pairs.select("venue", F.col("e").alias("a"), F.col("p").alias("b")).union(pairs.select("venue", F.col("p").alias("a"), F.col("e").alias("b")))
    got = routing.shortest_in_groups(edges.select("venue", "a", "b", "w"), wanted, "venue")
    back = got.select(F.col("venue").alias("v2"), F.col("a").alias("b2"), F.col("b").alias("a2"), F.col("cost").alias("back"))
    both = got.join(back, (F.col("venue") == F.col("v2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).where("cost is not null and back is not null").select("venue", "a", "b", F.col("cost").cast("int").alias("traversal_time"), "path")
    total, good = pairs.groupBy("venue").agg(F.count("*").alias("n")), both.groupBy("venue").agg((F.count("*") / 2).alias("k"))
    status = total.join(good, "venue", "left").select("venue", F.when(F.coalesce("k", F.lit(0)) == 0, "withheld").when(F.col("k") < F.col("n"), "partial").otherwise("activated").alias("status"))
    return both, status


def rebind_stops(stop_times: DataFrame, platforms: DataFrame) -> DataFrame:
    """Stops replaced by the physical platform of their context (trip, stop, endpoint), where one is known."""
    p = platforms.select("trip_id", "stop_id", "stop_sequence", F.col("platform_id").alias("__p"))
    return stop_times.join(p, ["trip_id", "stop_id", "stop_sequence"], "left").withColumn("stop_id", F.coalesce("__p", "stop_id")).drop("__p")


def leg_provenance(legs: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Legs with a struct of each source's evidence and the list of their warnings.

    sources: name -> (trip_id, url, revision, warning); a leg without evidence keeps null.
    """
    out, warnings = legs, []
    for name, frame in sources.items():
        one = frame.groupBy("trip_id").agg(F.struct(F.min("url").alias("url"), F.max("revision").alias("revision")).alias(name), F.array_sort(F.collect_set("warning")).alias(f"__{name}"))
        out = out.join(one, "trip_id", "left")
        warnings.append(F.coalesce(f"__{name}", F.array().cast("array<string>")))
    return out.withColumn("warnings", F.array_distinct(F.flatten(F.array(*warnings)))).drop(*[f"__{n}" for n in sources])


def place_index(stops: DataFrame, named: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(place_id, name, kind, lat, lon, details): stops without children, named features, and the nearest landmark within 600 m.

    stops: (stop_id, stop_name, lat, lon, parent_station, modes array); named: (osm_id, tags map, lat, lon).
    """
    own = stops.where("parent_station is null").where(geo.inside(F.col("lat"), F.col("lon"))).select(F.concat(F.lit("stop:"), "stop_id").alias("place_id"), F.col("stop_name").alias("name"), F.lit("stop").alias("kind"), "lat", "lon", text.joined(F.array_sort("modes")).alias("details"))
    kind = text.place_kind(F.col("tags"))
    other = named.where(geo.inside(F.col("lat"), F.col("lon"))).select(F.concat(F.lit("osm:"), F.col("osm_id").cast("string")).alias("place_id"), F.coalesce(F.try_element_at("tags", F.lit("name:en")), F.try_element_at("tags", F.lit("name"))).alias("name"), kind["kind"].alias("kind"), "lat", "lon", text.joined(F.array(kind["details"], text.address(F.col("tags")))).alias("details")).where("name is not null")
    both = own.unionByName(other)
    near = spatial.nearest(both.select("place_id", "lat", "lon"), landmarks.select("landmark", "lat", "lon"), "place_id", "landmark", 600.0)
    return both.join(near, "place_id", "left").withColumn("details", text.joined(F.array("details", F.concat(F.lit("near "), "landmark", F.lit(" "), geo.round_ten(F.col("metres")).cast("string"), F.lit(" m"))))).drop("landmark", "metres")


def surface_timing(visits: DataFrame, distances: DataFrame) -> DataFrame:
    """Fill blank stop times of trips whose pattern has a matched path.

    visits: (trip_id, pattern_key, stop_sequence, arrival_s, departure_s); distances: (pattern_key,
    distances array<double>, one for each stop). The pattern's match is made once and joined back.
    """
    place = distances.where("distances is not null").select("pattern_key", F.posexplode("distances").alias("k", "distance"))
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    return sequences.interpolate(visits.withColumn("k", F.row_number().over(w) - 1).join(place, ["pattern_key", "k"]))


def ferry_replacement(trips: DataFrame, calendar: DataFrame, departures: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new trips, unresolved): published departures under the unique service of their days.

    departures: (route, direction, weekdays array<int>(7), departure_s); calendar rows with those
    bits must be unique. Arrival is the departure plus the published upper bound.
    """
    bits = F.array(*[F.col(d).cast("int") for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    services = calendar.select(bits.alias("weekdays"), "service_id").groupBy("weekdays").agg(F.count_distinct("service_id").alias("n"), F.min("service_id").alias("s"))
    got = departures.join(services, "weekdays", "left").join(durations, ["route", "direction"], "left")
    ok = (F.col("n") == 1) & F.col("upper_s").isNotNull()
    new = got.where(ok).select(F.concat_ws(":", F.lit("OPERATOR:SF"), "route", "direction", "s", clock.clock(F.col("departure_s"))).alias("trip_id"), F.col("s").alias("service_id"), "route", "direction", "departure_s", (F.col("departure_s") + F.col("upper_s")).alias("arrival_s"))
    return new, got.where(~F.coalesce(ok, F.lit(False))).select("route", "direction", "departure_s", F.when(F.col("n").isNull(), "no_service").when(F.col("n") > 1, "several_services").otherwise("no_duration").alias("reason"))
