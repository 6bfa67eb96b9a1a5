"""Selection, merging and verification stages of a timetable build.

Gates run in a fixed order and the first that fails is the reason; each rewrite has a check
that shares no code with it and returns violations.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo, text
from waymesh.functions.clock import local_instant
from waymesh.operators.intervals import complement, quarantine, union_windows

MODES = ("RAIL", "BUS", "TRAM", "LIGHT_RAIL", "FERRY", "FUNICULAR")


def crawl_pairs(stations: DataFrame, adjacent: DataFrame, done: DataFrame) -> DataFrame:
    """(origin, destination, priority): ordered pairs still to fetch, adjacent ones first.

    The cross join is over the stations of one network, about a hundred.
    """
    a, b = stations.select(F.col("station").alias("origin")), stations.select(F.col("station").alias("destination"))
    near = adjacent.select("origin", "destination", F.lit(0).alias("__near")).distinct()
    pairs = a.crossJoin(b).where("origin <> destination").join(done.select("origin", "destination"), ["origin", "destination"], "left_anti")
    ranked = pairs.join(near, ["origin", "destination"], "left").withColumn("priority", F.coalesce("__near", F.lit(1)))
    return ranked.select("origin", "destination", "priority")


def check_requests(requests: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds `at` (instant) and `problem` to journey requests; the first problem counts, null is a good request.

    requests: (request, from_lat, from_lon, to_lat, to_lon, departure text, modes array, preference, max_results).
    """
    at = local_instant(F.col("departure"))
    problem = (
        F.when(~geo.inside(F.col("from_lat"), F.col("from_lon")), "origin")
        .when(~geo.inside(F.col("to_lat"), F.col("to_lon")), "destination")
        .when((F.size("modes") < 1) | (F.size(F.array_except("modes", F.array(*[F.lit(m) for m in MODES]))) > 0) | F.col("modes").isNull(), "modes")
        .when(~F.coalesce(F.col("preference").isin("fastest", "transfers", "walking"), F.lit(False)), "preference")
        .when(~F.coalesce(F.col("max_results").between(1, 10), F.lit(False)), "max_results")
        .when(at.isNull(), "departure")
        .when((at < start) | (at >= end), "outside_service_window")
    )
    return requests.withColumns({"at": at, "problem": problem})


def search_profile(requests: DataFrame) -> DataFrame:
    """Adds walk_reluctance, transfer_penalty and most_transfers of each search."""
    p = F.col("preference")
    rail_only = F.col("modes") == F.array(F.lit("RAIL"))
    return requests.withColumns({"walk_reluctance": F.when(p == "walking", 8).when(p == "transfers", 1).otherwise(2), "transfer_penalty": F.when(p == "transfers", 1800).otherwise(0), "most_transfers": F.when(rail_only, 0).otherwise(3)})


def check_stays(stops: DataFrame) -> DataFrame:
    """(trip, n, problem) of multi-stop requests (trip, seq, lat, lon, stay_min): 2..12 stops in the envelope, stays of 0..720 minutes."""
    ok = geo.inside(F.col("lat"), F.col("lon"))
    stay = F.coalesce(F.col("stay_min").between(0, 720), F.lit(False))
    g = stops.groupBy("trip").agg(F.count("*").alias("n"), F.bool_and(ok).alias("ok"), F.bool_and(stay).alias("stay"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.count_distinct("seq").alias("k"))
    return g.select("trip", "n", F.when(~F.col("n").between(2, 12), "stops").when((F.col("a") != 1) | (F.col("b") != F.col("n")) | (F.col("k") != F.col("n")), "order").when(~F.col("ok"), "coordinates").when(~F.col("stay"), "stay").alias("problem"))


def choose_entries(items: DataFrame, entries: DataFrame) -> DataFrame:
    """(item, selected, reason): an item is kept for a candidate entry, or dropped for the kind of all its entries.

    entries: (item, candidate, inactive, private, shuttle).
    """
    g = entries.groupBy("item").agg(F.bool_or("candidate").alias("candidate"), F.bool_and("inactive").alias("inactive"), F.bool_and("private").alias("private"), F.bool_and("shuttle").alias("shuttle"), F.count("*").alias("n"))
    got = items.join(g, "item", "left")
    selected = F.coalesce(F.col("candidate"), F.lit(False)) | F.col("n").isNull()
    reason = F.when(F.col("n").isNull(), "not_listed").when(F.col("candidate"), "candidate").when(F.col("inactive"), "only_inactive").when(F.col("private"), "only_private").when(F.col("shuttle"), "only_venue_shuttle")
    return got.select("item", F.when(reason.isNull(), True).otherwise(selected).alias("selected"), F.coalesce(reason, F.lit("mixed")).alias("reason"))


def entry_candidates(routes: DataFrame, entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(route_id, entry): directory entries of the same number whose page prefix belongs to one of the route's operators.

    routes: (route_id, agency, number), agency may join operators with '+'; entries: (entry,
    title, number); prefixes: (operator, prefix), a short list. A joint route needs an entry of
    any of its operators.
    """
    one = routes.select("route_id", "number", F.explode(F.split("agency", r"\+")).alias("operator")).withColumn("operator", text.operator(F.col("operator")))
    # what a route wants and what an entry has are sets of (number, prefix). They meet by equality, and of several
    # that both hold the least counts: a pair is made once, so that pairs, as many as routes times entries of a
    # number, are not shuffled to be told apart
    pair = F.struct(F.upper("number").alias("k"), F.col("prefix").alias("p"))
    wants = one.where("number IS NOT NULL").join(F.broadcast(prefixes), "operator").groupBy("route_id").agg(F.collect_set(pair).alias("__r"))
    has = entries.where("number IS NOT NULL").join(F.broadcast(prefixes.select("prefix").distinct()), F.startswith("title", F.col("prefix"))).groupBy("entry").agg(F.collect_set(pair).alias("__t"))
    # numbers are few: each is dealt to sixteen parts, a route to a row of them and an entry to a column
    parts, four = F.sequence(F.lit(0), F.lit(3)), lambda c: F.pmod(F.hash(c), F.lit(4))
    x = wants.withColumn("__a", four("route_id")).withColumn("__m", F.explode("__r")).withColumn("__b", F.explode(parts))
    y = has.withColumn("__b", four("entry")).withColumn("__m", F.explode("__t")).withColumn("__a", F.explode(parts))
    least = (F.size("__r") == 1) | (F.size("__t") == 1) | (F.array_min(F.array_intersect("__r", "__t")) == F.col("__m"))
    return x.join(y, ["__m", "__a", "__b"]).where(least).select("route_id", "entry")


def merge_gates(candidates: DataFrame) -> DataFrame:
    """Adds `reason` to schedule candidates: the first gate that fails, null where the schedule may replace.

    Columns: verified_loop, n_candidates, mutual, has_metadata, exact_terminal, endpoints_match,
    special, n_groups, unrepaired, page_month, official_month, modified, n_patterns, n_preferred,
    mixed, covered, dated, has_origin_departure, negative_offset.
    """
    c = F.col
    loop = F.coalesce(c("verified_loop"), F.lit(False))
    identity = loop | ((c("n_candidates") == 1) & (c("mutual") | c("has_metadata"))) | ((c("n_candidates") > 1) & (c("exact_terminal") == 1))
    gates = [
        (~identity, "identity"), (~c("endpoints_match"), "endpoints"), (~c("has_metadata"), "no_metadata"), (c("special"), "special_service"), (c("n_groups") == 0, "no_groups"), (c("unrepaired"), "unrepaired_table"),
        (~loop & (c("page_month") < c("official_month")), "older_than_official"), (c("modified"), "route_modified"), (c("n_patterns") != 1, "several_patterns"), (c("n_preferred") != 1, "no_single_preferred_group"),
        (c("mixed"), "mixed_periods_and_departures"), (c("covered"), "date_already_covered"), (~c("dated") & ~(c("exact_terminal") == 1) & ~c("mutual"), "undated_page"), (~c("has_origin_departure"), "no_origin_departure"), (c("negative_offset"), "negative_offset"),
    ]
    reason = F.lit(None).cast("string")
    for test, name in reversed(gates):
        reason = F.when(F.coalesce(test, F.lit(True)), name).otherwise(reason)
    return candidates.withColumn("reason", reason)


def clone_departures(departures: DataFrame, template: DataFrame) -> DataFrame:
    """Stop times of new trips: each departure plus its template's offsets.

    departures: (trip_id, template_id, departure_s); template: (template_id, stop_sequence, stop_id, offset_arr, offset_dep).
    """
    return departures.join(template, "template_id").select("trip_id", "stop_sequence", "stop_id", (F.col("departure_s") + F.col("offset_arr")).alias("arrival_s"), (F.col("departure_s") + F.col("offset_dep")).alias("departure_s"))


def rail_merge(records: DataFrame, baseline: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """(bands, rejects): safe published records, gaps filled with the baseline headway, no band twice.

    records: (id, key, kind, start_s, end_s, headway_s, mixed); baseline: (key, headway_s).
    """
    judged = quarantine(records, ["key"], "id")
    safe = judged.where("reason is null and kind = 'frequency'").select("key", "start_s", "end_s", "headway_s", F.lit("published").alias("origin"))
    covered = safe.select("key", F.col("start_s").cast("bigint").alias("a"), F.col("end_s").cast("bigint").alias("b"))
    # a key without any safe band is one whole gap: an empty window marks it
    keys = baseline.select("key").join(covered.select("key").distinct(), "key", "left_anti").select("key", F.lit(low).cast("bigint").alias("a"), F.lit(high).cast("bigint").alias("b"))
    gaps = complement(covered, ["key"], F.lit(low).cast("bigint"), F.lit(high).cast("bigint")).union(keys)
    filled = gaps.join(baseline, "key").select("key", F.col("a").cast("int").alias("start_s"), F.col("b").cast("int").alias("end_s"), "headway_s", F.lit("baseline").alias("origin"))
    return safe.union(filled).dropDuplicates(["key", "start_s", "end_s", "headway_s"]), judged.where("reason is not null")


def history_report(pairs: DataFrame, hours: DataFrame) -> DataFrame:
    """(day, hour, pairs, covered, share): for each hour of the week how many wanted pairs have a value.

    pairs: (origin, destination); hours: (day, hour, origin, destination, seconds), partitioned by day and hour.
    """
    wanted = pairs.select("origin", "destination").distinct()
    total = wanted.agg(F.count("*").alias("pairs"))
    got = hours.where("seconds is not null").join(wanted, ["origin", "destination"], "left_semi").groupBy("day", "hour").agg(F.count_distinct("origin", "destination").alias("covered"))
    return got.crossJoin(F.broadcast(total)).withColumn("share", F.col("covered") / F.col("pairs"))


def route_total(segments: DataFrame, values: DataFrame) -> DataFrame:
    """(route, total): the sum of a route's segments only where every one has a value."""
    got = segments.join(values, ["origin", "destination"], "left")
    return got.groupBy("route").agg(F.when(F.count("seconds") == F.count("*"), F.sum("seconds")).alias("total"))


# checks: each returns violations (rule, key)


def _rows(rule: str, frame: DataFrame, key: str) -> DataFrame:
    return frame.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_timing(base: DataFrame, new: DataFrame, approved: DataFrame) -> DataFrame:
    """Re-timing keeps visits, supplied times and unapproved trips, and times do not run back.

    base, new: (trip_id, stop_sequence, stop_id, arrival_s, departure_s); approved: (trip_id).
    """
    k = ["trip_id", "stop_sequence"]
    b = base.select(*k, F.col("stop_id").alias("s0"), F.col("arrival_s").alias("a0"), F.col("departure_s").alias("d0"), F.lit(True).alias("in0"))
    both = b.join(new.withColumn("in1", F.lit(True)), k, "full_outer")
    changed = both.where("in0 and in1 and ((a0 is not null and not (a0 <=> arrival_s)) or (d0 is not null and not (d0 <=> departure_s)))")
    touched = both.where("in0 and in1 and not (a0 <=> arrival_s and d0 <=> departure_s)").select("trip_id").distinct()
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    back = new.withColumn("before", F.max("departure_s").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("arrival_s < before or departure_s < arrival_s")
    return _all([
        _rows("visit_lost_or_added", both.where("in0 is null or in1 is null"), "trip_id"), _rows("stop_changed", both.where("in0 and in1 and not (s0 <=> stop_id)"), "trip_id"), _rows("supplied_time_changed", changed, "trip_id"),
        _rows("unapproved_trip", touched.join(approved.select("trip_id"), "trip_id", "left_anti"), "trip_id"), _rows("time_runs_back", back, "trip_id"),
    ])


def check_schedule(trips: DataFrame, new_trips: DataFrame, templates: DataFrame, times: DataFrame, active_old: DataFrame, replaced: DataFrame) -> DataFrame:
    """Timetable replacement keeps every original trip, copies template offsets, and stops old service on replaced dates.

    templates: (trip_id, template_id); times: (trip_id, stop_sequence, departure_s); active_old,
    replaced: (trip_id, date).
    """
    lost = trips.select("trip_id").join(new_trips.select("trip_id"), "trip_id", "left_anti")
    rel = times.withColumn("rel", F.col("departure_s") - F.first("departure_s").over(Window.partitionBy("trip_id").orderBy("stop_sequence")))
    own = templates.join(rel, "trip_id").select("trip_id", "template_id", "stop_sequence", F.col("rel").alias("r1"))
    other = rel.select(F.col("trip_id").alias("template_id"), "stop_sequence", F.col("rel").alias("r2"))
    offset = own.join(other, ["template_id", "stop_sequence"], "left").where("not (r1 <=> r2)")
    return _all([_rows("trip_lost", lost, "trip_id"), _rows("offset_differs", offset, "trip_id"), _rows("old_service_active", active_old.join(replaced, ["trip_id", "date"], "left_semi"), "trip_id")])


def check_surface(base: DataFrame, new: DataFrame, rail_trips: DataFrame, shapes: DataFrame, trips: DataFrame) -> DataFrame:
    """Surface stage: rail rows are identical, supplied fields too, estimates are flagged, distances rise, shapes exist."""
    k = ["trip_id", "stop_sequence"]
    b = base.select(*k, F.col("arrival_s").alias("a0"), F.col("departure_s").alias("d0"))
    both = new.join(b, k, "left")
    rail = both.join(rail_trips, "trip_id", "left_semi").where("not (a0 <=> arrival_s and d0 <=> departure_s)")
    supplied = both.where("(a0 is not null and not (a0 <=> arrival_s)) or (d0 is not null and not (d0 <=> departure_s))")
    flagged = both.where("a0 is null and arrival_s is not null and timepoint <> 0")
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    falls = new.where("shape_dist is not null").withColumn("before", F.lag("shape_dist").over(w)).where("shape_dist < before")
    missing = trips.where("shape_id is not null").join(shapes.select("shape_id").distinct(), "shape_id", "left_anti")
    return _all([_rows("rail_changed", rail, "trip_id"), _rows("supplied_changed", supplied, "trip_id"), _rows("estimate_not_flagged", flagged, "trip_id"), _rows("distance_falls", falls, "trip_id"), _rows("shape_missing", missing, "trip_id")])


def check_merge(active: DataFrame, replaced: DataFrame, origin: str = "origin") -> DataFrame:
    """Bus merge: on replaced (route, date) only replacement trips run, and some do.

    active: (route_id, date, origin) with origin 'original' or 'replacement'.
    """
    g = replaced.join(active, ["route_id", "date"], "left").groupBy("route_id", "date").agg(F.count_if(F.col(origin) == "original").alias("old"), F.count_if(F.col(origin) == "replacement").alias("new"))
    return _all([_rows("original_still_runs", g.where("old > 0"), "route_id"), _rows("no_replacement", g.where("new = 0"), "route_id")])


def check_rail(times: DataFrame, baseline: DataFrame, departures: DataFrame, attribution: DataFrame) -> DataFrame:
    """Rail merge: every directed edge with its duration is in the baseline, no departure twice on a date, all attributed."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    e = lambda d: d.withColumns({"a": F.lag("stop_id").over(w), "sec": F.col("arrival_s") - F.lag("departure_s").over(w)}).where("a is not null").select("trip_id", "a", F.col("stop_id").alias("b"), "sec")
    unknown = e(times).join(e(baseline).select("a", "b", "sec").distinct(), ["a", "b", "sec"], "left_anti")
    twice = departures.groupBy("path_key", "date", "departure_s").agg(F.count("*").alias("n")).where("n > 1")
    bare = times.select("trip_id").distinct().join(attribution.select("trip_id"), "trip_id", "left_anti")
    return _all([_rows("edge_not_in_baseline", unknown, "trip_id"), _rows("departure_twice", twice, "path_key"), _rows("not_attributed", bare, "trip_id")])


def check_pairs(connections: DataFrame, totals: DataFrame) -> DataFrame:
    """All-pairs rows: two visits a connection, their difference the journey's own total, ends as the path's.

    connections: (trip_id, stop_sequence, stop_id, arrival_s, departure_s); totals: (trip_id, first, last, total_s).
    """
    g = connections.groupBy("trip_id").agg(F.count("*").alias("n"), F.min_by("stop_id", "stop_sequence").alias("a"), F.max_by("stop_id", "stop_sequence").alias("b"), (F.max_by("arrival_s", "stop_sequence") - F.min_by("departure_s", "stop_sequence")).alias("s"))
    both = g.join(totals, "trip_id", "left")
    return _all([_rows("not_two_visits", g.where("n <> 2"), "trip_id"), _rows("no_total", both.where("total_s is null"), "trip_id"), _rows("duration", both.where("s <> total_s"), "trip_id"), _rows("endpoints", both.where("a <> first or b <> last"), "trip_id")])


def check_edges(times: DataFrame, before: DataFrame, evidence: DataFrame, edge) -> DataFrame:
    """Segment stage: origin departures unchanged, every evidenced edge takes its evidence's seconds."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    first = lambda d: d.groupBy("trip_id").agg(F.min_by("departure_s", "stop_sequence").alias("d"))
    moved = first(times).join(first(before).withColumnRenamed("d", "d0"), "trip_id").where("d <> d0")
    e = times.withColumns({"a": F.lag("stop_id").over(w), "sec": F.col("arrival_s") - F.lag("departure_s").over(w)}).where("a is not null").withColumn("edge", edge(F.col("a"), F.col("stop_id")))
    wrong = e.join(evidence.where("accepted").select("edge", "value"), "edge").where("sec <> value")
    return _all([_rows("origin_moved", moved, "trip_id"), _rows("edge_differs", wrong, "trip_id")])


def check_ferry(old: DataFrame, new: DataFrame, proofs: DataFrame, removed: DataFrame) -> DataFrame:
    """Ferry stage: unrelated trips identical, each new trip has exactly the two rows of its proof."""
    kept = old.join(removed.select("trip_id"), "trip_id", "left_anti")
    rest = new.join(proofs.select("trip_id"), "trip_id", "left_semi")
    lost = kept.exceptAll(new.select(*kept.columns))
    g = rest.groupBy("trip_id").agg(F.count("*").alias("n"), F.min("departure_s").alias("d"), F.max("arrival_s").alias("a"))
    bad = proofs.select("trip_id", F.col("departure_s").alias("pd"), F.col("arrival_s").alias("pa")).join(g, "trip_id", "left").where("n is null or n <> 2 or d <> pd or a <> pa")
    return _all([_rows("unrelated_changed", lost, "trip_id"), _rows("proof_differs", bad, "trip_id")])


def check_suffixes(trips: DataFrame, transfers: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Route ids that end in ':PATH:<seconds>' agree with the trip's duration; forbidden transfers are absent."""
    stated = F.regexp_extract("route_id", r":PATH:(\d+)$", 1).try_cast("int")
    wrong = trips.where(stated.isNotNull() & (stated != F.col("duration_s")))
    there = transfers.join(forbidden, ["from_stop_id", "to_stop_id"], "left_semi")
    return _all([_rows("suffix_differs", wrong, "trip_id"), _rows("forbidden_transfer", there, "from_stop_id")])


def check_response(itineraries: DataFrame) -> DataFrame:
    """Answers are sorted, distinct and timed from the request: (request, place, signature, rank_key, start_s.., end_s, request_s, elapsed)."""
    w = Window.partitionBy("request").orderBy("place")
    order = itineraries.withColumn("before", F.lag("rank_key").over(w)).where(F.col("rank_key") < F.col("before"))
    twice = itineraries.groupBy("request", "signature").agg(F.count("*").alias("n")).where("n > 1")
    return _all([_rows("not_sorted", order, "request"), _rows("signature_twice", twice, "request"), _rows("elapsed", itineraries.where("elapsed <> end_s - request_s"), "request")])


def release_drift(installed: DataFrame, release: DataFrame) -> DataFrame:
    """(path, state): missing, changed or new files between a release and an installation."""
    a, b = release.select("path", F.col("sha256").alias("want")), installed.select("path", F.col("sha256").alias("have"))
    return a.join(b, "path", "full_outer").select("path", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "new").when(F.col("have") != F.col("want"), "changed").alias("state")).where("state is not null")


def service_span(rows: DataFrame, key: list[str]) -> DataFrame:
    """Record bounds: a frequency's window, a list of departures from its first to one past its last, united."""
    bounds = rows.select(*key, F.when(F.col("kind") == "frequency", F.col("start_s")).otherwise(F.array_min("times")).alias("a"), F.when(F.col("kind") == "frequency", F.col("end_s")).otherwise(F.array_max("times") + 1).alias("b"))
    return union_windows(bounds, key)


def line_report(records: DataFrame) -> DataFrame:
    """(line, text): a markdown row a line with its listed, frequency, fallback and conditional records."""
    g = records.groupBy("line").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("listed", "frequency", "fallback", "conditional")], F.array_join(F.array_sort(F.collect_set("issue")), ", ").alias("issues"))
    return g.select("line", F.format_string("| %s | %d | %d | %d | %d | %s |", "line", "listed", "frequency", "fallback", "conditional", "issues").alias("text"))


def missing_lines(inventory: DataFrame, found: DataFrame) -> DataFrame:
    """(line, state): lines of the inventory without a page, and pages of lines that it does not have."""
    gone = inventory.select("line").join(found.select("line"), "line", "left_anti").distinct().withColumn("state", F.lit("no_page"))
    new = found.select("line").join(inventory.select("line"), "line", "left_anti").distinct().withColumn("state", F.lit("not_in_inventory"))
    return gone.unionByName(new)
