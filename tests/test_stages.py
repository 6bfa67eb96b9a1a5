"""Gates, merges, checks and the service functions."""
import pytest
from pyspark.sql import functions as F

from waymesh import service
from waymesh.operators import routing, stages


def rules(df):
    return sorted({(r["rule"], r["key"]) for r in df.collect()})


TIMES = "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int"


def test_requests(spark):
    rows = [(1, 22.3, 114.1, 22.4, 114.2, "2024-01-02T08:00:00", ["BUS"], "fastest", 6), (2, 0.0, 0.0, 22.4, 114.2, "2024-01-02T08:00:00", ["BUS"], "fastest", 6), (3, 22.3, 114.1, 22.4, 114.2, "2024-01-02T08:00:00", ["ROCKET"], "fastest", 6), (4, 22.3, 114.1, 22.4, 114.2, "soon", ["BUS"], "fastest", 6), (5, 22.3, 114.1, 22.4, 114.2, "2025-01-02T08:00:00", ["RAIL"], "walking", 6), (6, 22.3, 114.1, 22.4, 114.2, "2024-01-02T08:00:00", ["RAIL"], "walking", 11)]
    df = spark.createDataFrame(rows, "request int, from_lat double, from_lon double, to_lat double, to_lon double, departure string, modes array<string>, preference string, max_results int")
    got = {r["request"]: r["problem"] for r in stages.check_requests(df, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {1: None, 2: "origin", 3: "modes", 4: "departure", 5: "outside_service_window", 6: "max_results"}
    p = {r["request"]: (r["walk_reluctance"], r["most_transfers"]) for r in stages.search_profile(df).collect()}
    assert p[1] == (2, 3) and p[5] == (8, 0)


def test_stays_and_choice(spark):
    stops = spark.createDataFrame([("a", 1, 22.3, 114.1, 5), ("a", 2, 22.3, 114.1, 5), ("b", 1, 22.3, 114.1, 5), ("c", 1, 22.3, 114.1, 5), ("c", 3, 22.3, 114.1, 5), ("d", 1, 22.3, 114.1, 900), ("d", 2, 22.3, 114.1, 5)], "trip string, seq int, lat double, lon double, stay_min int")
    assert {r["trip"]: r["problem"] for r in stages.check_stays(stops).collect()} == {"a": None, "b": "stops", "c": "order", "d": "stay"}
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "item string")
    entries = spark.createDataFrame([("x", True, True, False, False), ("x", False, True, False, False), ("y", False, True, False, False)], "item string, candidate boolean, inactive boolean, private boolean, shuttle boolean")
    assert {r["item"]: (r["selected"], r["reason"]) for r in stages.choose_entries(items, entries).collect()} == {"x": (True, "candidate"), "y": (False, "only_inactive"), "z": (True, "not_listed")}


def test_candidates_and_crawl(spark):
    routes = spark.createDataFrame([("r", "KMB+CTB", "101"), ("s", "NLB", "3M")], "route_id string, agency string, number string")
    entries = spark.createDataFrame([("e1", "KMB 101", "101"), ("e2", "NLB 3m", "3m"), ("e3", "NLB 101", "101")], "entry string, title string, number string")
    prefixes = spark.createDataFrame([("kmb", "KMB"), ("ctb", "Citybus"), ("nlb", "NLB")], "operator string, prefix string")
    assert sorted(map(tuple, stages.entry_candidates(routes, entries, prefixes).collect())) == [("r", "e1"), ("s", "e2")]
    st = spark.createDataFrame([("a",), ("b",), ("c",)], "station string")
    pair = lambda *rows: spark.createDataFrame(list(rows), "origin string, destination string")
    got = stages.crawl_pairs(st, pair(("a", "b")), pair(("b", "a"))).collect()
    assert len(got) == 5 and {(r["origin"], r["destination"]) for r in got if r["priority"] == 0} == {("a", "b")}


GATES = "verified_loop boolean, n_candidates int, mutual boolean, has_metadata boolean, exact_terminal int, endpoints_match boolean, special boolean, n_groups int, unrepaired boolean, page_month string, official_month string, modified boolean, n_patterns int, n_preferred int, mixed boolean, covered boolean, dated boolean, has_origin_departure boolean, negative_offset boolean"
GOOD = dict(zip([c.split()[0] for c in GATES.split(", ")], [False, 1, True, True, 1, True, False, 2, False, "2024-05", "2024-04", False, 1, 1, False, False, True, True, False]))


@pytest.mark.parametrize("change, reason", [({}, None), ({"n_candidates": 2, "exact_terminal": 2}, "identity"), ({"endpoints_match": False, "special": True}, "endpoints"), ({"page_month": "2024-01"}, "older_than_official"), ({"page_month": "2024-01", "verified_loop": True}, None), ({"n_patterns": 2}, "several_patterns"), ({"dated": False, "mutual": False, "exact_terminal": 0}, "undated_page"), ({"negative_offset": None}, "negative_offset")])
def test_merge_gates(spark, change, reason):
    row = {**GOOD, **change}
    assert stages.merge_gates(spark.createDataFrame([tuple(row.values())], GATES)).first()["reason"] == reason


def test_rail_merge(spark):
    rec = spark.createDataFrame([(1, "k", "frequency", 100, 200, 60, False), (2, "k", "frequency", 500, 600, 60, False), (3, "k", "frequency", 550, 700, 90, False)], "id int, key string, kind string, start_s int, end_s int, headway_s int, mixed boolean")
    base = spark.createDataFrame([("k", 300), ("m", 400)], "key string, headway_s int")
    bands, bad = stages.rail_merge(rec, base, 0, 1000)
    assert sorted((r["key"], r["start_s"], r["end_s"], r["origin"]) for r in bands.collect()) == [("k", 0, 100, "baseline"), ("k", 100, 200, "published"), ("k", 200, 1000, "baseline"), ("m", 0, 1000, "baseline")]
    assert {r["id"] for r in bad.collect()} == {2, 3}


def test_checks(spark):
    base = spark.createDataFrame([("t", 1, "a", 0, 0), ("t", 2, "b", None, None), ("t", 3, "c", 60, 60), ("u", 1, "a", 0, 0), ("u", 2, "b", 9, 9)], TIMES)
    new = spark.createDataFrame([("t", 1, "a", 0, 0), ("t", 2, "b", 30, 30), ("t", 3, "c", 60, 60), ("u", 1, "a", 0, 0), ("u", 2, "x", 8, 8)], TIMES)
    ok = spark.createDataFrame([("t",)], "trip_id string")
    assert rules(stages.check_timing(base, new, ok)) == [("stop_changed", "u"), ("supplied_time_changed", "u"), ("unapproved_trip", "u")]
    assert rules(stages.check_timing(base, new.where("trip_id = 't'"), ok)) == [("visit_lost_or_added", "u")]
    edge = lambda a, b: F.concat_ws(">", a, b)
    ev = spark.createDataFrame([("a>b", 30, True), ("b>c", 31, True)], "edge string, value int, accepted boolean")
    assert rules(stages.check_edges(new.where("trip_id = 't'"), base, ev, edge)) == [("edge_differs", "t")]
    tot = spark.createDataFrame([("t", "a", "c", 60), ("u", "a", "b", 9)], "trip_id string, first string, last string, total_s int")
    assert rules(stages.check_pairs(new, tot)) == [("duration", "u"), ("endpoints", "u"), ("not_two_visits", "t")]
    runs = spark.createDataFrame([("r", 1, "original"), ("r", 1, "replacement"), ("s", 1, "replacement")], "route_id string, date int, origin string")
    rep = spark.createDataFrame([("r", 1), ("s", 1), ("q", 1)], "route_id string, date int")
    assert rules(stages.check_merge(runs, rep)) == [("no_replacement", "q"), ("original_still_runs", "r")]
    resp = spark.createDataFrame([(1, 1, "x", 5, 100, 0, 100), (1, 2, "x", 4, 90, 0, 80)], "request int, place int, signature string, rank_key int, end_s int, request_s int, elapsed int")
    assert rules(stages.check_response(resp)) == [("elapsed", "1"), ("not_sorted", "1"), ("signature_twice", "1")]
    files = lambda *r: spark.createDataFrame(list(r), "path string, sha256 string")
    assert {r["path"]: r["state"] for r in stages.release_drift(files(("a", "1"), ("b", "2")), files(("a", "9"), ("c", "3"))).collect()} == {"a": "changed", "b": "new", "c": "missing"}


def test_service(spark):
    stops = spark.createDataFrame([("A", 22.30, 114.10), ("B", 22.32, 114.10)], "stop_id string, lat double, lon double")
    times = spark.createDataFrame([("t", "A", 1, 30_000, 30_000), ("t", "B", 2, 30_600, 30_600)], "trip_id string, stop_id string, stop_sequence int, arrival_s int, departure_s int")
    net = service.Network(stops, routing.connections(times), None, "2024-01-01", "2024-02-01")
    ask = {"from": {"lat": 22.301, "lon": 114.1}, "to": {"lat": 22.32, "lon": 114.1}, "departure": "2024-01-02T00:00:00Z"}
    got = service.route(spark, net, ask)
    assert [(g["arrival_s"], g["transfers"], g["legs"][0]["trip"]) for g in got] == [(30_600, 0, "t")]
    with pytest.raises(service.Refused, match="origin"):
        service.route(spark, net, {**ask, "from": {"lat": True, "lon": 0}})
    places = spark.createDataFrame([("p1", "Star Ferry Pier", 1), ("p2", "Star House", 0), ("p3", "Ferry", 0)], "place_id string, name string, tier int")
    assert [p["place_id"] for p in service.search(places, "ferry")] == ["p3", "p1"] and service.search(places, "f") == []


def test_jobs():
    jobs = service.Jobs()
    matrix = lambda spec: {(a, b): 60 for a in ["base", *spec.jobs] for b in ["base", *spec.jobs] if a != b}
    job = jobs.start(service.example(3), matrix, key="k", wait=True)
    assert job.state == "done" and jobs.start(service.example(3), matrix, key="k").id == job.id
    assert [e["seq"] for e in jobs.after(job.id, 1)[1]] == [2]
    with pytest.raises(service.Refused):
        jobs.start({"jobs": []}, matrix)


def test_minute_search_and_crawl(spark):
    j = lambda *rows: spark.createDataFrame(list(rows), "request int, trips array<string>, t int")
    inexact = spark.createDataFrame([("f",)], "trip_id string")
    got = routing.with_minute_search(j((1, ["f"], 5), (2, ["x"], 6)), j((1, ["g"], 4), (1, ["f"], 5), (2, ["y"], 1)), inexact)
    assert sorted((r["request"], r["trips"][0]) for r in got.collect()) == [(1, "f"), (1, "g"), (2, "x")]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    start = spark.createDataFrame([("a",)], "node string")
    pages, whole = routing.crawl(start, links, 9)
    assert {r["node"]: r["level"] for r in pages.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3} and whole
    pages, whole = routing.crawl(start, links, 2)
    assert pages.count() == 3 and not whole


def test_reports(spark):
    from waymesh.functions.structs import between

    rec = spark.createDataFrame([("L", "listed", None), ("L", "frequency", "x"), ("M", "fallback", "y")], "line string, kind string, issue string")
    assert {r["line"]: r["text"] for r in stages.line_report(rec).collect()} == {"L": "| L | 1 | 1 | 0 | 0 | x |", "M": "| M | 0 | 0 | 1 | 0 | y |"}
    other = spark.createDataFrame([("M",), ("N",)], "line string")
    assert {r["line"]: r["state"] for r in stages.missing_lines(rec, other).collect()} == {"L": "no_page", "N": "not_in_inventory"}
    r = spark.range(1).select(between(F.array(*[F.lit(x) for x in "abcb"]), F.lit("a"), F.lit("c")).alias("x"), between(F.array(*[F.lit(x) for x in "abcb"]), F.lit("a"), F.lit("b")).alias("y")).first()
    assert r["x"] == ["a", "b", "c"] and r["y"] is None
