"""Interchanges, merged schedules and layers on small cases, against brute force."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from waymesh.operators import calendar, daysets, interchange, layers, schedule_merge

DAY = datetime.date(2024, 3, 4)
BANDS = "section_key string, date date, start_s int, end_s int, headway_secs int, exact_times int, parent string"


@pytest.mark.parametrize("seed", range(3))
def test_windows_of_many_sections(spark, seed):
    """Any number of sections: every second of a window lies in a band of the first and in some band of each other."""
    rng = random.Random(seed)
    bands = [(f"k{k}", DAY + datetime.timedelta(d), a, a + rng.randrange(1, 60), h, 0, f"p{j}") for k in range(6) for d in range(2) for j in range(rng.randrange(4)) for a, h in [(rng.randrange(100), rng.choice([0, 5, 9]))]]
    paths = {f"j{i}": [(f"k{rng.randrange(6)}", n * rng.randrange(1, 9)) for n in range(rng.choice([1, 2, 3, 9, 12]))] for i in range(25)}
    parts = spark.createDataFrame([(p, n, k, o) for p, x in paths.items() for n, (k, o) in enumerate(x)], "path_id string, n int, section_key string, offset_s int")
    found, refused = interchange.windows(parts, spark.createDataFrame(bands, BANDS), 20)
    known, want, none = {b[0] for b in bands}, set(), {}
    for p, x in paths.items():
        if any(k not in known for k, _ in x):
            none[p] = "no_timetable"
            continue
        got = set()
        for key, date, a, b, h, exact, _ in bands:
            if key != x[0][0]:
                continue
            open_ = [t for t in range(a, b) if all(any(bb[0] == k and bb[1] == date and bb[2] <= t + o < bb[3] for bb in bands) for k, o in x[1:])]
            for t in open_:
                if t - 1 not in open_:
                    e = t
                    while e + 1 in open_:
                        e += 1
                    got.add((p, date, t, e + 1, h, exact))
        if not got:
            none[p] = "no_common_window"
        want |= got
    rows = found.collect()
    assert {(r["path_id"], r["date"], r["start_s"], r["end_s"], r["headway_secs"], r["exact_times"]) for r in rows} == want and len(rows) == len(want)
    assert {r["path_id"]: r["reason"] for r in refused.collect()} == none


def test_bundles_and_connections(spark):
    days = [DAY + datetime.timedelta(i) for i in range(3)]
    rows = [("p", d, a, b, h, 0, "t1") for d in days[:2] for a, b, h in [(0, 100, 10), (50, 150, 20), (100, 200, 10), (300, 301, 0)]] + [("p", days[2], 0, 100, 30, 0, "t2"), ("q", days[2], 0, 100, 30, 0, "t2")]
    found = spark.createDataFrame(rows, "path_id string, date date, start_s int, end_s int, headway_secs int, exact_times int, parent string")
    bands, services = interchange.bundle(found)
    got = {(r["path_id"], r["start_s"], r["headway_secs"]): (r["lane"], r["service_key"]) for r in bands.collect()}
    assert got["p", 0, 10][0] == got["p", 100, 10][0] == 0 and got["p", 50, 20][0] == 1 and got["p", 300, 0][0] == -1
    assert got["p", 0, 30][1] == got["q", 0, 30][1] != got["p", 0, 10][1]
    assert {(r["service_key"], r["date"]) for r in services.collect()} == {(got["p", 0, 10][1], d) for d in days[:2]} | {(got["p", 0, 30][1], days[2])}
    journeys = spark.createDataFrame([("p", "A", "B", 600), ("q", "A", "C", 700)], "path_id string, origin string, destination string, total_s int")
    out = interchange.connections(bands, journeys, spark.createDataFrame([("t1", "r1"), ("t2", "r2")], "parent string, route_id string"))
    trips = {r["trip_id"]: r for r in out["trips"].collect()}
    assert len(trips) == 5 and {r["route_id"] for r in trips.values()} == {"r1:PATH:600", "r2:PATH:600", "r2:PATH:700"}
    times = {(r["trip_id"], r["stop_sequence"]): r["departure_s"] for r in out["stop_times"].collect()}
    single = next(x for x in trips if x.endswith(":-1"))
    assert times[single, 1] == 300 and times[single, 2] == 900 and len(times) == 10
    assert out["frequencies"].count() == 5


def test_journey_checks_and_sections(spark):
    node = "struct<station:string,line:string,t_min:double,link:string,marked:boolean>"
    good = [("a", "X", 0.0, "RIDE", None), ("b", "X", 2.0, "INTERCHANGE", None), ("b2", "Y", 4.5, "RIDE", None), ("c", "Y", 6.0, "END", None)]
    rows = [("ok", "a", "c", 6.0, None, good), ("walk", "a", "c", 6.0, None, [good[0], ("b", "X", 2.0, "WALK", None), ("b", "X", 3.0, "INTERCHANGE", None), good[3]]), ("flat", "a", "c", 6.0, None, [good[0], ("b", "X", 0.0, "INTERCHANGE", None), good[3]])]
    rows += [("marked", "a", "c", 6.0, True, good), ("status", "a", "c", 6.0, None, [*good[:3], (*good[3][:4], True)]), ("none", "a", "c", 6.0, None, None), ("one", "a", "c", 6.0, None, good[:1]), ("direct", "a", "c", 6.0, None, [good[0], good[3]]), ("total", "a", "c", 7.0, None, good), ("end", "a", "z", 6.0, None, good)]
    journeys = spark.createDataFrame(rows, f"path_id string, origin string, destination string, total_min double, marked boolean, nodes array<{node}>")
    told = {r["path_id"]: r["reason"] for r in interchange.checked(journeys).collect()}
    assert told == {"ok": None, "walk": "path_type", "flat": "invalid_times", "marked": "conditional", "status": "conditional", "none": "no_path", "one": "no_path", "direct": "no_change", "total": "invalid_times", "end": "invalid_times"}
    cut = interchange.sections(journeys.where("path_id = 'ok'")).collect()
    assert [(r["n"], r["section_key"], r["offset_s"]) for r in cut] == [(0, "X:a>b", 0), (1, "X:b>b2>c", 120)]


def test_daysets(spark):
    rng = random.Random(4)
    sets = {(k, s): {DAY + datetime.timedelta(rng.randrange(-200, 200)) for _ in range(rng.randrange(1, 90))} for k in range(4) for s in "ab"}
    frame = spark.createDataFrame([(k, s, d) for (k, s), x in sets.items() for d in x] + [(0, "a", next(iter(sets[0, "a"])))], "k int, s string, date date")
    a, b = (daysets.pages(frame.where(F.col("s") == s), ["k"]) for s in "ab")
    read = lambda d: {k: {r["date"] for r in d.collect() if r["k"] == k} for k in range(4)}
    assert read(daysets.dates(daysets.minus(a, b, ["k"]), ["k"])) == {k: sets[k, "a"] - sets[k, "b"] for k in range(4)}
    assert read(daysets.dates(daysets.both(a, b, ["k"]), ["k"])) == {k: sets[k, "a"] & sets[k, "b"] for k in range(4)}
    assert read(daysets.dates(daysets.union(a.unionByName(b), ["k"]), ["k"])) == {k: sets[k, "a"] | sets[k, "b"] for k in range(4)}
    assert {r["k"]: r["days"] for r in daysets.signed(a, ["k"]).collect()} == {k: len(sets[k, "a"]) for k in range(4)}


def test_merge_leaves_other_days_alone(spark):
    """Old trips lose replaced days and no other; a service is cloned only for trips that lose days."""
    end = DAY + datetime.timedelta(13)
    trips = spark.createDataFrame([("t1", "r", "1", "W"), ("t2", "r", "1", "W"), ("t3", "r", "2", "W"), ("t4", "s", "1", "SUN")], "trip_id string, route_id string, direction string, service_id string")
    times = spark.createDataFrame([(t, q, f"x{q}", 1000 * q, 1000 * q + 20 * (q - 1)) for t in ("t1", "t2", "t3", "t4") for q in (1, 2)], "trip_id string, stop_sequence int, stop_id string, arrival_s int, departure_s int")
    week = ", ".join(f"{d} int" for d in calendar.WEEK)
    cal = spark.createDataFrame([("W", *[1] * 5, 0, 0, DAY, datetime.date(2025, 1, 1)), ("SUN", *[0] * 6, 1, DAY, end)], f"service_id string, {week}, start_date date, end_date date")
    ex = spark.createDataFrame([("W", DAY + datetime.timedelta(1), 2), ("W", DAY + datetime.timedelta(5), 1), ("W", DAY + datetime.timedelta(60), 2)], "service_id string, date date, exception_type int")
    freq = spark.createDataFrame([], "trip_id string, start_s int, end_s int, headway_secs int, exact_times int")
    groups = spark.createDataFrame(
        [("g", 0, "r", "1", [0, 1], "interval", True, [300, 100, 100], None, None), ("h", 0, "s", "1", [0], "interval", True, [100], None, None), ("late", 1, "r", "1", [1, 2], "interval", True, None, [(50, 500, 60)], None)],
        "group_id string, page int, route_id string, direction string, categories array<int>, layout string, valid boolean, departures array<int>, periods array<struct<start_s:int,end_s:int,headway_secs:int>>, reason string",
    )
    feed = {"trips": trips, "stop_times": times, "calendar": cal, "calendar_dates": ex, "frequencies": freq}
    out = schedule_merge.merge(feed, groups, spark.createDataFrame([(DAY + datetime.timedelta(7),)], "date date"), F.lit(DAY), F.lit(end))
    runs = lambda tables, last: {(r["trip_id"], r["date"]) for r in tables["trips"].join(calendar.service_dates(tables["calendar"], tables["calendar_dates"], F.lit(DAY), F.lit(last)), "service_id").collect()}
    before, after = runs(feed, end), runs(out, end)
    mondays, tuesdays = {DAY}, {DAY + datetime.timedelta(1), DAY + datetime.timedelta(8)}  # the second Monday is a holiday
    wednesdays = {DAY + datetime.timedelta(2), DAY + datetime.timedelta(9)}
    gone = {(t, d) for t in ("t1", "t2") for d in mondays | tuesdays | wednesdays}
    assert {x for x in after if not x[0].startswith("PUBLISHED")} == before - gone
    assert {x for x in after if x[0].startswith("PUBLISHED:r:1:g")} == {(f"PUBLISHED:r:1:g:{j}", d) for j in (0, 1) for d in mondays | tuesdays}
    assert {x for x in after if x[0].startswith("PUBLISHED:r:1:late")} == {("PUBLISHED:r:1:late:0", d) for d in wednesdays}
    far = datetime.date(2024, 6, 1)
    assert {x for x in runs(out, far) if x[0] == "t1" and x[1] > end} == {x for x in runs(feed, far) if x[0] == "t1" and x[1] > end}
    services = {r["trip_id"]: r["service_id"] for r in out["trips"].collect()}
    assert services["t1"] == services["t2"] != "W" and services["t3"] == "W" and services["t4"] == "SUN"
    assert {(r["group_id"], r["category"], r["reason"]) for r in out["refused"].collect()} == {("late", 1, "date_already_covered")}
    new = {(r["trip_id"], r["stop_sequence"]): (r["arrival_s"], r["departure_s"]) for r in out["stop_times"].collect() if r["trip_id"].startswith("PUBLISHED:r:1:g")}
    assert new == {("PUBLISHED:r:1:g:0", 1): (100, 100), ("PUBLISHED:r:1:g:0", 2): (1100, 1120), ("PUBLISHED:r:1:g:1", 1): (300, 300), ("PUBLISHED:r:1:g:1", 2): (1300, 1320)}
    assert [tuple(r) for r in out["frequencies"].collect()] == [("PUBLISHED:r:1:late:0", 50, 500, 60, 0)]


def test_top_layer(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3), rng.randrange(3), a, a + rng.randrange(-2, 25)) for a in (rng.randrange(80) for _ in range(60))]
    got = layers.top_layer(spark.createDataFrame(rows, "k int, layer int, a int, b int"), ["k"]).collect()
    seconds = {}
    for k, layer, a, b in rows:
        for t in range(a, b):
            seconds[k, t] = min(layer, seconds.get((k, t), 9))
    found = [((r["k"], t), r["layer"]) for r in got for t in range(r["a"], r["b"])]
    assert dict(found) == seconds and len(found) == len(seconds)


def test_rail_schedule(spark):
    records = [("e1", "p", [0], "departure", 100, None, None, False), ("e2", "p", [0], "departure", 300, None, None, False), ("f", "p", [0, 1], "frequency", 1000, 2000, 60, False), ("x", "p", [1], "frequency", 1500, 2500, 90, False), ("m", "q", [0], "frequency", 0, 50, 60, True)]
    base = [("p", 0, 3000, 600, True), ("q", 20, 100, 500, False), ("r", 0, 100, 500, True)]
    days = spark.createDataFrame([(DAY + datetime.timedelta(i), i % 2) for i in range(4)], "date date, category int")
    bands, services, refused = layers.rail_schedule(
        spark.createDataFrame(records, "id string, path string, categories array<int>, kind string, start_s int, end_s int, headway_s int, mixed boolean"), spark.createDataFrame(base, "path string, start_s int, end_s int, headway_s int, gaps boolean"), days
    )
    on = {r["service_key"]: set() for r in services.collect()}
    for r in services.collect():
        on[r["service_key"]].add((r["date"] - DAY).days)
    got = {(r["path"], r["origin"][0], r["start_s"], r["end_s"], r["headway_s"]): on[r["service_key"]] for r in bands.collect()}
    even, odd = {0, 2}, {1, 3}
    assert got == {
        ("p", "l", 100, 101, 0): even, ("p", "l", 300, 301, 0): even, ("p", "p", 1000, 2000, 60): even, ("p", "r", 0, 100, 600): even, ("p", "r", 301, 1000, 600): even, ("p", "r", 2000, 3000, 600): even,
        ("p", "r", 0, 3000, 600): odd, ("q", "r", 20, 50, 500): even,
    }
    assert {(r["id"], r["category"], r["reason"]) for r in refused.collect()} == {("f", 1, "overlapping_bands"), ("x", 1, "overlapping_bands"), ("m", 0, "mixed_service")}
