"""Range searches, quantile sketches and identity on small cases, against brute force."""
import collections
import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from waymesh.operators import identity, range_search, sketches


def journeys_of(rides, foot, origin, goal, asked, window, horizon, most):
    """All journeys by exhaustive search; then those that none beats."""
    found = set()
    walks = lambda stop: [(stop, 0), *[(g, s) for f, g, s in foot if f == stop]]

    def go(stop, at, dep, n, walk):
        for x, s in walks(stop):
            if n and x == goal and (s == 0 or n):
                found.add((dep, at + s, n, walk + s))
            if n < most:
                for f, g, d, a in rides:
                    if f == x and d >= at + s and a <= asked + horizon and (n or d < asked + window):
                        go(g, a, dep if n else d - walk - s, n + 1, walk + s)

    go(origin, asked, None, 0, 0)
    beats = lambda y, x: y != x and y[0] >= x[0] and y[1] <= x[1] and y[2] <= x[2] and y[3] <= x[3]
    return {x for x in found if not any(beats(y, x) for y in found)}


@pytest.mark.parametrize("seed", range(3))
def test_range_search_is_exact(spark, seed):
    rng = random.Random(seed)
    rides = sorted({(f, g, d, d + rng.randrange(1, 30)) for f, g, d in ((rng.randrange(6), rng.randrange(6), rng.randrange(100)) for _ in range(45)) if f != g})
    foot = [(i, (i + 2) % 6, rng.randrange(3, 9)) for i in range(0, 6, 2)]
    asks = [(i, rng.randrange(6), rng.randrange(6), rng.randrange(60)) for i in range(12)]
    asks = [x for x in asks if x[1] != x[2]]
    frame = spark.createDataFrame([(f"t{i}", *x) for i, x in enumerate(rides)], "trip_id string, from_stop int, to_stop int, dep_s int, arr_s int")
    walk = spark.createDataFrame(foot, "from_stop int, to_stop int, seconds int")
    requests = spark.createDataFrame(asks, "request int, stop int, destination int, t int")
    got = range_search.search(requests, frame, walk, 25, 70, 3).collect()
    for request, o, g, at in asks:
        own = {(r["dep_s"], r["arr_s"], r["rides"], r["walk_s"]) for r in got if r["request"] == request}
        assert own == journeys_of(rides, foot, o, g, at, 25, 70, 3)
    by_id = {f"t{i}": x for i, x in enumerate(rides)}
    for r in got:
        assert len(r["legs"]) == r["rides"] and all((x["from_stop"], x["to_stop"], x["dep_s"], x["arr_s"]) == tuple(map(str, by_id[x["trip_id"]][:2])) + by_id[x["trip_id"]][2:] for x in r["legs"])
        assert all(a["arr_s"] <= b["dep_s"] for a, b in zip(r["legs"], r["legs"][1:]))


def test_wider_windows_serve_open_requests_only(spark):
    rides = spark.createDataFrame([("early", 1, 2, 50, 90), ("late", 1, 2, 500, 540), ("other", 3, 4, 700, 800)], "trip_id string, from_stop int, to_stop int, dep_s int, arr_s int")
    requests = spark.createDataFrame([(1, 1, 2, 0), (2, 1, 2, 60), (3, 3, 4, 0), (4, 5, 6, 0)], "request int, stop int, destination int, t int")
    found = range_search.plan(requests, rides, None, (100, 600, 1000), 1000, 2)
    got = {(r["request"], r["window"], r["legs"][0]["trip_id"]) for r in found.collect()}
    assert got == {(1, 100, "early"), (2, 600, "late"), (3, 1000, "other")}
    told = {r["request"]: r for r in range_search.ranked(range_search.normalised(found, requests)).collect()}
    assert (told[2]["first_wait_s"], told[2]["ride_s"], told[2]["waits_s"], told[2]["elapsed_s"], told[2]["transfers"], told[2]["place"]) == (440, 40, 0, 480, 0, 1)


def test_rankings(spark):
    legs = [("t", "a", "b", 0, 1)]
    rows = [(1, 0, 100, 2, 50, legs), (1, 5, 120, 1, 60, legs), (1, 0, 130, 3, 0, legs), (1, 9, 100, 2, 50, legs)]
    frame = spark.createDataFrame(rows, "request int, dep_s int, arr_s int, rides int, walk_s int, legs " + range_search._LEG)
    first = lambda how, top=1: [(r["arr_s"], r["dep_s"]) for r in range_search.ranked(frame, how, top).orderBy("place").collect()]
    assert first("fastest") == [(100, 9)] and first("transfers") == [(120, 5)] and first("walking") == [(130, 0)] and len(first("fastest", 3)) == 3
    assert first(F.lit("transfers")) == [(120, 5)]


def test_quantiles_merge(spark):
    """Exact below the sketch's size; beyond it ranks are wrong by 2.3 / k^0.9 at most."""
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, start + datetime.timedelta(minutes=rng.randrange(20_000)), rng.random() ** 2) for i in range(30_000)] + [(3, start, None), (4, start, 1.0), (4, start, None), (5, start, 7.0)]
    frame = spark.createDataFrame(rows, "k int, at timestamp, s double").repartition(7)
    values = collections.defaultdict(list)
    for k, _, s in rows:
        values[k].append(s)
    for size in (200, 20_000):
        hourly = sketches.hourly(frame, ["k"], "at", "s", size)
        for share in (0.1, 0.5, 0.9):
            got = {r["k"]: r["seconds"] for r in sketches.matrix(hourly, ["k"], share).collect()}
            assert got[3] is None and got[4] is None and got[5] == 7.0
            for k in range(3):
                own = sorted(values[k])
                rank = sum(x <= got[k] for x in own) / len(own)
                assert abs(rank - share) <= (2.3 / size**0.9 if size < len(own) else 1 / len(own)), (size, share, rank)
    hours = sketches.coverage(sketches.hourly(frame, ["k"], "at", "s"), spark.createDataFrame([(0,), (1,), (9,)], "k int"), ["k"]).collect()
    assert len(hours) == 168 and all(r["pairs"] == 3 and r["covered"] <= 2 for r in hours) and sum(r["n"] for r in hours) == 20_000


def settled_by_hand(edges):
    """edges: {title: {route: tier}} of edges that are not pruned."""
    edges, taken, k = {t: dict(r) for t, r in edges.items()}, {}, 0
    while True:
        k += 1
        single = {t: next(iter(r)) for t, r in edges.items() if len(r) == 1 and next(iter(r.values())) is not None}
        wanted = collections.Counter(single.values())
        new = {t: r for t, r in single.items() if wanted[r] == 1}
        if not new:
            return taken
        taken |= {t: (r, k) for t, r in new.items()}
        edges = {t: {r: x for r, x in own.items() if r not in new.values()} for t, own in edges.items() if t not in new}


@pytest.mark.parametrize("seed", range(3))
def test_settled(spark, seed):
    rng = random.Random(seed)
    edges = {f"p{i}": {f"r{rng.randrange(12)}": rng.choice([None, *identity.TIERS]) for _ in range(rng.choice([1, 1, 2, 2, 3]))} for i in range(14)}
    edges["q0"] = {"s0": "official_link"}
    for i in range(1, 6):  # a chain: each page waits for the one before
        edges[f"q{i}"] = {f"s{i - 1}": "exact_terminals", f"s{i}": "exact_terminals"}
    rows = [(t, r, None, x) for t, own in edges.items() for r, x in own.items()] + [("q0", "s9", "region", None)]
    got = identity.settled(spark.createDataFrame(rows, "title string, route_id string, pruned string, tier string")).collect()
    want = settled_by_hand(edges)
    assert {r["title"]: (r["route_id"], r["round"]) for r in got} == want and want["q5"] == ("s5", 6)


def test_evidence_and_audit(spark):
    pages = spark.createDataFrame(
        [("a", "HK", ["r1"], ["X", "Y"], None), ("b", None, [], ["Y", "X"], ["u", "v"]), ("c", "NT", None, None, ["v", "u"]), ("d", None, None, ["Q", "R", "S"], None), ("e", None, None, None, None)],
        "title string, region string, links array<string>, terminals array<string>, stops array<string>",
    )
    candidates = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r1"), ("b", "r3"), ("c", "r1"), ("c", "r2"), ("d", "r3"), ("d", "r3")], "title string, route_id string")
    routes = spark.createDataFrame([("r1", "HK", "X", "Y", ["u", "w", "v"]), ("r1", "HK", "Y", "X", ["v", "u", "v"]), ("r2", "NT", "P", "Q", ["u", "v"]), ("r3", None, "Q", "R", None)], "route_id string, district string, origin string, destination string, stops array<string>")
    edges = identity.evidence(pages, candidates, routes)
    got = {(r["title"], r["route_id"]): (r["pruned"], r["tier"]) for r in edges.collect()}
    assert got == {("a", "r1"): (None, "official_link"), ("a", "r2"): ("region", None), ("b", "r1"): (None, "exact_terminals"), ("b", "r3"): (None, None), ("c", "r1"): ("region", None), ("c", "r2"): ("sequence", None), ("d", "r3"): (None, None)}
    told = {r["title"]: (r["status"], r["route_id"], r["mutual"]) for r in identity.audit(pages, edges).collect()}
    assert told == {
        "a": ("single_candidate_with_identity_evidence", "r1", False), "b": ("multiple_variants_or_unresolved", None, False), "c": ("all_candidates_conflict", None, False),
        "d": ("single_candidate_still_needs_identity_evidence", "r3", False), "e": ("no_operator_number_candidate", None, False),
    }


def test_integrity(spark):
    pages = spark.createDataFrame([("a", 1, "5", "done", "t"), ("b", 1, "5", "open", "t"), ("c", 1, "5", "done", "t"), ("d", 1, "6", "done", "t"), ("e", 1, "5", "done", " "), ("f", 1, "5", "done", "t")], "title string, page_id int, revision string, state string, text string")
    raw = spark.createDataFrame([("a", 1, 5, "x", "y"), ("b", 1, 5, "x", "y"), ("c", 2, 5, "x", "y"), ("d", 1, 5, "x", "y"), ("e", 1, 5, "x", "y")], "title string, page_id int, revision int, text string, source string")
    assert {r["title"]: r["reason"] for r in identity.integrity(pages, raw).collect()} == {"b": "not_done", "c": "other_page", "d": "other_revision", "e": "empty", "f": "not_fetched"}
    assert list(itertools.islice(identity.TIERS, 1)) == ["official_link"]


def test_equal_questions_are_searched_once(spark, monkeypatch):
    """A hundred requests of two questions: two are searched, all are answered."""
    rides = spark.createDataFrame([("a", 1, 2, 50, 90), ("b", 2, 3, 100, 140), ("c", 1, 3, 60, 200)], "trip_id string, from_stop int, to_stop int, dep_s int, arr_s int")
    requests = spark.createDataFrame([(i, 1, 2 + i % 2, 0) for i in range(100)], "request int, stop int, destination int, t int")
    asked, search = [], range_search.search
    monkeypatch.setattr(range_search, "search", lambda r, *rest: asked.append(r.count()) or search(r, *rest))
    got = collections.Counter((r["request"], r["dep_s"], r["arr_s"], r["rides"]) for r in range_search.plan(requests, rides, None, (100, 600), 1000, 2).collect())
    assert got == collections.Counter((i, *x) for i in range(100) for x in ([(50, 140, 2), (60, 200, 1)] if i % 2 else [(50, 90, 1)])) and asked == [2]
