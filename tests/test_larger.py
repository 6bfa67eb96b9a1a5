"""Queries on tables that the driver's smallest ones do not stand for: hot keys, copies, many rows of a key."""
import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from waymesh.functions import geo
from waymesh.operators import spatial, stages
from waymesh.plans import catalogue


def same_as_sql(spark, folder, name, **tables):
    """Write the tables, run a query and its SQL over them, and compare all rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want and want
    return df


def test_quantiles_of_many_observations(spark, tmp_path):
    """One pair has more observations than a sketch holds."""
    rng = random.Random(2)
    n = 30_000
    ids = pa.array([15 * i + 1 for i in range(n)] + [400, 800, 5], pa.int64())
    stamps = pa.array([i * 60_000_000 for i in range(n)] + [0, 0, 0], pa.timestamp("us"))
    values = pa.array([round(rng.expovariate(0.02), 4) for _ in range(n)] + [1.0, 2.0, 3.0])
    same_as_sql(spark, tmp_path, "a15_merged_quantiles", events=pa.table({"event_id": ids, "ts": stamps, "user_id": pa.array([0] * n + [3, 3, 4], pa.int64()), "event_type": ["view"] * (n + 3), "value": values}))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_interchanges_shuffle_journeys_thrice(spark):
    """By journey to number its sections, by section, by journey again; the rest are a timetable's own bands."""
    for name in ("d15_interchange_windows", "d15_interchange_lanes", "d15_interchange_refused"):
        assert shuffles(catalogue.queries()[name](spark, "/root/testdata/sf0.001")) <= 9, name


def test_rail_records_are_shuffled_once(spark):
    """By path; what else is shuffled is the baseline and the calendar. Records in conflict are found without pairs."""
    for name in ("d10_rail_bands", "d10_rail_refused"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert shuffles(df) <= 6 and plan.count("lineitem.parquet") == 1, name


@pytest.mark.parametrize("sphere", [True, False])
def test_closest_is_exact_at_any_density(spark, sphere):
    """A dense clump, copies of one place, and a thin rest, in tiles of twenty places, against all pairs."""
    rng = random.Random(4)
    spots = [(22.3 + rng.gauss(0, 0.00005), 114.1 + rng.gauss(0, 0.00005)) for _ in range(150)] + [(22.31, 114.1)] * 30 + [(rng.uniform(22.2, 22.4), rng.uniform(114.0, 114.2)) for _ in range(120)]
    points = list(enumerate(spots))
    frame = spark.createDataFrame([(i, *x) for i, x in points] + [(900, None, 114.1), (901, 22.3, float("nan"))], "id int, lat double, lon double")

    def metres(p, q):
        (a, b), (c, e) = p, q
        if not sphere:
            return math.hypot((c - a) * geo.DEGREE, (e - b) * geo.DEGREE * math.cos(math.radians(a)))
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(e - b) / 2) ** 2
        return 2 * geo.EARTH * math.asin(min(1.0, math.sqrt(h)))

    got = {}
    for r in spatial.closest(frame, frame.withColumnRenamed("id", "mark"), "id", "mark", 4, 2500.0, sphere, True, 20).collect():
        got[r["id"], r["rank"]] = r["mark"]
    want = {}
    for i, p in points:
        near = sorted((d, j) for j, q in points if j != i and (d := metres(p, q)) <= 2500)[:4]
        want |= {(i, n + 1): j for n, (_, j) in enumerate(near)}
    assert got == want


def test_entry_pairs_are_made_once(spark):
    """Joint routes, several numbers and titles: each pair is made once, and no pair is shuffled."""
    routes = spark.createDataFrame([("r1", "KMB+CTB", "1a"), ("r1", "KMB", "1A"), ("r1", "CTB", "2"), ("r2", "NLB", "2"), ("r3", "KMB", None)], "route_id string, agency string, number string")
    entries = spark.createDataFrame([("e1", "Kx", "1A"), ("e1", "Cx", "1a"), ("e1", "Cy", "2"), ("e2", "Nx", "2"), ("e2", None, "2"), ("e3", "Kx", None)], "entry string, title string, number string")
    got = stages.entry_candidates(routes, entries, spark.createDataFrame([("kmb", "K"), ("ctb", "C"), ("ctb", "Cx"), ("nlb", "N")], "operator string, prefix string"))
    assert sorted(map(tuple, got.collect())) == [("r1", "e1"), ("r2", "e2")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in x for x in plan[: next(i for i, x in enumerate(plan) if "Join" in x)])
