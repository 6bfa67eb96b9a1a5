"""Every query of the catalogue against its DuckDB oracle on the smallest tables."""
import math
import os

import duckdb
import pytest

from waymesh.functions import geo
from waymesh.plans import catalogue

from .test_search import settled_by_hand

DATA = "/root/testdata/sf0.001"
#: For what the smallest tables give no rows.
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def chosen_places(duck, got):
    """The greedy choice by a loop over all rows in order."""
    degree, want = geo.DEGREE, {}
    rows = duck.execute("select vec_id, label, 22.2 + (embedding[1]::double + 1) * 0.1, 113.9 + (embedding[2]::double + 1) * 0.1 from embeddings").fetchall()
    flat = lambda a, b, c, e: math.hypot((c - a) * degree, (e - b) * degree * math.cos(math.radians((a + c) / 2)))
    for vec, label, lat, lon in sorted(rows, key=lambda r: (flat(22.3, 114.0, r[2], r[3]), r[0])):
        own = want.setdefault(label, [])
        if len(own) < 20 and all(math.hypot((a - lat) * degree, (b - lon) * degree * math.cos(math.radians(lat))) >= 150 for _, a, b in own):
            own.append((vec, lat, lon))
    assert {(r["label"], r["place"], r["vec_id"]) for r in got} == {(k, i, v[0]) for k, own in want.items() for i, v in enumerate(own)}


def indoor_venues(duck, got):
    """A venue for each nation with a platform, its third supplier; it has paths exactly where it has seconds."""
    venues = {r[0] for r in duck.execute(f"select s_nationkey from '{LARGER}/supplier.parquet' group by 1 having count(*) >= 3").fetchall()}
    assert venues and {r["venue"] for r in got} == venues
    assert all((r["n_paths"] is None) == (r["seconds"] is None) for r in got) and any(r["n_paths"] for r in got)


def stream_is_batch(duck, got):
    assert got and all(r["same"] for r in got)


def settled_pages(duck, got):
    """Rounds of unique matches over the evidence that SQL gives."""
    edges = {}
    for name in ("orders", "lineitem", "part"):
        duck.execute(f"create or replace view {name} as select * from '{DATA}/{name}.parquet'")
    for title, route, pruned, tier in duck.execute(catalogue.oracle_sql()["d7_evidence"]).fetchall():
        if pruned is None:
            edges.setdefault(title, {})[route] = tier
    assert {r["title"]: (r["route_id"], r["round"]) for r in got} == settled_by_hand(edges) and got


NO_SQL = {"d7_identity_settled": settled_pages, "o5_greedy": chosen_places, "d17_indoor": indoor_venues, "x_stream_equal": stream_is_batch}


def test_every_query_is_checked():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == set(NO_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, LARGER if name == "d17_indoor" else DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        NO_SQL[name](duck, [dict(zip(columns, row)) for row in got])
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
