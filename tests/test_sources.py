"""The archive data source against the plain CSV of its members."""
import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from waymesh.sources import archives

COLUMNS = ["trip_id", "stop_sequence", "name", "lat"]
SCHEMA = "trip_id string, stop_sequence int, name string, lat double"


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(f"t{i}", rng.choice(["", " 7 ", str(i)]), rng.choice(["", " ", "a, \"b\"", "é" * 5, "plain"]), rng.choice(["", "22.5"])) for i in range(n)]


def plain(row):
    trip, seq, name, lat = (x.strip() or None for x in row)
    return trip, int(seq) if seq else None, name, float(lat) if lat else None


def packed(path, rows, stored=False, bom=True, end="\r\n", last_end=True):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(COLUMNS)
    w.writerows(rows)
    text = out.getvalue() if last_end else out.getvalue()[: -len(end)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.txt", "x\n1\n")
        z.writestr("stop_times.txt", ("﻿" if bom else "") + text)


def read(spark, path, split, schema=SCHEMA, member="stop_times.txt"):
    archives.register(spark)
    return spark.read.format(archives.NAME).schema(schema).option("member", member).option("splitBytes", split).load(str(path))


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_ranges(spark, tmp_path, stored, split):
    rows = rows_of(60 if split < 64 else 400, split)
    packed(tmp_path / "a.zip", rows, stored, end="\n" if split == 64 else "\r\n", last_end=split != 1000)
    packed(tmp_path / "b.zip", [], stored)
    df = read(spark, tmp_path, split)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(plain(r)) for r in rows)
    if split == 1000:
        assert df.rdd.getNumPartitions() > 5


def test_range_borders_lose_no_line():
    """Every split of a member gives each line once."""
    rows = rows_of(25, 1)
    out = io.BytesIO()
    packed(out, rows)
    path_rows = sorted(str(plain(r)) for r in rows)
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".zip") as f:
        f.write(out.getvalue())
        f.flush()
        for split in (1, 2, 3, 5, 11, 29, 10_000):
            from pyspark.sql.types import _parse_datatype_string  # noqa: F401

            reader = archives.FeedReader({"path": f.name, "member": "stop_times.txt", "splitBytes": str(split)}, _schema())
            got = [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
            assert sorted(map(str, got)) == path_rows, split


def _schema():
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

    return StructType().add("trip_id", StringType()).add("stop_sequence", IntegerType()).add("name", StringType()).add("lat", DoubleType())


def test_columns_and_filters(spark, tmp_path):
    rows = rows_of(300, 2)
    packed(tmp_path / "a.zip", rows)
    df = read(spark, tmp_path, 500, "stop_sequence int, trip_id string, missing string")
    kept = df.where((F.col("stop_sequence") > 100) & F.col("trip_id").startswith("t1") & F.col("trip_id").isin("t150", "t160", "t170"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "startswith" not in plan.lower()
    want = {(int(q), t) for t, q, _, _ in (plain(r) for r in rows) if q and q > 100 and t in ("t150", "t160", "t170")}
    assert {(r["stop_sequence"], r["trip_id"]) for r in kept.collect()} == want
    assert df.where("missing IS NULL").count() == 300 and df.where("stop_sequence IS NULL").count() == sum(plain(r)[1] is None for r in rows)


def test_missing_members_and_empty_folders(spark, tmp_path):
    packed(tmp_path / "a.zip", rows_of(3, 3))
    assert read(spark, tmp_path, 100, "a string", "none.txt").count() == 0
    assert read(spark, tmp_path, 100, "x int", "other.txt").collect()[0]["x"] == 1
    (tmp_path / "empty").mkdir()
    assert read(spark, tmp_path / "empty", 100).count() == 0


def test_wrong_values_fail(spark, tmp_path):
    packed(tmp_path / "a.zip", [("t", "many", "", "")])
    with pytest.raises(Exception, match="many"):
        read(spark, tmp_path, 100).collect()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stop_times.txt", ",".join(COLUMNS) + "\na,1\n")
    with pytest.raises(Exception, match="columns"):
        read(spark, tmp_path, 100).collect()


def test_multiline(spark, tmp_path):
    packed(tmp_path / "a.zip", [("t1", "1", "two\nlines", ""), ("t2", "2", "one", "")])
    archives.register(spark)
    df = spark.read.format(archives.NAME).schema(SCHEMA).option("member", "stop_times.txt").option("multiline", True).option("splitBytes", 10).load(str(tmp_path))
    assert {r["name"] for r in df.collect()} == {"two\nlines", "one"} and df.rdd.getNumPartitions() == 1


def test_round_trip(spark, tmp_path):
    archives.register(spark)
    rows = [("a", 1, "x, \"y\"", 1.5), ("b", None, None, None), ("c", 3, "é", -0.25)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    df.write.format(archives.NAME).option("member", "m.txt").mode("append").save(str(tmp_path / "out"))
    assert sorted(map(str, map(tuple, read(spark, tmp_path / "out", 5, member="m.txt").collect()))) == sorted(map(str, rows))
    assert not [x for x in (tmp_path / "out").iterdir() if x.suffix != ".zip"]


def test_digests_and_changes(spark):
    from waymesh.sources import rebuild

    rows = [("a", 1, None), ("a", 2, "x"), ("b", 1, ""), ("c", 5, "z")]
    one = rebuild.digests(spark.createDataFrame(rows, "part string, k int, v string"))
    again = rebuild.digests(spark.createDataFrame(rows[::-1], "part string, k int, v string").repartition(3).select("v", "part", "k"))
    assert rebuild.changed(one, again).count() == 0
    other = rebuild.digests(spark.createDataFrame([("a", 1, ""), ("a", 2, "x"), ("b", 1, ""), ("b", 1, ""), ("d", 5, "z")], "part string, k int, v string"))
    assert {(r["part"], r["change"]) for r in rebuild.changed(one, other).collect()} == {("a", "changed"), ("b", "changed"), ("c", "removed"), ("d", "added")}


def test_rebuild(spark, tmp_path):
    """Only touched parts are run again; a failed build leaves the published one; a new version recomputes all."""
    from waymesh.sources import rebuild

    store = rebuild.Store(spark, f"file://{tmp_path}/store")
    base = lambda rows: {"t": spark.createDataFrame(rows, "part string, k int")}
    counts = rebuild.Stage("counts", ("t",), lambda x: x["t"].groupBy("part").agg(F.sum("k").alias("s")))
    # halves: parts a, b go into `low`, others into `high`
    half = F.when(F.col("part").isin("a", "b"), "low").otherwise("high")
    names = spark.createDataFrame([(p,) for p in "abcd"], "part string")
    halves = rebuild.Stage(
        "halves", ("counts",), lambda x: x["counts"].groupBy(half.alias("part")).agg(F.sum("s").alias("s")), lambda _, parts: parts.select(half.alias("part")), lambda _, parts: names.join(parts.select(F.col("part").alias("h")), half == F.col("h")).select("part")
    )
    read = lambda stage: {r["part"]: r["s"] for r in store.read(stage, "part string, s bigint").collect()}
    said = lambda report: {(r["stage"], r["part"], r["change"]) for r in report.collect()}
    assert store.current() is None and store.manifest().count() == 0
    _, report = rebuild.rebuild(store, base([("a", 1), ("b", 2), ("c", 3)]), [counts, halves])
    assert read(halves) == {"low": 3, "high": 3} and said(report) == {(s, p, "added") for s, p in [("counts", "a"), ("counts", "b"), ("counts", "c"), ("halves", "low"), ("halves", "high")]}
    first, report = rebuild.rebuild(store, base([("a", 0), ("a", 1), ("b", 5), ("c", 3), ("d", 1)]), [counts, halves])
    assert read(halves) == {"low": 6, "high": 4}
    assert said(report) == {("counts", "a", "same"), ("counts", "b", "changed"), ("counts", "d", "added"), ("halves", "low", "changed"), ("halves", "high", "changed")}
    _, report = rebuild.rebuild(store, base([("a", 0), ("a", 1), ("b", 5), ("c", 3), ("d", 1)]), [counts, halves])
    assert said(report) == set() and read(counts) == {"a": 1, "b": 5, "c": 3, "d": 1}
    build = store.current()
    broken = rebuild.Stage("counts", ("t",), lambda x: x["t"].groupBy("part").agg(F.raise_error(F.lit("no")).alias("s")), version="2")
    with pytest.raises(Exception, match="no"):
        rebuild.rebuild(store, base([("a", 9)]), [broken])
    assert store.current() == build and read(halves) == {"low": 6, "high": 4}
    twice = rebuild.Stage("counts", ("t",), lambda x: x["t"].groupBy("part").agg((2 * F.sum("k")).alias("s")), version="2")
    _, report = rebuild.rebuild(store, base([("a", 0), ("a", 1), ("b", 5), ("c", 3), ("d", 1)]), [twice])
    assert len(said(report)) == 4 and read(twice) == {"a": 2, "b": 10, "c": 6, "d": 2}
    assert {r["part"]: r["s"] for r in store.read(counts, "part string, s bigint", first).collect()} == {"a": 1, "b": 5, "c": 3, "d": 1}


def test_grammars():
    import dataclasses

    from waymesh.sources import grammars as g

    hour = dataclasses.replace(g.HOUR_MINUTE, legend={"a": "via A", "red": "short"})
    got = list(g.read([["Line 1", "Line 1"], ["Hour", "Minutes"], ["Weekdays", "Weekdays"], ["5-6", "05a 20"], ["7", "12"], ["1", "0"], ["x", "1"], ["8", "n/a"], ["9", "4b"], ["", ""], ["10", "10"], ["31", "1"]], [[], [], [], [], [None, "red"]], [g.FIRST_LAST, hour]))
    times = [(r["start_s"], r["branch"]) for r in got if "reason" not in r]
    assert times == [(18300, "via A"), (19200, None), (21900, "via A"), (22800, None), (25920, "short"), (90000, None), (36600, None)] and all(r["day"] == "Weekdays" for r in got)
    assert [(r["row"], r["reason"]) for r in got if "reason" in r] == [(6, "unread_hour"), (7, "unread_minutes"), (8, "unknown_mark"), (11, "unread_hour")]
    two = list(g.read([["小時", "分鐘", "小時", "分鐘"], ["6", "1", "7", "2"]], None, [g.HOUR_MINUTE]))
    assert [r["start_s"] for r in two] == [21660, 25320]
    bands = list(g.read([["Period", "Every A", "Headway"], ["06:00–09:30", "4-5", "2.5"], ["22:00-01:00", "9", ""], ["all day", "1", "1"], ["10:00-11:00", "5-3", "0"]], None, [g.HOUR_MINUTE, g.HEADWAY]))
    assert [(r["branch"], r["start_s"], r["end_s"], r["low_s"], r["high_s"]) for r in bands if "reason" not in r] == [("A", 21600, 34200, 240, 300), (None, 21600, 34200, 150, 150), ("A", 79200, 90000, 540, 540)]
    assert [r["reason"] for r in bands if "reason" in r] == ["unread_period", "unread_headway", "unread_headway"]
    ends = list(g.read([["Station", "First train", "Last train", "Platform"], ["Hill", "05:50", "00:40", "2"], ["Bay", "late", "23:00", ""]], None, [g.FIRST_LAST]))
    assert (ends[0]["start_s"], ends[0]["end_s"], ends[0]["platform"]) == (21000, 88800, "2") and ends[1]["reason"] == "unread_clock"
    assert [r["platform"] for r in g.read([["Station", "Platform"], ["Hill", "3"]], None, [g.FIRST_LAST, g.PLATFORMS])] == ["3"]
    assert [r["reason"] for r in g.read([["a", "b"], ["1", "2"]], None, [g.HEADWAY])] == ["no_grammar"] and not list(g.read([], None, [g.HEADWAY])) and not list(g.read(None, None, []))
    with pytest.raises(ValueError, match="colour"):
        g.Grammar("x", (("a", "colour"),), ())


@pytest.mark.parametrize("stored", [False, True])
def test_deflated_members_have_few_ranges(tmp_path, stored):
    """Each range of a deflated member inflates all before it; together they cover the member, whatever the split."""
    packed(tmp_path / "a.zip", rows_of(400, 3), stored)
    reader = archives.FeedReader({"path": str(tmp_path), "member": "stop_times.txt", "splitBytes": "50"}, _schema())
    parts = reader.partitions()
    assert len(parts) == 8 if not stored else len(parts) > 100
    assert parts[0].start == 0 and parts[-1].end == parts[0].size and all(a.end == b.start for a, b in zip(parts, parts[1:]))
    assert sum(batch.num_rows for part in parts for batch in reader.read(part)) == 400
