"""Streams driven to their end give what the batch gives; arrivals keep the freshness rules."""
import datetime as dt

from pyspark.sql import functions as F

from waymesh.operators.quality import same_rows
from waymesh.streaming import arrivals

NOW = dt.datetime(2024, 1, 1, 8, 0, 0)


def at(seconds):
    return NOW + dt.timedelta(seconds=seconds)


RECORD = "stop string, operator string, route string, direction string, service_type string, seq int, want_route string, want_direction string, want_seq int, want_service_type string, generated timestamp, updated timestamp, eta timestamp, remark string"


def row(stop="s", operator="kmb", route="1", generated=0, updated=0, eta=100, remark=None, service="1"):
    return (stop, operator, route, "O", service, 3, "1", "O", 3, "1", at(generated), at(updated), at(eta), remark)


def test_arrivals(spark):
    rows = [row(), row(), row(eta=200), row(eta=300), row(eta=400), row(eta=-20, remark="Scheduled Bus"), row("late", generated=-121), row("old", updated=-301), row("gmb", operator="gmb", updated=-900), row("other", route="2"), row("far", eta=10_801), row("variant", service="2")]
    df = spark.createDataFrame(rows, RECORD)
    now = F.lit(NOW)
    status = {r["stop"]: r["status"] for r in arrivals.judged(df.where("stop <> 's'"), now).collect()}
    assert status == {"late": "stale_payload", "old": "stale_record", "gmb": "live", "other": "other_service", "far": "out_of_horizon", "variant": "other_service"}
    got = arrivals.arrivals(df.where("stop = 's'"), now, ["stop"]).orderBy("place").collect()
    assert [(r["place"], r["kind"], r["wait_min"]) for r in got] == [(1, "scheduled", 0), (2, "live", 2), (3, "live", 4)]


def test_identity(spark):
    cross = spark.createDataFrame([("kmb", "1", "O", "a"), ("kmb", "1", "O", "b"), ("kmb", "1", "O", "b")], "operator string, route string, direction string, stop string")
    ask = spark.createDataFrame([(1, "kmb", "1", "O", "a"), (2, "kmb", "1", "O", "b"), (3, "kmb", "1", "O", "z"), (4, "bus", "1", "O", "a"), (5, "kmb", "1!", "O", "a")], "request int, operator string, route string, direction string, stop string")
    assert {r["request"]: r["reason"] for r in arrivals.identity_problems(ask, cross).collect()} == {2: "stop_repeats", 3: "not_verified", 4: "operator", 5: "route"}


def stream_of(spark, df, folder):
    df.write.parquet(f"file://{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"file://{folder}/in")


def events(spark):
    return spark.createDataFrame([(i, at(i * 700), "ab"[i % 2], float(i)) for i in range(60)] + [(5, at(5 * 700), "b", 5.0)], "id int, at timestamp, kind string, value double")


def test_stream_equals_batch(spark, tmp_path):
    batch = events(spark)
    stream = stream_of(spark, batch, tmp_path)
    for n, plan in enumerate((lambda e: arrivals.tumbling(e, "at", "1 hour", ["kind"]), lambda e: arrivals.sliding(e, "at", "2 hours", "1 hour", ["kind"]))):
        got = arrivals.run_available(plan(stream), f"windows{n}", "complete", str(tmp_path / f"c{n}"))
        assert same_rows(plan(batch), got).first()["same"]


def test_append_mode_closes_windows_behind_the_watermark(spark, tmp_path):
    batch = events(spark)
    plan = arrivals.tumbling(arrivals.late(stream_of(spark, batch, tmp_path), "at", "1 hour"), "at", "1 hour", [])
    got = arrivals.run_available(plan, "closed", "append", str(tmp_path / "c"))
    whole = arrivals.tumbling(batch, "at", "1 hour", [])
    assert 0 < got.count() < whole.count() and got.join(whole, ["start", "n"], "left_anti").count() == 0


def test_dedupe_and_ttl(spark, tmp_path):
    batch = events(spark)
    stream = stream_of(spark, batch, tmp_path)
    got = arrivals.run_available(arrivals.distinct_live(stream, "at", "1 hour", ["id"]), "distinct_rows", "append", str(tmp_path / "c"))
    assert got.count() == 60
    ttl = arrivals.latest_with_ttl(arrivals.late(stream, "at", "1 minute"), "kind", "at", "value")
    last = arrivals.run_available(ttl, "latest", "update", str(tmp_path / "d"))
    assert {r["kind"]: r["value"] for r in last.collect()} == {"a": 58.0, "b": 59.0}


def test_stream_equal_compares_on_any_path(spark, monkeypatch):
    """A path with a scheme is streamed too: a stream that loses rows there is not reported as equal."""
    from waymesh.plans import streaming_q

    for d in ("/root/testdata/sf0.001", "file:///root/testdata/sf0.001"):
        row = streaming_q.x_stream_equal(spark, d).first()
        assert row["n"] > 0 and row["same"] is True
    run = arrivals.run_available
    monkeypatch.setattr(arrivals, "run_available", lambda *a: run(*a).limit(1))
    assert streaming_q.x_stream_equal(spark, "file:///root/testdata/sf0.001").first()["same"] is False
