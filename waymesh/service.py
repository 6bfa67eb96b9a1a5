"""The service's requests as functions: journeys, schedules, places, arrivals, status.

Each takes and returns plain values and plans DataFrames in between. A caller wires these to
any server; jobs run one at a time and append their progress with a cursor.
"""
from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators import ranking, routing, scheduling, spatial, stages

REQUEST_BYTES = 16_384


class Refused(ValueError):
    """A request that breaks a rule; the message names it."""


@dataclass
class Network:
    """What journeys are planned on: stops (stop_id, lat, lon, name), rides, walking transfers, and the window of the feed."""

    stops: DataFrame
    rides: DataFrame
    transfers: DataFrame | None
    start: str
    end: str


def route(spark: SparkSession, network: Network, request: dict) -> list[dict]:
    """Ranked journeys for one request {from: {lat, lon}, to: {lat, lon}, departure, modes, preference, maxResults}."""
    row = (1, *(float(request.get(p, {}).get(c)) if isinstance(request.get(p, {}).get(c), (int, float)) else None for p in ("from", "to") for c in ("lat", "lon")), request.get("departure"), request.get("modes") or list(stages.MODES), request.get("preference", "fastest"), request.get("maxResults", 6))
    asked = spark.createDataFrame([row], "request int, from_lat double, from_lon double, to_lat double, to_lon double, departure string, modes array<string>, preference string, max_results int")
    checked = stages.check_requests(asked, F.lit(network.start).cast("timestamp"), F.lit(network.end).cast("timestamp")).withColumn("clock", F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at")).first()
    if checked["problem"]:
        raise Refused(checked["problem"])
    near = lambda p, name: spatial.within(asked.select("request", F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lon").alias("lon")), network.stops.select(F.col("stop_id").alias(name), "lat", "lon"), 800.0)
    walk = lambda c: F.ceil(F.col(c) / 1.2).cast("int")
    starts = near("from", "stop").select("request", "stop", (F.lit(checked["clock"]) + walk("metres")).cast("int").alias("t"), F.col("metres").alias("m1"))
    labels = routing.earliest(starts.select("request", "stop", "t"), network.rides, network.transfers)
    ends = near("to", "stop").select("request", "stop", F.col("metres").alias("m2"))
    found = labels.where("rides > 0").join(ends, ["request", "stop"]).select("request", F.array_join("path", ";").alias("signature"), (F.col("t") + walk("m2")).alias("arrival"), F.col("m2").alias("walk"), (F.col("rides") - 1).alias("transfers"), "stop", "path")
    best = ranking.ranked(found, ["request"], "signature", checked["preference"], "stop", checked["max_results"]).orderBy("rank")
    return [{"rank": r["rank"], "arrival_s": r["arrival"], "elapsed_s": r["arrival"] - checked["clock"], "transfers": r["transfers"], "legs": [dict(zip(("trip", "from", "to"), x.split("|"))) for x in r["path"]]} for r in best.collect()]


def search(places: DataFrame, query: str) -> list[dict]:
    """Up to ten places (place_id, name, tier, lat, lon) for a query of 2 to 150 characters."""
    return [r.asDict() for r in ranking.search(places, query, "name", "tier", "place_id", 10).collect()]


@dataclass
class Job:
    id: str
    state: str = "running"
    events: list[dict] = field(default_factory=list)
    result: dict | None = None
    cancelled: bool = False

    def emit(self, kind: str, **values) -> None:
        self.events.append({"seq": len(self.events) + 1, "kind": kind, **values})


class Jobs:
    """One optimisation at a time; a request key that was seen gives its job again."""

    def __init__(self) -> None:
        self._lock, self._jobs, self._keys = threading.Lock(), {}, {}

    def start(self, request: dict, matrix: Callable[[scheduling.Spec], dict], actual: Callable | None = None, key: str | None = None, wait: bool = False) -> Job:
        spec = scheduling.validate(request)
        if spec.problems:
            raise Refused("; ".join(spec.problems))
        with self._lock:
            if key is not None and key in self._keys:
                return self._jobs[self._keys[key]]
            if any(j.state == "running" for j in self._jobs.values()):
                raise Refused("busy")
            job = Job(uuid.uuid4().hex)
            self._jobs[job.id] = job
            if key is not None:
                self._keys[key] = job.id
        thread = threading.Thread(target=self._run, args=(job, spec, matrix, actual), daemon=True)
        thread.start()
        if wait:
            thread.join()
        return job

    def _run(self, job: Job, spec: scheduling.Spec, matrix, actual) -> None:
        try:
            travel = matrix(spec)
            job.emit("matrix", pairs=len(travel))
            if job.cancelled:
                job.state = "cancelled"
                return
            result = scheduling.replay(spec, travel, actual or (lambda a, b, at: travel.get((a, b))))
            job.emit("checked", feasible=result["feasible"], issues=len(result.get("issues", [])))
            if result["feasible"]:
                result["events"] = scheduling.schedules(spec, result, result["matrix"]).to_dict("records")
            job.result, job.state = result, "cancelled" if job.cancelled else "done" if result["feasible"] else "failed"
        except Exception as error:  # the job reports it; the caller polls
            job.emit("error", message=str(error))
            job.state = "failed"

    def after(self, job_id: str, cursor: int = 0) -> tuple[str, list[dict]]:
        job = self._jobs[job_id]
        return job.state, [e for e in job.events if e["seq"] > cursor]

    def cancel(self, job_id: str) -> None:
        self._jobs[job_id].cancelled = True


def example(count: int = 4) -> dict:
    """A request that validates: `count` jobs of half an hour in one shift."""
    return {"jobs": [{"id": f"job{i + 1}", "serviceMinutes": 30} for i in range(max(1, min(100, count)))], "shift": {"start": "09:00", "end": "18:00"}}


def status(tables: dict[str, DataFrame]) -> list[dict]:
    """Rows of each loaded table."""
    out = None
    for name, frame in tables.items():
        row = frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.union(row)
    return [r.asDict() for r in out.collect()] if out is not None else []
