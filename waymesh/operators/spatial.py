"""Distance joins over grid cells, matrices, and order-dependent spatial greedies.

A point meets only the cells its radius can reach, so the join is an equi join on cells; the
radius must not exceed the reach of the neighbourhood, which is checked.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.operators.routing import cut


def _cells(rows: DataFrame, size: float) -> DataFrame:
    return rows.withColumns({"__y": geo.cell(F.col("lat"), size), "__x": geo.cell(F.col("lon"), size)})


def _neighbourhood(queries: DataFrame, size: float, reach: int) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    spread = _cells(queries, size).withColumn("__n", F.explode(steps))
    return spread.withColumns({"__y": F.col("__y") + F.col("__n.dy"), "__x": F.col("__x") + F.col("__n.dx")}).drop("__n")


def nearest(queries: DataFrame, marks: DataFrame, query_id: str, mark_id: str, radius: float, size: float = 0.005, others: bool = False) -> DataFrame:
    """(query_id, mark_id, metres): the nearest mark within radius, by flat distance, ties by mark_id.

    With `others` a mark of the query's own id does not count.

    Five by five cells are searched, so the radius may not exceed two cells of longitude.
    """
    reach = 2
    if radius > reach * size * geo.DEGREE * math.cos(math.radians(45)):
        raise ValueError("the radius exceeds the searched cells")
    m = _cells(marks, size).select(mark_id, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "__y", "__x")
    got = _neighbourhood(queries, size, reach).join(m, ["__y", "__x"]).withColumn("metres", geo.flat_metres(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")))
    if others:
        got = got.where(F.col(query_id) != F.col(mark_id))
    best = got.where(F.col("metres") <= radius).groupBy(query_id).agg(F.min(F.struct("metres", mark_id)).alias("x"))
    return best.select(query_id, F.col(f"x.{mark_id}").alias(mark_id), F.col("x.metres").alias("metres"))


def within(queries: DataFrame, marks: DataFrame, radius: float) -> DataFrame:
    """queries x marks within radius metres on the sphere (`metres` added); cells of the radius' size."""
    size = radius / geo.DEGREE
    # at 60 degrees a degree of longitude is half as long: two cells to each side always suffice
    m = _cells(marks.withColumnRenamed("lat", "__lat").withColumnRenamed("lon", "__lon").withColumns({"lat": F.col("__lat"), "lon": F.col("__lon")}), size).drop("lat", "lon")
    got = _neighbourhood(queries, size, 2).join(m, ["__y", "__x"]).withColumn("metres", geo.haversine(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")))
    return got.where(F.col("metres") <= radius).drop("__y", "__x", "__lat", "__lon")


def _metres(sphere: bool, lat, lon, lats, lons):
    """Distances of points to marks, a matrix; nearly those of the column functions."""
    dy, dx = np.radians(lats[None, :] - lat[:, None]), np.radians(lons[None, :] - lon[:, None])
    if not sphere:
        return np.hypot(np.degrees(dy) * geo.DEGREE, np.degrees(dx) * geo.DEGREE * np.cos(np.radians(lat))[:, None])
    a = np.sin(dy / 2) ** 2 + np.cos(np.radians(lat))[:, None] * np.cos(np.radians(lats))[None, :] * np.sin(dx / 2) ** 2
    return 2 * geo.EARTH * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _tile(lat, lon, cuts, inner) -> np.ndarray:
    """Numbers of the tiles that points lie in: strips of latitude, cut by longitude."""
    strip = np.searchsorted(cuts, lat, "right")
    first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in inner])])
    return np.array([first[i] + np.searchsorted(inner[i], x, "right") for i, x in zip(strip, lon)], dtype="int64")


def closest(queries: DataFrame, marks: DataFrame, query_id: str, mark_id: str, k: int, radius: float, sphere: bool = True, others: bool = False, per_tile: int = 400) -> DataFrame:
    """(query_id, mark_id, metres, rank): the k nearest marks within radius, ties by mark_id; exact at any density.

    With `others` a mark of the query's own id does not count. Work does not grow with the marks
    inside the radius: different places are dealt to tiles of about `per_tile` each, by quantiles, a
    query's own tile bounds its k-th distance, and only tiles that this distance reaches are searched
    too. Equal places are one, with their k + 1 smallest ids. What is found is measured again and
    ranked by the column functions. The cuts, a number for each tile, pass through the driver.
    """
    real = lambda d: d.where("NOT isnan(lat) AND NOT isnan(lon)")  # noqa: E731  null is neither
    near = real(marks).groupBy("lat", "lon").agg(F.slice(F.array_sort(F.collect_set(mark_id)), 1, k + 1).alias("ids"))
    places = cut(near.withColumnRenamed("ids", "__ids"))
    tiles = max(1, math.ceil(places.count() / per_tile))
    strips = math.ceil(math.sqrt(tiles))
    shares = lambda n: [i / n for i in range(1, n)]
    cuts = sorted(set(places.approxQuantile("lat", shares(strips), 0.2 / strips))) if strips > 1 else []
    inner = [[] for _ in range(len(cuts) + 1)]
    if strips > 1:
        strip = F.size(F.filter(F.lit(cuts), lambda x: x <= F.col("lat")))
        for r in places.groupBy(strip.alias("s")).agg(F.count("*").alias("n"), F.percentile_approx("lon", F.array(*[F.lit(x) for x in shares(4 * strips)]), F.lit(100 * strips)).alias("q")).collect():
            n = max(1, min(4 * strips, round(r["n"] / per_tile)))
            inner[r["s"]] = sorted({r["q"][round(4 * strips * x) - 1] for x in shares(n)})

    def dealt(frames):
        for f in frames:
            yield f.assign(tile=_tile(f["lat"].to_numpy(), f["lon"].to_numpy(), cuts, inner))

    def bounded(key, q: pd.DataFrame, m: pd.DataFrame):
        """The distance within which a query's own tile has k marks at other places than its own."""
        out = np.full(len(q), float(radius))
        lats, lons = m["lat"].to_numpy(), m["lon"].to_numpy()
        if len(m) > k:
            for i in range(0, len(q), 1000):
                lat, lon = q["lat"].to_numpy()[i : i + 1000], q["lon"].to_numpy()[i : i + 1000]
                d = _metres(sphere, lat, lon, lats, lons)
                d[(lats[None, :] == lat[:, None]) & (lons[None, :] == lon[:, None])] = np.inf
                out[i : i + 1000] = np.minimum(radius, np.partition(d, k - 1, axis=1)[:, k - 1])
        return q[["lat", "lon"]].assign(reach=out * (1 + 1e-9) + 1e-6)

    def sent(frames):
        first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in inner])])
        for f in frames:
            rows = []
            for lat, lon, reach in zip(f["lat"], f["lon"], f["reach"]):
                dy = reach / 111_000
                flat = math.cos(math.radians(min(90.0, abs(lat) + dy)))
                dx = 360.0 if flat < 1e-6 else dy / flat
                for s in range(np.searchsorted(cuts, lat - dy, "right"), np.searchsorted(cuts, lat + dy, "right") + 1):
                    a, b = np.searchsorted(inner[s], [lon - dx, lon + dx], "right")
                    rows += [(lat, lon, reach, int(first[s]) + i) for i in range(a, b + 1)]
            yield pd.DataFrame(rows, columns=["lat", "lon", "reach", "tile"]).astype({"tile": "int64"})

    def searched(key, q: pd.DataFrame, m: pd.DataFrame):
        """Each query's places of a tile within its reach; at most its k nearest, more where they tie, and its own."""
        lats, lons, got = m["lat"].to_numpy(), m["lon"].to_numpy(), []
        for i in range(0, len(q) if len(m) else 0, 1000):
            part = q.iloc[i : i + 1000]
            d = _metres(sphere, part["lat"].to_numpy(), part["lon"].to_numpy(), lats, lons)
            most = part["reach"].to_numpy()
            if len(m) > k + 1:
                most = np.minimum(most, np.partition(d, k, axis=1)[:, k] * (1 + 1e-9) + 1e-6)
            x, y = np.nonzero(d <= most[:, None])
            got.append(pd.DataFrame({"lat": part["lat"].to_numpy()[x], "lon": part["lon"].to_numpy()[x], "__lat": lats[y], "__lon": lons[y]}))
        return pd.concat(got) if got else pd.DataFrame({"lat": [], "lon": [], "__lat": [], "__lon": []}, dtype="float64")

    in_tiles = places.select("lat", "lon").mapInPandas(dealt, "lat double, lon double, tile bigint")
    asks = real(queries).select("lat", "lon").distinct().mapInPandas(dealt, "lat double, lon double, tile bigint")
    reach = asks.groupBy("tile").cogroup(in_tiles.groupBy("tile")).applyInPandas(bounded, "lat double, lon double, reach double")
    pairs = reach.mapInPandas(sent, "lat double, lon double, reach double, tile bigint").groupBy("tile").cogroup(in_tiles.groupBy("tile")).applyInPandas(searched, "lat double, lon double, __lat double, __lon double")
    own = places.withColumnsRenamed({"lat": "__lat", "lon": "__lon"})
    ids = pairs.join(own, ["__lat", "__lon"]).select("lat", "lon", "__lat", "__lon", F.explode("__ids").alias(mark_id))
    got = queries.select(query_id, "lat", "lon").join(ids, ["lat", "lon"])
    if others:
        got = got.where(F.col(query_id) != F.col(mark_id))
    far = (geo.haversine if sphere else geo.flat_metres)(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    best = Window.partitionBy(query_id).orderBy("metres", mark_id)
    told = got.withColumn("metres", far).where(F.col("metres") <= radius).withColumn("rank", F.row_number().over(best))
    return told.where(F.col("rank") <= k).select(query_id, mark_id, "metres", "rank")


def unique_near(queries: DataFrame, nodes: DataFrame, query_id: str, node_id: str, metres: float, rise: float) -> DataFrame:
    """(query_id, node_id, n): the node within metres in plan and rise in height, only if it is the only one.

    Plane coordinates x, y, z; joined on cells of the tolerance.
    """
    cell = lambda c: F.floor(F.col(c) / metres)
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = queries.select(query_id, "x", "y", "z", F.explode(near).alias("__n")).withColumns({"__cx": cell("x") + F.col("__n.dx"), "__cy": cell("y") + F.col("__n.dy")})
    m = nodes.select(node_id, F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("z").alias("__z"), cell("x").alias("__cx"), cell("y").alias("__cy"))
    got = q.join(m, ["__cx", "__cy"]).where((F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) <= metres) & (F.abs(F.col("z") - F.col("__z")) <= rise))
    found = got.groupBy(query_id).agg(F.count_distinct(node_id).alias("n"), F.min(node_id).alias("__one"))
    return queries.select(query_id).join(found, query_id, "left").select(query_id, F.when(F.col("n") == 1, F.col("__one")).alias(node_id), F.coalesce("n", F.lit(0)).alias("n"))


def matrix(points: DataFrame, known: DataFrame) -> DataFrame:
    """All directed pairs of points (column p) with their seconds; null where unknown.

    The cross join is over the points of one request, a list of at most hundreds.
    """
    a, b = points.select(F.col("p").alias("origin")), points.select(F.col("p").alias("destination"))
    return a.crossJoin(b).where("origin <> destination").join(known, ["origin", "destination"], "left")


def canonical_vertices(rows: DataFrame, group: str, vertex: str, plan: float = 0.01, rise: float = 0.005) -> DataFrame:
    """Adds `canonical`: the first vertex (by x, y, z, id) within plan and rise metres; matches do not chain.

    The greedy depends on the order in a venue, so a venue is one task; venues are bounded.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", canonical {rows.schema[vertex].dataType.simpleString()}"

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x", "y", "z", vertex], kind="stable")
        seen: dict[tuple, list] = {}
        out = []
        for x, y, z, v in zip(frame["x"], frame["y"], frame["z"], frame[vertex]):
            cx, cy = math.floor(x / plan), math.floor(y / plan)
            hit = next((o for i in (-1, 0, 1) for j in (-1, 0, 1) for o in seen.get((cx + i, cy + j), []) if math.hypot(o[0] - x, o[1] - y) <= plan and abs(o[2] - z) <= rise), None)
            if hit is None:
                hit = (x, y, z, v)
                seen.setdefault((cx, cy), []).append(hit)
            out.append(hit[3])
        return frame.assign(canonical=out)

    return rows.groupBy(group).applyInPandas(pick, schema)


def separated(rows: DataFrame, group: list[str], order: list[str], metres: float, most: int) -> DataFrame:
    """Greedy choice in order: rows at least `metres` from all chosen before, at most `most` of a group."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", place int"

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        chosen: list[tuple[float, float]] = []
        kept = []
        for k, (lat, lon) in enumerate(zip(frame["lat"], frame["lon"])):
            if len(chosen) == most:
                break
            scale = math.cos(math.radians(lat))
            if all(math.hypot((a - lat) * geo.DEGREE, (b - lon) * geo.DEGREE * scale) >= metres for a, b in chosen):
                chosen.append((lat, lon))
                kept.append(k)
        return frame.iloc[kept].assign(place=np.arange(len(kept), dtype="int32"))

    return rows.groupBy(*group).applyInPandas(pick, schema)


def match_stops(line: np.ndarray, stops: np.ndarray, tolerance: float) -> np.ndarray | None:
    """Distances along the line of stops that visit it in order, or None.

    The line is turned if its ends are nearer that way; both end stops must be in tolerance of the
    ends, which they are pinned to. Each run of neighbouring segments within tolerance gives a stop
    one candidate; the least sum of squared errors with non-decreasing places is taken. Stops over
    15 m apart may not fall together (under 1 m).
    """
    gap = lambda p, q: float(np.hypot(*(p - q)))
    if gap(line[0], stops[-1]) + gap(line[-1], stops[0]) < gap(line[0], stops[0]) + gap(line[-1], stops[-1]):
        line = line[::-1]
    total = geo.along(line)
    if gap(line[0], stops[0]) > tolerance or gap(line[-1], stops[-1]) > tolerance:
        return None
    a, d = line[:-1], np.diff(line, axis=0)
    size = np.maximum((d**2).sum(1), 1e-300)
    share = np.clip(((stops[:, None, :] - a) * d).sum(-1) / size, 0, 1)
    error = np.sqrt((((a + share[..., None] * d) - stops[:, None, :]) ** 2).sum(-1))
    place = total[:-1] + share * np.sqrt(size)
    choices: list[list[tuple[float, float]]] = []
    for k in range(len(stops)):
        if k == 0 or k == len(stops) - 1:
            choices.append([(0.0 if k == 0 else float(total[-1]), 0.0)])
            continue
        near = np.flatnonzero(error[k] <= tolerance)
        if not len(near):
            return None
        runs = np.split(near, np.flatnonzero(np.diff(near) > 1) + 1)
        choices.append([(float(place[k][r[error[k][r].argmin()]]), float(error[k][r].min() ** 2)) for r in runs])
    best = [[(c[1], -1) for c in choices[0]]]
    for k in range(1, len(stops)):
        row = []
        for at, cost in choices[k]:
            options = [(best[k - 1][j][0] + cost, j) for j in range(len(choices[k - 1])) if choices[k - 1][j][0] <= at and best[k - 1][j][0] < math.inf]
            row.append(min(options) if options else (math.inf, -1))
        best.append(row)
    j = min(range(len(best[-1])), key=lambda i: best[-1][i][0])
    if best[-1][j][0] == math.inf:
        return None
    out = []
    for k in range(len(stops) - 1, -1, -1):
        out.append(choices[k][j][0])
        j = best[k][j][1]
    out = np.array(out[::-1])
    steps, apart = np.diff(out), np.hypot(*np.diff(stops, axis=0).T)
    return None if ((steps < 1) & (apart > 15)).any() else out


def map_match(patterns: DataFrame, key: str, tolerance: float = 35.0) -> DataFrame:
    """(key, distances) of patterns with plane `line` and `stops` arrays of struct(x, y); null where no match is sure."""

    def run(frames):
        for frame in frames:
            out = []
            for line, stops in zip(frame["line"], frame["stops"]):
                got = None
                if line is not None and stops is not None and len(line) > 1 and len(stops) > 1:
                    got = match_stops(np.array([(p["x"], p["y"]) for p in line]), np.array([(p["x"], p["y"]) for p in stops]), tolerance)
                out.append(None if got is None else got.tolist())
            yield pd.DataFrame({key: frame[key], "distances": out})

    return patterns.select(key, "line", "stops").mapInPandas(run, f"{key} {patterns.schema[key].dataType.simpleString()}, distances array<double>")
