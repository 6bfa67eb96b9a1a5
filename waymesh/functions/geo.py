"""Distances, grid cells, polylines and plane geometry.

Scalar formulas are Column expressions. What needs a walk along a line (projection of a grid,
simplification, Hausdorff distance) is a numpy kernel for Arrow UDFs and grouped maps.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH = 6_371_000.0
#: Metres of one degree in the flat approximation.
DEGREE = 111_195.0
#: Service envelope (lat, lat, lon, lon).
ENVELOPE = (22.1, 22.6, 113.8, 114.5)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH) -> Column:
    """Great-circle metres."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    inner = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(inner)))


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres at the first point's latitude."""
    return F.hypot((lat2 - lat1) * DEGREE, (lon2 - lon1) * DEGREE * F.cos(F.radians(lat1)))


def flat_metres_mean(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres at the mean latitude on the sphere."""
    middle = F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH * F.hypot(F.radians(lat2 - lat1), F.radians(lon2 - lon1) * middle)


def cell(value: Column, size: float = 0.005) -> Column:
    return F.floor(value / size)


def round_ten(metres: Column) -> Column:
    """To 10 m, at least 10."""
    return F.greatest(F.lit(10), F.bround(metres / 10) * 10).cast("int")


def inside(lat: Column, lon: Column, box: tuple[float, float, float, float] = ENVELOPE) -> Column:
    """Finite and in the envelope; null or NaN is outside."""
    good = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(box[0], box[1]) & lon.between(box[2], box[3])
    return F.coalesce(good, F.lit(False))


def running_seconds(metres: Column) -> Column:
    """Estimated seconds between stops: detour 1.25 at 18 km/h plus 20 s, at least 45."""
    return F.greatest(F.lit(45), F.bround(metres * 1.25 / (18 / 3.6) + 20)).cast("int")


def edge_seconds(mode: Column, metres: Column, rise: Column) -> Column:
    """Indoor edge cost: walk 1.2, stairs 0.6, escalator 0.5 m/s; lift 1 m/s vertically plus 20 s; whole, at least 1."""
    speed = F.when(mode == "stairs", 0.6).when(mode == "escalator", 0.5).otherwise(1.2)
    raw = F.when(mode == "lift", F.abs(rise) / 1.0 + 20).otherwise(metres / speed)
    return F.greatest(F.lit(1), F.ceil(raw)).cast("int")


def without_lift_wait(mode: Column, seconds: Column) -> Column:
    """Pathway mode 5 is a lift: its 20 s wait is left out."""
    return F.when(mode == 5, F.greatest(F.lit(1), seconds - 20)).otherwise(seconds)


def speed_kmh(metres: Column, seconds: Column) -> Column:
    return metres / seconds * 3.6


def speed_ok(metres: Column, seconds: Column) -> Column:
    """1 to 100 km/h on hops of more than 100 m; shorter hops pass."""
    return (metres <= 100) | speed_kmh(metres, seconds).between(1, 100)


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(share 0..1 along the segment, distance to it)."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    share = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(F.lit(0.0))
    return F.struct(share.alias("share"), F.hypot(px - ax - share * dx, py - ay - share * dy).alias("distance"))


def level_index(z: Column, z0: Column, i0: Column, z1: Column, i1: Column) -> Column:
    """Floor index between two known floors; outside them three metres are one floor."""
    between = i0 + (i1 - i0) * (z - z0) / (z1 - z0)
    return F.when(z0.isNotNull() & z1.isNotNull() & (z1 != z0), between).when(z0.isNotNull(), i0 + (z - z0) / 3).when(z1.isNotNull(), i1 + (z - z1) / 3)


def round_vertex(lon: Column, lat: Column, z: Column) -> Column:
    return F.struct(F.bround(lon, 8).alias("lon"), F.bround(lat, 8).alias("lat"), F.bround(z, 3).alias("z"))


def decode_polyline(text: Column) -> Column:
    """array<struct<lat, lon>> of an encoded polyline (five decimals), as one fold over its characters.

    A text that ends inside a number or holds other characters gives an empty array.
    """
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 63)
    good = F.forall(chars, lambda v: v.between(0, 63)) & (F.size(chars) > 0) & (F.element_at(chars, -1) < 32)
    start = F.struct(F.lit(0).cast("bigint").alias("acc"), F.lit(0).alias("shift"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        total = s["acc"] + F.call_function("shiftleft", v.bitwiseAND(31).cast("bigint"), s["shift"])
        signed = F.when(total.bitwiseAND(1) == 1, -F.call_function("shiftright", total, F.lit(1)) - 1).otherwise(F.call_function("shiftright", total, F.lit(1)))
        more = v >= 32
        return F.struct(F.when(more, total).otherwise(F.lit(0)).cast("bigint").alias("acc"), F.when(more, s["shift"] + 5).otherwise(F.lit(0)).alias("shift"), F.when(more, s["out"]).otherwise(F.array_append(s["out"], signed)).alias("out"))

    deltas = F.aggregate(chars, start, step, lambda s: s["out"])
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(deltas) / 2).cast("int")), lambda i: F.struct(F.element_at(deltas, (i * 2 - 1).cast("int")).alias("dy"), F.element_at(deltas, (i * 2).cast("int")).alias("dx")))
    zero = F.struct(F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("x"), F.array().cast("array<struct<lat:double,lon:double>>").alias("out"))

    def add(s: Column, d: Column) -> Column:
        y, x = s["y"] + d["dy"], s["x"] + d["dx"]
        return F.struct(y.alias("y"), x.alias("x"), F.array_append(s["out"], F.struct((y / 1e5).alias("lat"), (x / 1e5).alias("lon"))).alias("out"))

    none = F.array().cast("array<struct<lat:double,lon:double>>")
    return F.when(good & (F.size(deltas) % 2 == 0) & (F.size(deltas) > 1), F.aggregate(pairs, zero, add, lambda s: s["out"])).otherwise(none)


def encode_polyline(points: list[tuple[float, float]]) -> str:
    out, last = [], (0, 0)
    for lat, lon in points:
        now = (round(lat * 1e5), round(lon * 1e5))
        for a, b in zip(now, last):
            v = (a - b) << 1
            v = ~v if a < b else v
            while v >= 32:
                out.append(chr((32 | v & 31) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


#: Transverse Mercator of the HK1980 grid (EPSG:2326): semi-major axis, 1/flattening, origin
#: latitude and longitude (degrees), scale, false northing and easting; fixed values.
HK80 = {"a": 6378388.0, "rf": 297.0, "lat0": 22.312133333333335, "lon0": 114.17855555555556, "k0": 1.0, "n0": 819069.80, "e0": 836694.05}
#: Shift of WGS84 to the HK80 datum in degrees (about -5.5" latitude, +8.8" longitude).
HK80_SHIFT = (-5.5 / 3600, 8.8 / 3600)


def _meridian(lat: np.ndarray, a: float, e2: float) -> np.ndarray:
    e4 = e2 * e2
    return a * ((1 - e2 / 4 - 3 * e4 / 64) * lat - 3 / 8 * (e2 + e4 / 4) * np.sin(2 * lat) + 15 / 256 * e4 * np.sin(4 * lat))


def to_grid(lat, lon) -> tuple[np.ndarray, np.ndarray]:
    """WGS84 degrees to HK1980 grid (northing, easting), to about a metre."""
    p = HK80
    e2 = 2 / p["rf"] - 1 / p["rf"] ** 2
    phi, lam = np.radians(np.asarray(lat, float) + HK80_SHIFT[0]), np.radians(np.asarray(lon, float) + HK80_SHIFT[1])
    phi0, lam0 = math.radians(p["lat0"]), math.radians(p["lon0"])
    nu = p["a"] / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    psi = nu / (p["a"] * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5)
    d = lam - lam0
    north = p["n0"] + p["k0"] * (_meridian(phi, p["a"], e2) - _meridian(np.asarray(phi0), p["a"], e2) + nu * np.sin(phi) * d**2 / 2 * np.cos(phi))
    east = p["e0"] + p["k0"] * (nu * d * np.cos(phi) + nu * d**3 / 6 * np.cos(phi) ** 3 * (psi - np.tan(phi) ** 2))
    return north, east


def from_grid(north, east, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """HK1980 grid to WGS84 degrees: to_grid() inverted by Newton steps on the sphere's scale."""
    north, east = np.asarray(north, float), np.asarray(east, float)
    lat, lon = np.full(north.shape, HK80["lat0"]), np.full(north.shape, HK80["lon0"])
    for _ in range(rounds):
        n, e = to_grid(lat, lon)
        lat = lat + (north - n) / 110_700.0
        lon = lon + (east - e) / (111_320.0 * np.cos(np.radians(lat)))
    return lat, lon


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def grid_to_wgs84(north: pd.Series, east: pd.Series) -> pd.DataFrame:
    lat, lon = from_grid(north.to_numpy(), east.to_numpy())
    return pd.DataFrame({"lat": lat, "lon": lon})


def along(line: np.ndarray) -> np.ndarray:
    """Cumulative length at each vertex."""
    return np.r_[0.0, np.cumsum(np.hypot(*np.diff(line, axis=0).T))] if len(line) else np.zeros(0)


def point_at(line: np.ndarray, at: float) -> np.ndarray:
    total = along(line)
    k = min(max(int(np.searchsorted(total, at, side="right")) - 1, 0), len(line) - 2)
    span = total[k + 1] - total[k]
    share = 0.0 if span == 0 else (at - total[k]) / span
    return line[k] + share * (line[k + 1] - line[k])


def cut_line(line: np.ndarray, start: float, end: float) -> np.ndarray:
    """The part of the line between two distances along it."""
    total = along(line)
    inner = line[(total > start) & (total < end)]
    return np.vstack([point_at(line, start), inner, point_at(line, end)])


def distances_to_line(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    a, d = line[:-1], np.diff(line, axis=0)
    length = np.maximum((d**2).sum(1), 1e-300)
    t = np.clip(((points[:, None, :] - a) * d).sum(-1) / length, 0, 1)
    near = a + t[..., None] * d
    return np.sqrt(((points[:, None, :] - near) ** 2).sum(-1)).min(1)


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Between the vertices of each line and the other line."""
    return float(max(distances_to_line(a, b).max(), distances_to_line(b, a).max()))


def geometry_conflict(a: np.ndarray, b: np.ndarray, apart: float = 60.0) -> bool:
    """Lines over `apart` metres from each other, or of lengths that differ by more than max(100 m, 20 %)."""
    la, lb = along(a)[-1], along(b)[-1]
    return hausdorff(a, b) > apart or abs(la - lb) > max(100.0, 0.2 * max(la, lb))


def simplify(line: np.ndarray, tolerance: float = 1.0) -> np.ndarray:
    """Douglas-Peucker, ends kept."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        off = distances_to_line(line[i + 1 : j], line[[i, j]])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[keep]


def join_parts(parts: list[np.ndarray]) -> np.ndarray | None:
    """One line from ordered parts that touch; else from parts that connect in just one path; else None."""
    if all(np.array_equal(a[-1], b[0]) for a, b in zip(parts, parts[1:])):
        return np.vstack([parts[0], *[p[1:] for p in parts[1:]]])
    ends: dict[tuple, list[int]] = {}
    for k, p in enumerate(parts):
        for q in (tuple(p[0]), tuple(p[-1])):
            ends.setdefault(q, []).append(k)
    loose = [q for q, own in ends.items() if len(own) == 1]
    if len(loose) != 2 or any(len(own) > 2 for own in ends.values()):
        return None
    at, left, out = loose[0], set(range(len(parts))), None
    while left:
        k = next((k for k in ends[at] if k in left), None)
        if k is None:
            return None
        p = parts[k] if tuple(parts[k][0]) == at else parts[k][::-1]
        out = p if out is None else np.vstack([out, p[1:]])
        at = tuple(p[-1])
        left.discard(k)
    return out
