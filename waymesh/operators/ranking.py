"""Ranks by preference, signature dedupe, top-k and place search."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.text import all_tokens

#: Order of the criteria by preference; fixed values.
PREFERENCES = {"fastest": ("arrival", "walk", "transfers"), "transfers": ("transfers", "arrival", "walk"), "walking": ("walk", "arrival", "transfers")}


def rank_key(preference: str, tie: str) -> Column:
    return F.struct(*PREFERENCES[preference], tie)


def ranked(rows: DataFrame, request: list[str], signature: str, preference: str, tie: str, most: int) -> DataFrame:
    """The best of each signature, then the first `most` of each request, with `rank` from 1.

    The dedupe is a minimum by (request, signature), which combines before the shuffle.
    """
    key = rank_key(preference, tie)
    best = rows.groupBy(*request, signature).agg(F.min(F.struct(key.alias("k"), F.struct(*[c for c in rows.columns if c not in (*request, signature)]).alias("r"))).alias("x"))
    flat = best.select(*request, signature, "x.k", "x.r.*")
    return flat.withColumn("rank", F.row_number().over(Window.partitionBy(*request).orderBy("k"))).where(F.col("rank") <= most).drop("k")


def itinerary_signature(legs: Column) -> Column:
    """Identity of a journey from its legs struct(mode, route_id, from_stop, to_stop, from_lat, from_lon, to_lat, to_lon, path, vessel).

    Mode, route (or MTR), end stops (else coordinates to five decimals), the railway path and the
    vessel count; the time of departure does not.
    """
    place = lambda stop, lat, lon: F.coalesce(stop, F.concat_ws(",", F.format_number(lat, 5), F.format_number(lon, 5)))
    one = lambda x: F.concat_ws("|", x["mode"], F.when(x["mode"] == "SUBWAY", "MTR").otherwise(x["route_id"]), place(x["from_stop"], x["from_lat"], x["from_lon"]), place(x["to_stop"], x["to_lat"], x["to_lon"]), x["path"], x["vessel"])
    return F.sha2(F.array_join(F.transform(legs, one), ";"), 256)


def split_journey(legs: Column, mode: str = "SUBWAY") -> Column:
    """Two neighbouring transit legs of one railway: a journey that should be one ride."""
    transit = F.filter(legs, lambda x: x["transit"])
    n = F.size(transit)
    pairs = F.zip_with(F.slice(transit, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(transit, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a["mode"] == mode) & (b["mode"] == mode))
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def stations_match(legs: Column, board: Column, alight: Column) -> Column:
    """First boarding and last alighting station are the expected ones."""
    transit = F.filter(legs, lambda x: x["transit"])
    return F.when(F.size(transit) > 0, (transit[0]["from_stop"] == board) & (F.element_at(transit, -1)["to_stop"] == alight)).otherwise(F.lit(False))


def search(places: DataFrame, query: str, name: str, tier: str, tie: str, most: int = 10) -> DataFrame:
    """Places that hold every token of the query: exact part, prefix, tier, shorter name; the first `most`.

    Queries under 2 or over 150 characters find nothing.
    """
    if not 2 <= len(query.strip()) <= 150:
        return places.limit(0)
    wanted = query.strip().lower()
    hits = places.where(all_tokens(F.col(name), F.lit(query)))
    exact = F.exists(F.split(F.lower(name), "·"), lambda p: F.trim(p) == wanted)
    prefix = F.startswith(F.lower(name), F.lit(wanted.split()[0]))
    return hits.orderBy(F.desc(exact), F.desc(prefix), F.col(tier), F.length(name), F.col(tie)).limit(most)
