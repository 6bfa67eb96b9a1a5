"""Readers and writers of evidence files: zipped CSV feeds, GeoJSON, XML catalogues, nested JSON.

Files of a feed are small members of one archive; big relations are Parquet snapshots. Every
reader takes an explicit schema, treats blanks as null, and fails closed on a broken shape.
"""
from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
#: Columns of the timetable relations; times stay text until clock.seconds().
SCHEMAS: dict[str, dict[str, T.DataType]] = {
    "agency": {"agency_id": _S, "agency_name": _S, "agency_url": _S, "agency_timezone": _S},
    "routes": {"route_id": _S, "agency_id": _S, "route_short_name": _S, "route_long_name": _S, "route_type": _I, "route_url": _S},
    "trips": {"route_id": _S, "service_id": _S, "trip_id": _S, "trip_headsign": _S, "direction_id": _S, "shape_id": _S},
    "stops": {"stop_id": _S, "stop_name": _S, "stop_lat": _D, "stop_lon": _D, "location_type": _I, "parent_station": _S, "platform_code": _S, "level_id": _S},
    "stop_times": {"trip_id": _S, "arrival_time": _S, "departure_time": _S, "stop_id": _S, "stop_sequence": _I, "pickup_type": _I, "drop_off_type": _I, "timepoint": _I, "shape_dist_traveled": _D},
    "calendar": {"service_id": _S, "monday": _I, "tuesday": _I, "wednesday": _I, "thursday": _I, "friday": _I, "saturday": _I, "sunday": _I, "start_date": _S, "end_date": _S},
    "calendar_dates": {"service_id": _S, "date": _S, "exception_type": _I},
    "frequencies": {"trip_id": _S, "start_time": _S, "end_time": _S, "headway_secs": _I, "exact_times": _I},
    "transfers": {"from_stop_id": _S, "to_stop_id": _S, "transfer_type": _I, "min_transfer_time": _I},
    "shapes": {"shape_id": _S, "shape_pt_lat": _D, "shape_pt_lon": _D, "shape_pt_sequence": _I, "shape_dist_traveled": _D},
    "levels": {"level_id": _S, "level_index": _D, "level_name": _S},
    "pathways": {"pathway_id": _S, "from_stop_id": _S, "to_stop_id": _S, "pathway_mode": _I, "is_bidirectional": _I, "length": _D, "traversal_time": _I},
}


def struct_of(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, k) for c, k in SCHEMAS[name].items()])


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.trim(c) != "", F.col(c)).alias(c) if isinstance(f.dataType, T.StringType) else F.col(c) for c, f in zip(df.columns, df.schema.fields)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row, any byte-order mark dropped; a row that breaks the schema fails the read."""
    return blank_to_null(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path))


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, text) of the .txt members of zip archives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    rows = [(name, m, z.read(m).decode("utf-8-sig")) for m in z.namelist() if m.endswith(".txt")]
                yield pd.DataFrame(rows, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def read_member(spark: SparkSession, path: str, name: str, open_schema: bool = False) -> DataFrame:
    """Table `name` of a zipped feed; a missing member is an empty relation.

    Declared columns are typed (a wrong number is an error); with open_schema, columns that are
    not declared come along as `extra` map<string,string>.
    """
    fields = SCHEMAS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                out = {c: [] for c in fields}
                extra = []
                for row in csv.DictReader(io.StringIO(text)):
                    for c, k in fields.items():
                        v = (row.get(c) or "").strip()
                        out[c].append(None if v == "" else int(v) if isinstance(k, T.IntegerType) else float(v) if isinstance(k, T.DoubleType) else v)
                    extra.append({c: v for c, v in row.items() if c not in fields and v})
                got = pd.DataFrame(out)
                for c, k in fields.items():
                    if isinstance(k, T.IntegerType):
                        got[c] = got[c].astype("Int32")
                if open_schema:
                    got["extra"] = extra
                yield got

    schema = struct_of(name)
    if open_schema:
        schema = schema.add("extra", T.MapType(_S, _S))
    return members(spark, path).where(F.col("member") == f"{name}.txt").select("text").mapInPandas(run, schema)


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: read_member(spark, path, name) for name in SCHEMAS}


def surface_only(tables: dict[str, DataFrame], types: list[int]) -> dict[str, DataFrame]:
    """routes of the types, their trips, stop times, frequencies and stops: a chain of semi joins."""
    routes = tables["routes"].where(F.col("route_type").isin(types))
    trips = tables["trips"].join(routes.select("route_id"), "route_id", "left_semi")
    times = tables["stop_times"].join(trips.select("trip_id"), "trip_id", "left_semi")
    out = {**tables, "routes": routes, "trips": trips, "stop_times": times, "stops": tables["stops"].join(times.select("stop_id").distinct(), "stop_id", "left_semi")}
    if "frequencies" in tables:
        out["frequencies"] = tables["frequencies"].join(trips.select("trip_id"), "trip_id", "left_semi")
    return out


def mode_group(route_type: Column, agency: Column) -> Column:
    """Search mode of a route; trams and light rail share a type and are told apart by operator."""
    light = F.coalesce(agency.rlike(r"(?i)^(LR|LRT|MTR)"), F.lit(False))
    return F.when(route_type == 0, F.when(light, "LIGHT_RAIL").otherwise("TRAM")).when(route_type.isin(1, 2), "RAIL").when(route_type.isin(3, 11), "BUS").when(route_type == 4, "FERRY").when(route_type == 7, "FUNICULAR").otherwise("OTHER")


def csv_text(rows: pd.DataFrame) -> str:
    out = io.StringIO()
    rows.to_csv(out, index=False, lineterminator="\r\n")
    return out.getvalue()


def write_feed(tables: dict[str, DataFrame], path: str) -> None:
    """Export a feed as one zip file on the driver's disk, for exchange; snapshots are Parquet."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, frame in tables.items():
            with z.open(f"{name}.txt", "w") as member:
                text = io.TextIOWrapper(member, "utf-8", newline="")
                writer = csv.writer(text, lineterminator="\r\n")
                writer.writerow(frame.columns)
                for row in frame.toLocalIterator():
                    writer.writerow(["" if v is None else v for v in row])
                text.flush()


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """All rows; the header is the union of columns in first-seen order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


_FEATURE = "type string, totalFeatures bigint, numberMatched bigint, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, kind, coordinates JSON) of GeoJSON files; a file with fewer features than it states fails."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _FEATURE, {"mode": "FAILFAST"}).alias("f"))
    stated = F.coalesce("f.totalFeatures", "f.numberMatched")
    whole = raw.withColumn("f", F.when(stated.isNull() | (stated == F.size("f.features")), F.col("f")).otherwise(F.raise_error(F.lit("truncated feature collection")).cast(raw.schema["f"].dataType)))
    return whole.select(F.explode("f.features").alias("x")).select(F.col("x.properties").alias("properties"), F.col("x.geometry.type").alias("kind"), F.col("x.geometry.coordinates").alias("coordinates"))


def line_of(coordinates: Column) -> Column:
    """LineString coordinates JSON to array<struct<lon, lat, z>>."""
    points = F.from_json(coordinates, "array<array<double>>")
    return F.transform(points, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), F.try_element_at(p, F.lit(3)).alias("z")))


#: Fields of the published route catalogue; fixed values.
XML_FIELDS = ["ROUTE_ID", "COMPANY_CODE", "ROUTE_NAMEC", "ROUTE_NAMEE", "JOURNEY_TIME", "FULL_FARE"]


def xml_routes(spark: SparkSession, texts: DataFrame, column: str, row: str = "ROUTE") -> DataFrame:
    """(route_id, company, name_c, name_e, journey_time, fare) of catalogue documents.

    Documents with a DTD or an entity declaration, or rows with a field that is not in the
    whitelist, are refused with a reason.
    """
    text = F.col(column)
    unsafe = text.rlike(r"(?i)<!DOCTYPE|<!ENTITY")
    rows = texts.select(F.when(~unsafe, F.regexp_extract_all(text, F.lit(rf"(?s)<{row}>(.*?)</{row}>"), F.lit(1))).alias("r"), unsafe.alias("unsafe"))
    one = rows.select("unsafe", F.explode_outer("r").alias("x"))
    names = F.regexp_extract_all("x", F.lit(r"<([A-Za-z_]+)>"), F.lit(1))
    extra = F.size(F.array_except(names, F.array(*[F.lit(f) for f in XML_FIELDS]))) > 0
    value = lambda f: F.nullif(F.regexp_extract("x", rf"(?s)<{f}>(.*?)</{f}>", 1), F.lit(""))
    reason = F.when(F.col("unsafe"), "declaration").when(extra, "unknown_field").when(value("ROUTE_ID").isNull(), "no_route_id")
    return one.select(value("ROUTE_ID").alias("route_id"), value("COMPANY_CODE").alias("company"), value("ROUTE_NAMEC").alias("name_c"), value("ROUTE_NAMEE").alias("name_e"), value("JOURNEY_TIME").try_cast("double").alias("journey_time"), value("FULL_FARE").try_cast("double").alias("fare"), reason.alias("reason"))


def ical_holidays(spark: SparkSession, texts: DataFrame, column: str) -> DataFrame:
    """(date, name) of calendars in JSON: {vcalendar: [{vevent: [{dtstart: [yyyyMMdd, ..], summary}]}]}."""
    schema = "vcalendar array<struct<vevent:array<struct<dtstart:array<string>,summary:string>>>>"
    events = texts.select(F.explode(F.from_json(column, schema)["vcalendar"]).alias("c")).select(F.explode("c.vevent").alias("e"))
    return events.select(F.to_date(F.col("e.dtstart")[0], "yyyyMMdd").alias("date"), F.col("e.summary").alias("name")).where("date is not null").distinct()


def history_pairs(texts: DataFrame, column: str, low: float = 5, high: float = 3960) -> DataFrame:
    """(origin, destination, seconds, reason) of nested maps origin -> destination -> seconds."""
    pairs = texts.select(F.explode(F.from_json(column, "map<string,map<string,double>>")).alias("origin", "m")).select("origin", F.explode("m").alias("destination", "seconds"))
    s = F.col("seconds")
    reason = F.when(s.isNull(), "missing").when(F.isnan(s) | (F.abs(s) == float("inf")), "not_finite").when(F.col("origin") == F.col("destination"), "self_pair").when(~s.between(low, high), "out_of_range")
    return pairs.withColumn("reason", reason)


def hour_partition(spark: SparkSession, path: str, day: int, hour: int) -> DataFrame:
    """One (day, hour) of a table partitioned by both: only its files are read."""
    return spark.read.parquet(path).where((F.col("day") == day) & (F.col("hour") == hour))


def ferry_departures(rows: DataFrame) -> DataFrame:
    """(route, direction, day_rule, departure_s, remark, excluded): 12-hour clocks with remark rules.

    '*' leaves out Sundays and holidays, '#' runs on Saturdays only; an unread clock is an error row.
    """
    from waymesh.functions.clock import twelve_hour

    mark = F.regexp_extract("time", r"([*#]+)\s*$", 1)
    at = twelve_hour(F.regexp_replace("time", r"[*#\s]+$", ""))
    return rows.select("route", "direction", "day_rule", at.alias("departure_s"), F.nullif(mark, F.lit("")).alias("remark"), F.when(mark == "*", "sundays_and_holidays").when(mark == "#", "all_but_saturdays").alias("excluded"), F.when(at.isNull(), "unread_clock").alias("reason"))


def third_party_patterns(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """(key, operator, route, direction, service_type, stops array<struct>) from a route database.

    routes: (key, route, co array, bound map, service_type, stops map operator -> array of stop
    ids); stops: (stop_id, name, lat, lon). A stop that is not in the list makes the pattern unusable.
    """
    flat = routes.select("key", "route", "bound", "service_type", F.explode("stops").alias("operator", "ids")).select("*", F.posexplode("ids").alias("i", "stop_id"))
    got = flat.join(stops, "stop_id", "left")
    return got.groupBy("key", "operator", "route", F.try_element_at("bound", F.col("operator")).alias("direction"), "service_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "stop_id", "name", "lat", "lon"))), lambda x: F.struct(x["stop_id"].alias("stop_id"), x["name"].alias("name"), x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("stops"),
        F.bool_and(F.col("lat").isNotNull()).alias("usable"),
    )


def official_patterns(records: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, rejects) of operator records (operator, route, direction, service_type, seq, stop_id).

    seq must be exactly 1..n with n >= 2 and every stop must have coordinates in the envelope.
    """
    from waymesh.functions.geo import inside

    got = records.join(stops, ["operator", "stop_id"], "left").withColumn("ok", F.coalesce(inside(F.col("lat"), F.col("lon")), F.lit(False)))
    key = ["operator", "route", "direction", "service_type"]
    p = got.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "lat", "lon"))), lambda x: F.struct(x["stop_id"].alias("native_stop_id"), x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("stops"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n"), F.count_distinct("seq").alias("k"), F.bool_and("ok").alias("ok"))
    reason = F.when(F.col("n") < 2, "too_short").when((F.col("a") != 1) | (F.col("b") != F.col("n")) | (F.col("k") != F.col("n")), "sequence").when(~F.col("ok"), "coordinates")
    judged = p.withColumn("reason", reason)
    return judged.where("reason is null").select(*key, "stops"), judged.where("reason is not null").select(*key, "reason")


def osm_station_points(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(osm_id, name, lat, lon): tagged nodes, and ways as the mean of their vertices.

    nodes: (node_id, lat, lon, tags map); ways: (way_id, tags map, refs array of node ids).
    """
    wanted = F.coalesce(F.try_element_at("tags", F.lit("railway")).isin("station", "halt", "subway_entrance"), F.lit(False))
    name = F.coalesce(F.try_element_at("tags", F.lit("name:en")), F.try_element_at("tags", F.lit("name")))
    points = nodes.where(wanted).select(F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("osm_id"), name.alias("name"), "lat", "lon")
    vertex = ways.where(wanted).select("way_id", name.alias("name"), F.explode("refs").alias("node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    return points.unionByName(vertex.groupBy("way_id", "name").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).select(F.concat(F.lit("w"), F.col("way_id").cast("string")).alias("osm_id"), "name", "lat", "lon"))
