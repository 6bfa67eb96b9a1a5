"""Half-open integer windows [a, b): union, gaps, intersection, point and overlap joins, lanes.

Range joins are equi joins on bins of time: a window is put in each bin it touches and a point
in its own, so no side is scanned for each row of the other; a pair is kept in one bin only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_windows(rows: DataFrame, key: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(key.., a, b): touching and overlapping windows as one; empty windows are dropped."""
    by = Window.partitionBy(*key).orderBy(a, b)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.where(F.col(a) < F.col(b)).withColumn("__end", F.max(b).over(before)).withColumn("__new", (F.col("__end").isNull() | (F.col(a) > F.col("__end"))).cast("int"))
    island = marked.withColumn("__i", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "__i").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("__i")


def complement(rows: DataFrame, key: list[str], low: Column, high: Column, a: str = "a", b: str = "b") -> DataFrame:
    """(key.., a, b): the parts of [low, high) that no window of the key covers; bounds may depend on the key."""
    islands = union_windows(rows.where((F.col(b) > low) & (F.col(a) < high)), key, a, b)
    by = Window.partitionBy(*key).orderBy(a)
    gaps = islands.select(*key, F.col(b).alias("__a"), F.lead(a).over(by).alias("__b"), F.first(a).over(by).alias("__f"), F.row_number().over(by).alias("__r"))
    inner = gaps.select(*key, F.col("__a").alias(a), F.least(F.coalesce("__b", high), high).alias(b))
    lead = gaps.where("__r = 1").select(*key, low.alias(a), F.least(F.col("__f"), high).alias(b))
    return inner.union(lead).where(F.col(a) < F.col(b))


def coalesce_bands(rows: DataFrame, key: list[str]) -> DataFrame:
    """Bands (start_s, end_s, low, high) of a key: equal ranges that touch or overlap are one.

    Bands of different ranges may touch; if they overlap, the whole key is rejected: its rows
    come back as they were with reason 'overlap'.
    """
    other = rows.select(*key, "start_s", "end_s", F.struct("low", "high").alias("r"))
    pairs = other.alias("x").join(other.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key] + [F.col("x.r") != F.col("y.r"), F.col("x.start_s") < F.col("y.end_s"), F.col("y.start_s") < F.col("x.end_s")], "left_semi")
    bad = pairs.select(*[F.col(k) for k in key]).distinct().withColumn("reason", F.lit("overlap"))
    good = union_windows(rows.join(bad, key, "left_anti"), [*key, "low", "high"], "start_s", "end_s").withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(rows.select(*key, "start_s", "end_s", "low", "high").join(bad, key))


def bins(a: Column, b: Column, size: int) -> Column:
    """Numbers of the bins that [a, b) touches."""
    return F.sequence(F.floor(a / size), F.floor((b - 1) / size))


def points_in_bands(points: DataFrame, bands: DataFrame, t: str, a: str, b: str, size: int, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points x bands with a <= t < b (and equal `on` columns)."""
    on = on or []
    p = points.withColumn("__bin", F.floor(F.col(t) / size))
    q = bands.where(F.col(a) < F.col(b)).withColumn("__bin", F.explode(bins(F.col(a), F.col(b), size)))
    q = q.select(*[F.col(c).alias(f"__{c}") for c in [*on, "__bin"]], *[c for c in bands.columns if c not in on])
    cond = (F.col("__bin") == F.col("____bin")) & (F.col(a) <= F.col(t)) & (F.col(t) < F.col(b))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    return p.join(q, cond, how).drop("__bin", "____bin", *[f"__{c}" for c in on])


def clock_bands(points: DataFrame, bands: DataFrame, t: str, a: str, b: str, size: int = 3600, on: list[str] | None = None) -> DataFrame:
    """points_in_bands with the clock tested as it is and one day later (bands past 24:00)."""
    both = points.withColumn("__t", F.explode(F.array(F.col(t), F.col(t) + 86_400)))
    return points_in_bands(both, bands, "__t", a, b, size, on).drop("__t")


def overlapping_pairs(rows: DataFrame, key: list[str], order: str, a: str, b: str, size: int) -> DataFrame:
    """Pairs (x, y of `order`, x < y) of one key whose windows overlap; a pair is made in the bin of its later start."""
    r = rows.where(F.col(a) < F.col(b)).select(*key, order, a, b).withColumn("__bin", F.explode(bins(F.col(a), F.col(b), size)))
    x, y = r.alias("x"), r.alias("y")
    cond = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*key, "__bin"]]
    cond += [F.col(f"x.{order}") < F.col(f"y.{order}"), F.col(f"x.{a}") < F.col(f"y.{b}"), F.col(f"y.{a}") < F.col(f"x.{b}"), F.floor(F.greatest(F.col(f"x.{a}"), F.col(f"y.{a}")) / size) == F.col("x.__bin")]
    return x.join(y, cond).select(*[F.col(f"x.{k}").alias(k) for k in key], F.col(f"x.{order}").alias(f"{order}_1"), F.col(f"y.{order}").alias(f"{order}_2"), F.greatest(f"x.{a}", f"y.{a}").alias(a), F.least(f"x.{b}", f"y.{b}").alias(b))


def intersect(left: DataFrame, right: DataFrame, key: list[str], size: int, a: str = "a", b: str = "b") -> DataFrame:
    """(key.., a, b): non-empty intersections of the windows of two relations."""
    spread = lambda d: d.where(F.col(a) < F.col(b)).select(*key, a, b).withColumn("__bin", F.explode(bins(F.col(a), F.col(b), size)))
    x, y = spread(left).alias("x"), spread(right).alias("y")
    low, high = F.greatest(F.col(f"x.{a}"), F.col(f"y.{a}")), F.least(F.col(f"x.{b}"), F.col(f"y.{b}"))
    cond = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*key, "__bin"]] + [low < high, F.floor(low / size) == F.col("x.__bin")]
    return x.join(y, cond).select(*[F.col(f"x.{k}").alias(k) for k in key], low.alias(a), high.alias(b))


def intersect_sections(sections: list[tuple[DataFrame, int]], key: list[str], size: int = 3600) -> DataFrame:
    """Availability of a whole journey: each section's windows, moved back by its offset, intersected in turn."""
    moved = [union_windows(d.select(*key, (F.col("a") - s).alias("a"), (F.col("b") - s).alias("b")), key) for d, s in sections]
    out = moved[0]
    for d in moved[1:]:
        out = intersect(out, d, key, size)
    return out


def lanes(rows: DataFrame, key: list[str], order: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Adds `lane`: first-fit in order of (a, b, order, other columns); a lane is free when its last window ends at or before a.

    First-fit depends on all earlier windows of the key, so a key is one array, folded inside the
    JVM; keys (a trip's bands, a worker's jobs) are bounded.
    """
    rest = [a, b, *order, *[c for c in rows.columns if c not in (*key, a, b, *order)]]
    end = rows.schema[b].dataType.simpleString()
    none = F.struct(F.array().cast(f"array<{end}>").alias("ends"), F.array().cast("array<int>").alias("lanes"))

    def placed(state: Column, x: Column) -> Column:
        free = F.array_position(F.transform(state["ends"], lambda e: e <= x[a]), F.lit(True)).cast("int")
        at = F.when(free > 0, free - 1).otherwise(F.size(state["ends"]))
        ends = F.when(free > 0, F.transform(state["ends"], lambda e, i: F.when(i == free - 1, x[b]).otherwise(e))).otherwise(F.array_append(state["ends"], x[b]))
        return F.struct(ends.alias("ends"), F.array_append(state["lanes"], at).alias("lanes"))

    one = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("__x"))
    told = one.withColumn("__l", F.aggregate("__x", none, placed, lambda s: s["lanes"]))
    zipped = F.zip_with("__x", "__l", lambda x, lane: F.struct(*[x[c].alias(c) for c in rest], lane.alias("lane")))
    return told.select(*key, F.inline(zipped)).select(*rows.columns, "lane")


def quarantine(records: DataFrame, key: list[str], record: str, size: int = 3600) -> DataFrame:
    """Adds `reason` to timetable records (kind frequency with [start_s, end_s), or departure at start_s).

    Mixed services, overlapping frequency bands, and departures listed inside a band are all
    rejected, both sides of a conflict; safe rows have a null reason. A record does not conflict with
    rows of its own name. A key's records are passed over once in each direction, sorted by
    start: what has begun before and ends latest, and what begins next, tell of any conflict, so no
    pairs are made and one shuffle by key is all. `size` is no longer used.
    """
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    band = F.coalesce(whole & F.col(record).isNotNull() & (F.col("kind") == "frequency") & (F.col("start_s") < F.col("end_s")), F.lit(False))
    listed = F.coalesce(whole & (F.col("kind") == "departure") & F.col("start_s").isNotNull(), F.lit(False))
    # at one second a band comes before a departure, which it then holds
    order = [F.col("start_s"), F.col("__p").cast("int"), F.col("end_s"), F.col(record)]
    by = Window.partitionBy(*key)
    before, after = (by.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (order, [c.desc() for c in order]))
    own = lambda name: F.col(f"{name}.{record}") == F.col(record)
    at = records.withColumns({"__f": band, "__p": listed})
    # the latest end so far and, for rows of the record that has it, the latest of any other record; likewise the next start
    at = at.withColumn("__l", F.max(F.when(F.col("__f"), F.struct("end_s", record))).over(before))
    at = at.withColumn("__l2", F.max(F.when(F.col("__f") & ~own("__l"), F.least("__l.end_s", "end_s"))).over(before))
    at = at.withColumns({"__n": F.min(F.when(F.col("__f"), F.struct("start_s", record))).over(after), "__d": F.min(F.when(F.col("__p"), F.col("start_s"))).over(after)})
    at = at.withColumn("__n2", F.min(F.when(F.col("__f") & ~own("__n"), F.greatest("__n.start_s", "start_s"))).over(after))
    earlier, later = F.when(own("__l"), F.col("__l2")).otherwise(F.col("__l.end_s")), F.when(own("__n"), F.col("__n2")).otherwise(F.col("__n.start_s"))
    overlaps = F.col("__f") & ((earlier > F.col("start_s")) | (later < F.col("end_s")))
    inside = (F.col("__p") & F.col(record).isNotNull() & (F.col("__l.end_s") > F.col("start_s"))) | (F.col("__f") & (F.col("__d") < F.col("end_s")))
    reason = F.when(F.col("mixed"), "mixed_service").when(overlaps, "overlapping_bands").when(inside, "departure_in_band")
    return at.withColumn("reason", reason).drop("__f", "__p", "__l", "__l2", "__n", "__n2", "__d")
