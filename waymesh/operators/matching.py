"""Joins that must be certain: unique-or-reject, tiers with veto, sequences, bijections.

Every operator keeps its rejects: an ambiguous or missing partner is a row with a reason, never
a best guess.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions import geo
from waymesh.functions.structs import overlaps


def keep_matching(rows: DataFrame, other: DataFrame, on) -> DataFrame:
    return rows.join(other, on, "left_semi")


def semi_cascade(frames: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Chain of semi joins: each (frame, own key, key in the frame before) keeps what the one before kept."""
    out = [frames[0][0]]
    for frame, own, before in frames[1:]:
        keys = out[-1].select(F.col(before).alias("__k"))
        out.append(frame.join(keys, F.col(own) == F.col("__k"), "left_semi"))
    return out


def retain_and_append(base: DataFrame, replaced: DataFrame, new: DataFrame, on) -> DataFrame:
    """base without the replaced keys, plus the new rows; columns are united."""
    return base.join(replaced, on, "left_anti").unionByName(new, allowMissingColumns=True)


def violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(child_key) == F.col("__p"), "left_anti")


def unique_or_reject(left: DataFrame, candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key.., n_candidates, value, reason): value only where just one distinct candidate exists.

    Candidates are reduced with a partial aggregate before the join, so a key with very many
    candidates moves one row a task.
    """
    summary = candidates.groupBy(key).agg(F.count_distinct(value).alias("n_candidates"), F.min(value).alias("__one"))
    got = left.join(summary, key, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    n = F.col("n_candidates")
    return got.withColumns({value: F.when(n == 1, F.col("__one")), "reason": F.when(n == 1, F.lit(None)).when(n == 0, "no_candidate").otherwise("ambiguous").cast("string")}).drop("__one")


def tiers(keys: DataFrame, official: DataFrame, fallback: DataFrame, inventory: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, tier): the official value, else the fallback unless the key is in the official inventory."""
    a = official.groupBy(key).agg(F.min(value).alias("__a"))
    b = fallback.groupBy(key).agg(F.min(value).alias("__b"))
    listed = inventory.select(key).distinct().withColumn("__in", F.lit(True))
    got = keys.join(a, key, "left").join(b, key, "left").join(listed, key, "left")
    blocked = F.coalesce("__in", F.lit(False))
    return got.select(
        *keys.columns,
        F.coalesce("__a", F.when(~blocked, F.col("__b"))).alias(value),
        F.when(F.col("__a").isNotNull(), "official").when(blocked, "blocked_by_official").when(F.col("__b").isNotNull(), "fallback").otherwise("none").alias("tier"),
    )


def sequence_matches(left: DataFrame, right: DataFrame, items: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs of equal ordered arrays: joined on the array itself, so only equal lengths and places meet."""
    r = right.select(F.col(right_id).alias("match_id"), F.col(items).alias("__seq"))
    return left.join(r, F.col(items) == F.col("__seq")).drop("__seq")


def stops_agree(a: Column, b: Column) -> Column:
    """The guards of a full stop sequence match on arrays of struct(lat, lon, name).

    Equal length of two or more; each place within 50 m, or 100 m with the same name; mean within
    20 m, or 30 m if every place beyond 20 m has the same name.
    """
    pairs = F.zip_with(a, b, lambda x, y: F.struct(geo.haversine(x["lat"], x["lon"], y["lat"], y["lon"]).alias("d"), F.coalesce(x["name"] == y["name"], F.lit(False)).alias("same")))
    each = F.forall(pairs, lambda p: (p["d"] <= 50) | (p["same"] & (p["d"] <= 100)))
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["d"]) / F.size(pairs)
    far_named = F.forall(pairs, lambda p: (p["d"] <= 20) | p["same"])
    return F.when((F.size(a) == F.size(b)) & (F.size(a) >= 2), each & ((mean <= 20) | ((mean <= 30) & far_named))).otherwise(F.lit(False))


def stitched_circles(closed: DataFrame, halves: DataFrame, key: str, stops: str) -> DataFrame:
    """(key, overlap): closed patterns that two directions O and I make with just one overlap.

    halves: (key, direction, stops). Both orders are tried; the first half's start must be the
    second's end, exactly one overlap size n >= 2 may exist, and the visits must add up.
    """
    two = halves.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("direction").alias("d")).where("n = 2 and d = 2").select(key)
    part = halves.join(two, key, "left_semi")
    first = part.select(key, F.col("direction").alias("d1"), F.col(stops).alias("s1"))
    second = part.select(F.col(key).alias("__k"), F.col("direction").alias("d2"), F.col(stops).alias("s2"))
    pair = first.join(second, (F.col(key) == F.col("__k")) & (F.col("d1") != F.col("d2")) & (F.col("s1")[0] == F.element_at("s2", -1)))
    pair = pair.withColumn("fit", overlaps(F.col("s1"), F.col("s2"))).where(F.size("fit") == 1).withColumn("overlap", F.col("fit")[0])
    whole = closed.where((F.col(stops)[0] == F.element_at(F.col(stops), -1))).select(F.col(key).alias("__c"), F.size(stops).alias("visits"))
    made = pair.join(whole, F.col(key) == F.col("__c")).where(F.size("s1") + F.size("s2") - F.col("overlap") == F.col("visits"))
    return made.groupBy(key).agg(F.count("*").alias("orders"), F.min("overlap").alias("overlap"))


def unordered(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


def bijective(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose both sides have just this partner."""
    one_left = pairs.groupBy(left).agg(F.count_distinct(right).alias("__n")).where("__n = 1").select(left)
    one_right = pairs.groupBy(right).agg(F.count_distinct(left).alias("__n")).where("__n = 1").select(right)
    return pairs.select(left, right).distinct().join(one_left, left, "left_semi").join(one_right, right, "left_semi")


def prefix_deltas(paths: DataFrame, path: str, total: str, group: list[str]) -> DataFrame:
    """Paths with the total of their exact prefix (one item less) in the same group: `delta`."""
    short = paths.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(path).alias("__path"), F.col(total).alias("__total"))
    on = F.slice(path, F.lit(1), F.size(path) - 1) == F.col("__path")
    for g in group:
        on = on & (F.col(g) == F.col(f"__{g}"))
    return paths.where(F.size(path) > 1).join(short, on).withColumn("delta", F.col(total) - F.col("__total")).select(*paths.columns, "delta")


def ordered_pairs(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """All i < j of each group as columns of struct a and b; groups are gathered as arrays.

    For bounded groups (the stops of a trip); the pairs are made in the row, without a self join.
    """
    other = [c for c in rows.columns if c not in group]
    items = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in other if c != order]))).alias("__s"))
    first = items.select(*group, "__s", F.posexplode("__s").alias("__i", "a"))
    return first.select(*group, "a", F.explode(F.slice("__s", F.col("__i") + 2, F.size("__s"))).alias("b"))


def routes_between(trips: DataFrame, wanted: DataFrame, stops: str) -> DataFrame:
    """wanted (origin, destination) inside ordered stop arrays: the sub-path, only if all templates agree."""
    at = lambda c: F.array_position(F.col(stops), F.col(c))
    inside = wanted.join(trips, F.array_contains(F.col(stops), F.col("origin")) & F.array_contains(F.col(stops), F.col("destination")))
    path = inside.where(at("origin") < at("destination")).withColumn("path", F.slice(stops, at("origin").cast("int"), (at("destination") - at("origin") + 1).cast("int")))
    return path.groupBy("origin", "destination").agg(F.count_distinct("path").alias("n_paths"), F.min("path").alias("__p")).withColumn("path", F.when(F.col("n_paths") == 1, F.col("__p"))).drop("__p")


def join_shifted(a: Column, b: Column) -> Column:
    """Paths of struct(stop, t) joined at their shared stop; b's clock goes on from a's end."""
    last = F.element_at(a, -1)
    shift = last["t"] - b[0]["t"]
    return F.when(last["stop"] == b[0]["stop"], F.concat(a, F.transform(F.slice(b, F.lit(2), F.size(b)), lambda x: F.struct(x["stop"].alias("stop"), (x["t"] + shift).alias("t")))))


def full_outer_diff(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key.., status): left_only, right_only, conflicting or equal, null-safe."""
    a = left.select(*key, F.struct(*values).alias("__a"), F.lit(True).alias("__in_a"))
    b = right.select(*key, F.struct(*values).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, key, "full_outer")
    return both.select(*key, F.when(F.col("__in_b").isNull(), "left_only").when(F.col("__in_a").isNull(), "right_only").when(F.col("__a").eqNullSafe(F.col("__b")), "equal").otherwise("conflicting").alias("status"))


def tiered_choice(rows: DataFrame, group: list[str], tier_columns: list[str]) -> DataFrame:
    """The one row of a group with the least tier tuple; a group with two such rows has none (reason)."""
    tier = F.struct(*tier_columns)
    best = rows.groupBy(*group).agg(F.min(tier).alias("__best"))
    top = rows.join(best, group).where(tier == F.col("__best")).drop("__best")
    count = Window.partitionBy(*group)
    ranked = top.withColumn("__n", F.count("*").over(count))
    return ranked.withColumn("reason", F.when(F.col("__n") > 1, "tie")).drop("__n")


def unanimous(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key.., value, n): the value on which all non-null observations agree, else null."""
    got = rows.groupBy(*key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("__v"))
    return got.select(*key, F.when(F.col("n") == 1, F.col("__v")).alias(value), "n")
