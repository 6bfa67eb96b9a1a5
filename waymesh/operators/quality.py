"""Constraint queries that return violations, and preservation checks between snapshots.

An empty result is a pass. Every check is a relation of its own, so it can be written, counted,
or turned into a failure by `require`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators.routing import cut


def number_ok(value: Column, low: float, high: float) -> Column:
    """Finite and in range; null, NaN and infinity are not."""
    return F.coalesce(~F.isnan(value) & value.between(low, high), F.lit(False))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(child_key) == F.col("__p"), "left_anti")


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def broken_sequences(rows: DataFrame, group: str, number: str, first: int = 1) -> DataFrame:
    """Groups whose numbers are not exactly first, first + 1, ...: counts decide, nothing is gathered."""
    g = rows.groupBy(group).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n"), F.count_distinct(number).alias("k"))
    return g.where((F.col("low") != first) | (F.col("high") != first + F.col("n") - 1) | (F.col("k") != F.col("n")))


def decreasing(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before"))


def invalid_frequencies(rows: DataFrame) -> DataFrame:
    """Bands with no width or no headway, or unknown exactness."""
    return rows.where("not (start_s < end_s and headway_secs > 0 and exact_times in (0, 1)) or start_s is null or end_s is null or headway_secs is null")


def report(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, n) of each check's violations."""
    out = None
    for rule, frame in checks:
        row = frame.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = row if out is None else out.union(row)
    return out


def require(counts: DataFrame) -> DataFrame:
    """Fails the plan if any rule of report() has violations."""
    return counts.withColumn("n", F.when(F.col("n") == 0, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("violated: "), F.col("rule"))).cast("bigint")))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(n, a, b): order-independent digest of all rows; equal tables have equal digests."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rows.columns]
    h = rows.select(F.xxhash64(*key).alias("h"), F.xxhash64(F.lit(1), *key).alias("g"))
    return h.agg(F.count("*").alias("n"), F.sum(F.pmod("h", F.lit(1_000_000_007))).alias("a"), F.bit_xor("g").alias("b"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(n, same): whether two tables hold the same rows with the same multiplicities, whatever their order."""
    a, b = fingerprint(left), fingerprint(right.select(*left.columns)).toDF("n2", "a2", "b2")
    return a.crossJoin(b).select("n", ((F.col("n") == F.col("n2")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2"))).alias("same"))


def preservation(old: DataFrame, new: DataFrame, key: list[str], values: list[str], approved: Column) -> DataFrame:
    """(rule, n): rows lost, added, changed, and changed without approval, matched on the key.

    Rows that share a key are numbered by their values, so repeated rows match one to one.
    """
    w = Window.partitionBy(*key).orderBy(*values)
    a = old.select(*key, F.row_number().over(w).alias("__k"), F.struct(*values).alias("__a"))
    b = new.select(*key, F.row_number().over(w).alias("__k"), F.struct(*values).alias("__b"))
    both = a.join(b, [*key, "__k"], "full_outer").select(*key, "__a", "__b")
    changed = F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b"))
    counts = both.agg(F.count_if(changed).alias("changed_rows"), F.count_if(F.col("__b").isNull()).alias("lost_rows"), F.count_if(F.col("__a").isNull()).alias("added_rows"), F.count_if(changed & ~approved).alias("unapproved"))
    return counts.unpivot([], ["changed_rows", "lost_rows", "added_rows", "unapproved"], "rule", "n")


def filled_only(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows whose supplied (non-null) values differ in the new snapshot: fills are fine, changes are not."""
    b = new.select(*key, *[F.col(v).alias(f"__{v}") for v in values])
    bad = None
    for v in values:
        c = F.col(v).isNotNull() & ~F.col(v).eqNullSafe(F.col(f"__{v}"))
        bad = c if bad is None else bad | c
    return old.join(b, key).where(bad)


def unreachable(platforms: DataFrame, entrances: DataFrame, edges: DataFrame) -> DataFrame:
    """Platforms without an entrance that has a way both to them and from them, by frontier expansion.

    edges: directed (a, b). Each entrance has reached sets of its own, so that both ways are of
    one entrance; a loop ends when no node is new to its entrance.
    """

    def closure(arcs: DataFrame) -> DataFrame:
        seen = front = entrances.select(F.col("node").alias("entrance"), "node").distinct().persist()
        fronts, grown = [], [seen]
        while True:
            # only new nodes go on; each level is kept, so that no level is computed again
            front = front.join(arcs, front["node"] == arcs["a"]).select("entrance", F.col("b").alias("node")).distinct().join(seen, ["entrance", "node"], "left_anti").persist()
            fronts.append(front)
            if front.isEmpty():
                break
            grown.append(seen.union(front).persist())
            seen = cut(grown[-1])
        for level in fronts + grown[:-1]:
            level.unpersist()
        return seen

    good = closure(edges).intersect(closure(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return platforms.join(good.select("node").distinct(), "node", "left_anti")
