"""Which timetable page speaks of which route: evidence, pruning, and what follows from unique matches.

Pages and candidate routes are the two sides of a graph. Edges go when region or stop sequence
contradict them; tiers of evidence stand on those left. A page with one candidate and evidence is
identified, and mutually unique if no other page wants its route. `settled` goes on from there: a
route that is taken leaves all other pages, which may leave these with one candidate, and so on
until nothing changes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.operators.routing import cut

#: Evidence of an edge, the best first.
TIERS = ("official_link", "exact_terminals", "stop_sequence")


def integrity(pages: DataFrame, raw: DataFrame) -> DataFrame:
    """(title, reason) of pages whose normalised copy does not match what was fetched.

    pages: (title, page_id, revision, state, text); raw: (title, page_id, revision, text, source).
    """
    r = raw.select("title", F.col("page_id").alias("__p"), F.col("revision").cast("string").alias("__v"), F.col("text").alias("__t"), F.col("source").alias("__s"))
    met = pages.join(r, "title", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(F.col("__p").isNull(), "not_fetched").when(~F.coalesce(F.col("state") == "done", F.lit(False)), "not_done").when(~F.col("page_id").eqNullSafe(F.col("__p")), "other_page")
        .when(~F.col("revision").cast("string").eqNullSafe(F.col("__v")), "other_revision").when(blank("text") | blank("__t") | blank("__s"), "empty")
    )
    return met.select("title", reason.alias("reason")).where("reason IS NOT NULL")


def evidence(pages: DataFrame, candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """Edges (title, route_id, pruned, tier): what contradicts an edge and the best evidence for it.

    pages: (title, region, links array<string>, terminals array<string>, stops array<string>), null
    region and empty arrays where a page says nothing; candidates: (title, route_id); routes, a row
    for each direction: (route_id, district, origin, destination, stops array<string>).

    An edge is pruned for `region` when the page names one and the route has districts but not
    this one, and for `sequence` when both have stops and the page's are not, in order, among those
    of some direction. Terminals agree when they are two and the same set as a direction's ends.
    """
    pair = lambda a, b: F.array_sort(F.array(a, b))
    edges = candidates.select("title", "route_id").distinct()
    met = edges.join(pages, "title").join(routes.withColumnRenamed("stops", "__stops"), "route_id", "left")
    ends = F.coalesce(F.size("terminals") == 2, F.lit(False)) & (F.array_sort(F.array_distinct("terminals")) == F.array_distinct(pair(F.col("origin"), F.col("destination"))))
    # the page's stops in order: each is found behind the one before
    follows = F.aggregate(F.coalesce("stops", F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda at, s: F.when(at < 0, at).otherwise(_next_place(F.col("__stops"), s, at)))
    has_both = (F.size("stops") > 0) & (F.size("__stops") > 0)
    per = met.groupBy("title", "route_id").agg(
        F.bool_or(F.col("district").isNotNull()).alias("districts"), F.bool_or(F.col("district").eqNullSafe(F.col("region"))).alias("own_district"), F.first("region").alias("region"),
        F.bool_or(F.coalesce(ends, F.lit(False))).alias("ends"), F.bool_or(F.coalesce(has_both, F.lit(False))).alias("both"), F.bool_or(F.coalesce(has_both & (follows >= 0), F.lit(False))).alias("follows"),
        F.bool_or(F.coalesce(F.array_contains("links", F.col("route_id")), F.lit(False))).alias("link"),
    )
    pruned = F.when(F.col("region").isNotNull() & F.col("districts") & ~F.col("own_district"), "region").when(F.col("both") & ~F.col("follows"), "sequence")
    tier = F.when(F.col("link"), TIERS[0]).when(F.col("ends"), TIERS[1]).when(F.col("follows"), TIERS[2])
    return per.select("title", "route_id", pruned.alias("pruned"), F.when(pruned.isNull(), tier).alias("tier"))


def _next_place(stops: Column, wanted: Column, after: Column) -> Column:
    """The place of wanted in stops behind place `after` (from 1 on), or -1."""
    rest = F.slice(stops, (after + 1).cast("int"), F.greatest(F.size(stops) - after, F.lit(0)).cast("int"))
    at = F.array_position(rest, wanted)
    return F.when(at > 0, after + at).otherwise(F.lit(-1).cast("bigint"))


def audit(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(title, candidates, left, supported, status, route_id, mutual) of every page, by edges of evidence().

    status: no_operator_number_candidate, all_candidates_conflict, single_candidate_with_identity_evidence,
    single_candidate_still_needs_identity_evidence, multiple_variants_or_unresolved. route_id is that
    of a single candidate. mutual: supported, and no other page has this route left.
    """
    open_ = edges.where("pruned IS NULL")
    rivals = open_.groupBy("route_id").agg(F.count_distinct("title").alias("__wanted"))
    per = edges.join(rivals, "route_id", "left").groupBy("title").agg(
        F.count("*").alias("candidates"), F.sum(F.col("pruned").isNull().cast("bigint")).alias("left"), F.sum((F.col("pruned").isNull() & F.col("tier").isin(*TIERS[:2])).cast("bigint")).alias("supported"),
        F.min(F.when(F.col("pruned").isNull(), F.struct("route_id", "__wanted"))).alias("x"),
    )
    got = pages.select("title").distinct().join(per, "title", "left").select("title", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("candidates", "left", "supported")], "x")
    one = F.col("left") == 1
    status = (
        F.when(F.col("candidates") == 0, "no_operator_number_candidate").when(F.col("left") == 0, "all_candidates_conflict").when(one & (F.col("supported") > 0), "single_candidate_with_identity_evidence")
        .when(one, "single_candidate_still_needs_identity_evidence").otherwise("multiple_variants_or_unresolved")
    )
    mutual = F.coalesce(one & (F.col("supported") > 0) & (F.col("x.__wanted") == 1), F.lit(False))
    return got.select("title", "candidates", "left", "supported", status.alias("status"), F.when(one, F.col("x.route_id")).alias("route_id"), mutual.alias("mutual"))


def settled(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(title, route_id, round) that unique matches force, to the fixpoint.

    A page with one candidate left and evidence for it takes its route, unless another page takes
    the same in that round: then neither does, and the route stays open to both. A taken route
    leaves the other pages. Rounds are as many as the longest chain of such consequences; each
    is one aggregate by page and one by route over the edges still open.
    """
    open_ = cut(edges.where("pruned IS NULL").select("title", "route_id", "tier").distinct())
    taken, k = None, 0
    while most_rounds is None or k < most_rounds:
        k += 1
        single = open_.groupBy("title").agg(F.count("*").alias("n"), F.min("route_id").alias("route_id"), F.min("tier").alias("tier")).where("n = 1 AND tier IS NOT NULL")
        alone = single.groupBy("route_id").agg(F.count("*").alias("n"), F.min("title").alias("title")).where("n = 1").select("title", "route_id")
        new = cut(alone.withColumn("round", F.lit(k)))
        if new.isEmpty():
            break
        taken = new if taken is None else cut(taken.unionByName(new))
        open_ = cut(open_.join(new.select("title"), "title", "left_anti").join(new.select("route_id"), "route_id", "left_anti").select("title", "route_id", "tier"))
    return edges.select("title", "route_id").limit(0).withColumn("round", F.lit(0)) if taken is None else taken
