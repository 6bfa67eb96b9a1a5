"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources a document counts for).
A flow network routes token capacity from patterns to source quotas: a pattern's first,
second, ... repetition are arcs of its size with rising (convex) cost, so fresh text is used
before repeated text, and a quota that several patterns can serve takes the cheapest. Each
pattern's flow is then drawn from its documents in a seeded order: whole passes first, and
for the rest the documents in order of their hashes, passing over each that is larger than
what is still open, until none fits; then the smallest one left, where it comes nearer. So a
pattern's words miss its flow by half the size of the smallest document left at most.

Only per-source and per-pattern sums reach the driver. Where a round of the rest ends is found
with hash histograms: no task orders a source's documents, whatever share of the rows it holds.

Defined results: null text has size 0 and is never taken; a null source is a source of its
own, last in order; rows with equal ids are taken alike; an empty table gives no rows.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stash

WORD = r"[^\x20\x09-\x0D]+"
SEED = 11
#: Hashes are non-negative; each histogram that finds where a round ends resolves LEVEL more of their bits.
HASH_BITS, LEVEL = 63, 10
LAST = (1 << HASH_BITS) - 1
#: Up to so many documents a pattern, one histogram leaves about a thousand in the bucket that overshoots.
FEW = 1 << 20
STATE = "pat string, last bigint, gap bigint"
#: Plans of up to so many patterns (about 100 bytes each) are broadcast; more are joined by shuffle.
SMALL = 20_000


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = 3.0) -> dict[str | None, float]:
    """Share all words by weight; no source gets over `most` times its size, the excess is shared anew."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


class Network:
    """Successive shortest augmenting paths on integer capacities."""

    def __init__(self, n: int) -> None:
        self.at: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        moved = 0
        while True:
            dist: list[float] = [float("inf")] * len(self.at)
            via, queued, queue = [-1] * len(self.at), [False] * len(self.at), deque([s])
            dist[s] = 0
            while queue:
                x = queue.popleft()
                queued[x] = False
                for k in self.at[x]:
                    y = self.to[k]
                    if self.room[k] > 0 and dist[x] + self.cost[k] < dist[y]:
                        dist[y], via[y] = dist[x] + self.cost[k], k
                        if not queued[y]:
                            queued[y] = True
                            queue.append(y)
            if via[t] < 0:
                return moved
            room, x = None, t
            while x != s:
                k = via[x]
                room = self.room[k] if room is None else min(room, self.room[k])
                x = self.to[k ^ 1]
            x = t
            while x != s:
                k = via[x]
                self.room[k] -= room
                self.room[k ^ 1] += room
                x = self.to[k ^ 1]
            moved += room


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 3) -> list[int]:
    """Words each pattern supplies: min-cost flow, the r-th repetition of a word costing r squared."""
    names = list(quotas)
    first = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net = Network(2 + len(patterns) + len(names))
    arcs = []
    for i, (members, size) in enumerate(patterns):
        arcs.append([net.arc(0, 2 + i, size, r * r) for r in range(1, repeats + 1)])
        for s in members:
            net.arc(2 + i, first[s], size * repeats, 0)
    for s in names:
        net.arc(first[s], 1, int(round(quotas[s])), 0)
    net.run(0, 1)
    return [sum(net.room[k ^ 1] for k in own) for own in arcs]


def sized(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", *kept: Column) -> DataFrame:
    """(id, members array, pat, size, h, and the kept columns): the words of every whole text, and its seeded hash."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("bigint"), F.lit(0))
    mark = F.transform(members, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~")))
    rows = docs.select(F.col(id_col).alias("id"), members.alias("members"), F.concat_ws("\x1f", F.array_sort(mark)).alias("pat"), size.alias("size"), *kept)
    return rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id"), 1))


def _members(source_col: str, members_col: str | None) -> Column:
    return F.array_sort(F.col(members_col)) if members_col else F.array(F.col(source_col).cast("string"))


@dataclass
class Plan:
    """What a mix has decided, as tables: of a row a pattern, and of ids that several rows share."""

    patterns: DataFrame
    spans: DataFrame
    closers: DataFrame
    shared_ids: DataFrame
    sent: Callable[[DataFrame], DataFrame]

    def applied(self, rows: DataFrame) -> DataFrame:
        """Adds the plan and `copies` to sized() rows; where the tables are broadcast, rows do not move."""
        same = (F.col("pat") == F.col("c_pat")) & (F.col("h") == F.col("c_h"))
        total = rows.join(self.sent(self.patterns), "pat").join(self.sent(self.spans), "pat", "left").join(self.sent(self.closers), same, "left")
        few = F.broadcast if self.shared_ids.count() <= SMALL else lambda d: d
        # all rows of an id are taken together, so that their size is that of all of them
        total = total.join(few(self.shared_ids), (F.col("pat") == F.col("u_pat")) & (F.col("h") == F.col("u_h")), "left").withColumn("unit", F.coalesce("unit", "size"))
        extra = F.coalesce(_within("unit"), F.lit(False)) | F.coalesce("closes", F.lit(False))
        return total.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + extra.cast("int")).otherwise(F.lit(0)))


def plan(rows: DataFrame, weigh: Callable[[list], dict], most: int = 3, overlap: bool = False) -> Plan:
    """Decide the mix of sized() rows, a written table."""
    sums = rows.groupBy("members", "pat").agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect()
    found = [(tuple(r["members"]), r["pat"], r["n"]) for r in sums]
    found.sort(key=lambda x: x[1])
    sizes: dict = {}
    for own, _, n in found:
        for s in own:
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(n for _, _, n in found)
    quotas = _shared_targets(total, sizes, names, weigh, most) if overlap else targets({s: sizes[s] for s in names}, weigh(names), most)
    flow = route([(own, n) for own, _, n in found], quotas, most)
    made = [(pat, own[0] if own else None, n, float(quotas[own[0]]) if own else 0.0, int(sizes[own[0]]) if own else 0, min(most, f // n) if n else 0, f - min(most, f // n) * n if n else 0) for (own, pat, n), f in zip(found, flow)]
    patterns = rows.sparkSession.createDataFrame(made, "pat string, first_source string, pat_size bigint, target double, source_size bigint, passes int, rest bigint")
    return _pick(rows, patterns, F.broadcast if len(made) <= SMALL else lambda d: d, max((r["k"] for r in sums), default=0))


def mix(docs: DataFrame, weigh: Callable[[list], dict], most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", members_col: str | None = None) -> DataFrame:
    """(id, source.., size, source_size, target, copies, taken) for every document.

    weigh maps the ordered source names to weights. With members_col, an array of sources, a
    document counts for several sources; source, source_size and target are then its first's.
    """
    rows = stash(sized(docs, _members(source_col, members_col), id_col, text_col), "sized")
    picked = plan(rows, weigh, most, members_col is not None).applied(rows)
    return picked.select(F.col("id").alias(id_col), F.col("first_source").alias("mix_source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixed_rows(docs: DataFrame, weigh: Callable[[list], dict], most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", members_col: str | None = None) -> DataFrame:
    """The documents the mix takes, each as often as it takes it; same columns as docs, and no shuffle of texts."""
    members = _members(source_col, members_col)
    decided = plan(stash(sized(docs, members, id_col, text_col), "sized"), weigh, most, members_col is not None)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src")
    taken = decided.applied(sized(docs, members, id_col, text_col, whole)).where("copies > 0")
    return taken.select("src", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("src.*")


def _shared_targets(total: int, sizes: dict, names: list, weigh, most: float) -> dict:
    """With overlap the quotas share the distinct words, each source's size being all it can use."""
    weights = weigh(names)
    scale = total / max(1, sum(sizes.values()))
    return {s: t * scale for s, t in targets({s: sizes[s] for s in names}, weights, most / max(scale, 1e-9)).items()}


def _pick(rows: DataFrame, plans: DataFrame, sent, most_rows: int) -> Plan:
    """Which documents are in their pattern's seeded rest; `sent` marks tables of a row a pattern.

    First fit in seeded order: a document that is larger than what is open is passed over. Each
    round takes what fits up to the first that does not, for all patterns at once.
    """
    spark = rows.sparkSession
    units = stash(rows.where("size > 0").groupBy("pat", "h").agg(F.sum("size").alias("size"), F.count("*").alias("k")), "units")
    open_ = [(r["pat"], -1, r["rest"]) for r in plans.where("rest > 0").select("pat", "rest").collect()]
    shifts = [LEVEL, 2 * LEVEL] if most_rows > FEW else [LEVEL]
    spans, left = [], []
    while open_:
        found = {r["pat"]: r for r in _round(units, spark.createDataFrame(open_, STATE), sent, shifts).collect()}
        after = []
        for pat, last, gap in open_:
            r = found.get(pat)
            if r is None:  # nothing fits any more
                left.append((pat, last, gap))
                continue
            spans.append((pat, last, r["last"], gap))
            if r["got"] < gap:
                after.append((pat, r["last"], gap - r["got"]))
        open_ = after
    spans = spark.createDataFrame(spans, "pat string, lo bigint, hi bigint, most bigint")
    spans = stash(spans.groupBy("pat").agg(F.collect_list(F.struct("lo", "hi", "most")).alias("spans")), "spans")
    own = rows.select("pat", "h").limit(0) if not left else _nearest(units, spans, spark.createDataFrame(left, STATE), sent)
    own = stash(own.select(F.col("pat").alias("c_pat"), F.col("h").alias("c_h"), F.lit(True).alias("closes")), "closers")
    wide = units.where("k > 1").select(F.col("pat").alias("u_pat"), F.col("h").alias("u_h"), F.col("size").alias("unit"))
    return Plan(plans, spans, own, wide, sent)


def _within(size: str):
    """Whether a unit of this size was taken in one of its pattern's rounds."""
    return F.exists("spans", lambda x: (F.col("h") > x["lo"]) & (F.col("h") <= x["hi"]) & (F.col(size) <= x["most"]))


def _round(units: DataFrame, state: DataFrame, sent, shifts: list[int]) -> DataFrame:
    """(pat, last, got): in each open pattern where the units that fit, in seeded order, first overshoot."""
    by = Window.partitionBy("pat").orderBy("b")
    fit = units.join(sent(state), "pat").where((F.col("h") > F.col("last")) & (F.col("size") <= F.col("gap"))).select("pat", "h", "size", "gap")
    part, whole = fit.withColumn("before1", F.lit(0).cast("bigint")), None
    for bits in shifts:
        bucket = F.shiftright("h", HASH_BITS - bits)
        sums = part.groupBy("pat", "gap", "before1", bucket.alias("b")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("to", F.col("before1") + F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if whole is None:  # patterns where all that fit, fit together
            whole = sums.groupBy("pat", "gap").agg(F.max("to").alias("got")).where("got <= gap").select("pat", F.lit(LAST).alias("last"), "got")
        ends = sums.where("to > gap and to - n <= gap").select("pat", F.col("b").alias("b1"), (F.col("to") - F.col("n")).alias("start"))
        part = part.join(sent(ends), "pat").where(bucket == F.col("b1")).select("pat", "h", "size", "gap", F.col("start").alias("before1"), F.shiftleft("b1", HASH_BITS - bits).alias("floor"))
    # the bucket that overshoots holds few units: they are added one by one
    each = part.withColumn("to", F.col("before1") + F.sum("size").over(Window.partitionBy("pat").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    taken = F.col("to") <= F.col("gap")
    cut = each.groupBy("pat").agg(F.coalesce(F.max(F.when(taken, F.col("h"))), F.min("floor") - 1).alias("last"), F.coalesce(F.max(F.when(taken, F.col("to"))), F.min("before1")).alias("got"))
    return cut.union(whole)


def _nearest(units: DataFrame, spans: DataFrame, state: DataFrame, sent) -> DataFrame:
    """(pat, h): the smallest unit still free, all of which are larger than the gap, where it brings the sum nearer."""
    free = units.join(sent(state.select("pat", "gap")), "pat").join(sent(spans), "pat", "left").where(~F.coalesce(_within("size"), F.lit(False)))
    best = free.groupBy("pat", "gap").agg(F.min(F.struct("size", "h")).alias("x"))
    return best.where("x.size - gap < gap").select("pat", "x.h")


def weigh_in_turn(names: list) -> dict:
    """Weights 1, 2, 3, 1, 2, 3, ... in source order."""
    return {s: i % 3 + 1 for i, s in enumerate(names)}
