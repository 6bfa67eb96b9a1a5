"""Exact n-gram Jaccard join with signature trees.

A document's set is its distinct 5-word shingles (with fewer words, the whole sequence as one;
without words, empty and linked with nothing), as 64-bit hashes. Two documents link when
100 * |intersection| >= 75 * |union|.

1. Equal sets are one class with one representative; only representatives go on.
2. A lossless partition: two sets that link share m of the first n - ceil(3n/4) + m shingles
   of each in any common order; m is a tenth of the smaller set. The order puts shingles with
   small counts in a sketch first, so that shared passages come last and rarely meet. The
   sketch grows with the number of documents up to 64 MB; what it tells decides the order,
   never the result. Pairs that share enough of them, and neighbours by size where very many sets
   share one, make the edges of groups.
3. In a group, a signature tree: leaves and inner nodes hold the OR of their sets' bitmaps and
   their size range. A dual traversal compares node pairs and prunes those whose greatest
   possible overlap, popcount(OR and OR) plus what bitmap collisions may hide, is under what
   their smallest sizes need; leaf pairs that stay are compared exactly.
   Large groups are dealt in blocks under two different hash orders, and only what still has
   several components meets across blocks, in blocks by component. Node pairs whose members
   are all in one component are pruned too: they cannot add a component.

Nothing is capped: an unpruned pair is compared, in some block pair's task. No task gets more
than two blocks. What reaches the driver are counts of rounds and the sketch of bounded size.

Defined results: null text has no words; rows with one id and one set are one document; where
an id has several texts, each row has the component of its own text; a document without an id
has the component id of its equals, else none, and links no others.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._shared import Forest, connected, free_shuffles, lean, slices, small_batches, stash, strings, unstash

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Slots of the count sketch for each document, fewest and most; a slot is a byte once counted.
SLOTS_EACH, FEWEST_SLOTS, MOST_SLOTS = 32, 1 << 23, 1 << 26
#: Longest run of one shingle whose pairs are counted.
RUN = 32
#: Documents of a block of a large group.
BLOCK = 128
#: Leaf size of the tree.
LEAF = 4
U = np.uint64


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row): the sorted distinct shingles of adjacent rows of lower-cased words."""
    begin, end, at = _words.word_spans(data, starts, ends)
    words = _words.segment_hashes(data, begin, end, lower=True)
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(starts)), counts)
    windows = _words.window_hashes(words, size)
    inside = owner[: len(windows)] == owner[size - 1 :] if len(windows) else np.zeros(0, np.bool_)
    few = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(few), np.uint64)
    for k, r in enumerate(few):
        whole[k] = _words.window_hashes(words[at[r] : at[r + 1]], int(counts[r]))[0] ^ U(counts[r])
    keys = np.concatenate([windows[inside], whole])
    rows = np.concatenate([owner[: len(windows)][inside], few])
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), np.bool_)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[new], rows[new]
    return keys, np.searchsorted(rows, np.arange(len(starts) + 1))


def needed(n: np.ndarray | int):
    """The least overlap of a set of n shingles with any set it links with."""
    return -(-PERCENT * n // 100)


def margin(n):
    """Prefix shingles that two linking sets, the smaller of n, must share at the least."""
    return np.maximum(1, n // 10)


def _slots(documents: int) -> int:
    """Slots of the sketch, a power of two."""
    return min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (SLOTS_EACH * documents).bit_length()))


def _packed(counts: np.ndarray) -> bytes:
    """32-bit counts, all lowest bytes first: nearly all of the others are zero."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _sketch(docs: DataFrame, text_col: str) -> np.ndarray:
    """About 8 log2 of how many (document, shingle) pairs fall in each slot, over all documents."""
    parts = 256
    slots = _slots(docs.count())
    width = slots // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            data, starts, ends = strings(batch.column(0))
            for i, j in slices(starts, ends):
                keys, _ = shingle_sets(data, starts[i:j], ends[i:j])
                slot, n = np.unique((keys & U(slots - 1)).astype(np.int64), return_counts=True)
                counts[slot] += n.astype(np.uint32)
        for p in range(parts):
            own = counts[p * width : (p + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(own)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # a few parts of bounded width in a task, however many rows stream by
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = totals.setdefault(part, np.zeros(width, np.uint64))
                total += _unpacked(raw)
        packed = [zlib.compress(np.minimum(8 * np.log2(x + 1.0), 255).astype(np.uint8).tobytes(), 1) for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    out = np.zeros(slots, np.uint8)
    got = docs.select(text_col).mapInArrow(lean(run), "part int, counts binary").repartition("part").mapInArrow(lean(add), "part int, counts binary")
    for r in got.collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def fingerprints(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit sum over each row's mixed shingles; two sets have the same with a chance of about 2^-64."""
    mixed = np.r_[np.zeros(1, np.uint64), np.cumsum(_words.mix(keys ^ U(0x9E3779B97F4A7C15)))]
    return _words.mix(mixed[at[1:]] - mixed[at[:-1]]).astype(np.int64)


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, keys): set size, 64-bit fingerprint of the set, and its prefix shingles."""
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(docs, text_col))  # MOST_SLOTS bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_counts = counts.value
        met: set[int] = set()
        for batch in batches:
            data, starts, ends = strings(batch.column(1))
            for i, j in slices(starts, ends):
                keys, at = shingle_sets(data, starts[i:j], ends[i:j])
                n = np.diff(at)
                owner = np.repeat(np.arange(j - i), n)
                rank = slot_counts[(keys & U(len(slot_counts) - 1)).astype(np.int64)]
                order = np.lexsort((keys, rank, owner))
                place = np.arange(len(keys)) - at[owner]
                sums = fingerprints(keys, at)
                # equal sets of one task send their prefix once
                again = np.zeros(j - i, np.bool_)
                for k, f in enumerate(sums.tolist()):
                    again[k] = f in met
                    met.add(f)
                first = (place < (n - needed(n) + margin(n))[owner]) & ~again[owner]
                prefix = keys[order][first].astype(np.int64)
                offsets = np.r_[0, np.cumsum(np.bincount(owner[first], minlength=j - i))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(sums), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix))],
                    names=["id", "n", "f1", "keys"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_col)
    return rows.mapInArrow(lean(run), "id bigint, n bigint, f1 bigint, keys array<bigint>")


def _candidates(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between set fingerprints that can link.

    Runs of one shingle are streamed in the order of size. In a run of up to RUN sets all pairs
    of fitting sizes are counted, and a pair needs margin() common prefix shingles. A longer run
    is not paired: its neighbours by size are joined unconditionally, which joins all that fit.
    """
    keyed = rows.select("f1", "n", F.explode("keys").alias("key"))
    dealt = keyed.repartition("key").sortWithinPartitions("key", "n", "f1")
    whole = 1 << 20  # the weight of an edge that needs no count

    def edges(key: np.ndarray, n: np.ndarray, f: np.ndarray, first_long: bool) -> pa.RecordBatch:
        new = np.r_[True, key[1:] != key[:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(key)])
        if first_long:  # the rest of a long run
            size[0] = RUN + 1
        size = size[np.cumsum(new) - 1]
        # most shingles stand in one set only
        met = np.r_[~new[1:], False] | ~new
        key, n, f, size = key[met], n[met], f[met], size[met]
        found = []
        for step in range(1, RUN):
            if len(key) <= step:
                break
            fit = (key[step:] == key[:-step]) & (100 * n[:-step] >= PERCENT * n[step:])
            fit &= size[step:] <= RUN if step > 1 else True
            at = np.flatnonzero(fit)
            if not len(at):
                break
            a, b = f[at], f[at + step]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.where(size[at] <= RUN, 1, whole), np.minimum(n[at], n[at + step])], 1))
        got = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        order = np.lexsort((got[:, 1], got[:, 0]))
        got = got[order]
        head = np.flatnonzero(np.r_[True, (got[1:, 0] != got[:-1, 0]) | (got[1:, 1] != got[:-1, 1])]) if len(got) else np.zeros(0, np.int64)
        weight = np.add.reduceat(got[:, 2], head) if len(head) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[head, 0]), pa.array(got[head, 1]), pa.array(weight), pa.array(got[head, 3])], names=["a", "b", "w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = [np.zeros(0, np.int64)] * 3, False  # of the run that goes on: its rows, or its last where it is long
        for batch in batches:
            key, n, f = (np.concatenate([h, np.asarray(batch.column(c))]) for h, c in zip(held, ("key", "n", "f1")))
            if not len(key):
                continue
            once = np.r_[True, (key[1:] != key[:-1]) | (f[1:] != f[:-1])]  # equal sets come from several tasks
            key, n, f = key[once], n[once], f[once]
            last = int(np.searchsorted(key, key[-1]))
            goes_on = len(key) - last > RUN or (long and last == 0)
            cut = len(key) if goes_on else last
            if cut:
                yield edges(key[:cut], n[:cut], f[:cut], long)
                long = False
            if goes_on:
                cut, long = len(key) - 1, True
            held = [key[cut:], n[cut:], f[cut:]]
        if len(held[0]):
            yield edges(*held, long)

    counted = dealt.mapInArrow(lean(run), "a bigint, b bigint, w bigint, n bigint").groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("n").alias("n"))
    return counted.where(F.col("w") >= F.greatest(F.lit(1), F.floor(F.col("n") / 10))).select("a", "b")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted's rows (id, f1, ...) with `words`: the sorted shingles, as bytes, of that id's text with that fingerprint, once each."""
    spark = docs.sparkSession
    # a bitmap of fixed size keeps most other texts from the shuffle; the join itself is exact
    bits = 1 << 23
    hashed = F.pmod(F.xxhash64("id"), F.lit(bits))
    seen = np.zeros(bits // 8, np.uint8)
    page = 8 * 4096  # bits of one aggregated bitmap
    for r in wanted.groupBy(F.floor(hashed / page).alias("p")).agg(F.bitmap_construct_agg(hashed % page).alias("b")).collect():
        seen[r["p"] * 4096 : (r["p"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    held = spark.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        met: set[tuple] = set()  # a text that stands in very many rows is sent once by each task
        for batch in batches:
            at = np.asarray(batch.column(2))
            hit = np.flatnonzero((own[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            batch = batch.take(pa.array(hit))
            data, starts, ends = strings(batch.column(1))
            for i, j in slices(starts, ends):
                keys, first = shingle_sets(data, starts[i:j], ends[i:j])
                names = list(zip(batch.column(0)[i:j].to_pylist(), fingerprints(keys, first).tolist()))
                new = [k for k, name in enumerate(names) if not (name in met or met.add(name))]
                raw = [keys[first[k] : first[k + 1]].tobytes() for k in new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k][0] for k in new], pa.int64()), pa.array([names[k][1] for k in new], pa.int64()), pa.array(raw, pa.binary())],
                    names=["id", "f1", "words"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).withColumn("bit", hashed)
    met = wanted.join(rows.mapInArrow(lean(run), "id bigint, f1 bigint, words binary"), ["id", "f1"])
    return met.dropDuplicates(["id", "f1"])  # dealt as the join deals: the words move once


class SignatureTree:
    """Sets sorted by size, halved down to leaves; each node has an OR bitmap and a size range."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, width: int) -> None:
        self.order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), k))
        self.sets = [sets[k] for k in self.order]
        self.size = np.array([len(s) for s in self.sets])
        self.label = labels[self.order]
        self.maps = np.zeros((len(sets), width // 64), np.uint64)
        for k, s in enumerate(self.sets):
            slot = _words.mix(s) & U(width - 1)
            np.bitwise_or.at(self.maps[k], (slot >> U(6)).astype(np.int64), U(1) << (slot & U(63)))
        #: what collisions in a set's own bitmap may hide
        self.hidden = self.size - _bits(self.maps)
        self.nodes: list[tuple] = []
        self.root = self._node(0, len(self.sets))

    def _node(self, a: int, b: int) -> int:
        kids = ()
        if b - a > LEAF:
            mid = (a + b) // 2
            kids = (self._node(a, mid), self._node(mid, b))
            bitmap = self.nodes[kids[0]][2] | self.nodes[kids[1]][2]
        else:
            bitmap = np.bitwise_or.reduce(self.maps[a:b], axis=0)
        labels = self.label[a:b]
        one = labels[0] if (labels == labels[0]).all() else None
        self.nodes.append((a, b, bitmap, int(self.size[a]), int(self.size[b - 1]), int(self.hidden[a:b].max()), kids, one))
        return len(self.nodes) - 1


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def dual_traversal(x: SignatureTree, y: SignatureTree, join) -> None:
    """Calls join(i, j) for linked positions of x and y that join() does not know to be together.

    join.same(i, j) says whether two positions are known to be in one component.
    """
    stack = [(x.root, y.root)]
    while stack:
        p, q = stack.pop()
        if x is y and p < q:
            p, q = q, p
        a, b, bitmap, low, high, hidden, kids, one = x.nodes[p]
        a2, b2, bitmap2, low2, high2, hidden2, kids2, one2 = y.nodes[q]
        if one is not None and one == one2:
            continue
        # sizes too far apart
        if 100 * min(high, high2) < PERCENT * max(low, low2):
            continue
        most = int(_bits(bitmap & bitmap2)) + min(hidden, hidden2)
        # the overlap that the smallest sizes need: 100 o >= PERCENT (a + b - o)
        if (100 + PERCENT) * min(most, high, high2) < PERCENT * (low + low2):
            continue
        if kids and (not kids2 or b - a >= b2 - a2):
            stack += [(k, q) for k in kids] if not (x is y and p == q) else [(kids[0], kids[0]), (kids[1], kids[1]), (kids[0], kids[1])]
        elif kids2:
            stack += [(p, k) for k in kids2]
        else:
            for i in range(a, b):
                for j in range(a2, b2):
                    if (x is y and p == q and i >= j) or join.same(i, j):
                        continue
                    o = int(_bits(x.maps[i] & y.maps[j])) + min(int(x.hidden[i]), int(y.hidden[j]))
                    if (100 + PERCENT) * o >= PERCENT * int(x.size[i] + y.size[j]) and linked(x.sets[i], y.sets[j]):
                        join(i, j)


class _Join:
    """Union-find over both sides' labels; keeps the links that joined two components."""

    def __init__(self, x: SignatureTree, y: SignatureTree) -> None:
        names = np.unique(np.r_[x.label, y.label])
        self.left, self.right = np.searchsorted(names, x.label), np.searchsorted(names, y.label)
        self.forest, self.found = Forest(len(names)), []

    def same(self, i: int, j: int) -> bool:
        return self.forest.root(self.left[i]) == self.forest.root(self.right[j])

    def __call__(self, i: int, j: int) -> None:
        if self.forest.join(int(self.left[i]), int(self.right[j])):
            self.found.append((i, j))


def tree_links(left: tuple, right: tuple | None = None) -> list[tuple[int, int]]:
    """(id, id) links that join components of (ids, labels, sets); of one side with itself, or of two."""
    longest = max(len(s) for part in (left, right) if part for s in part[2])
    width = 1 << max(9, int(8 * longest - 1).bit_length())
    x = SignatureTree(left[2], left[1], width)
    y = x if right is None else SignatureTree(right[2], right[1], width)
    join = _Join(x, y)
    dual_traversal(x, y, join)
    own, other = left[0], (left if right is None else right)[0]
    return [(int(own[x.order[i]]), int(other[y.order[j]])) for i, j in join.found]


_LINKS = "a bigint, b bigint"


def _parsed(frame: pd.DataFrame) -> tuple:
    return frame["id"].to_numpy(), frame["label"].to_numpy(), [np.frombuffer(w, np.uint64) for w in frame["words"]]


def _within(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(tree_links(_parsed(frame)), columns=["a", "b"], dtype="int64")


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    sides = [part for _, part in frame.groupby("side")]
    if len(sides) == 1:
        return _within(sides[0])
    return pd.DataFrame(tree_links(_parsed(sides[0]), _parsed(sides[1])), columns=["a", "b"], dtype="int64")


def _tree_join(spark: SparkSession, grouped: DataFrame) -> DataFrame | None:
    """Links that make the components of (gid, m, id, words), m the sets of a group: spanning edges, written."""
    rows = grouped.withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    # first round: one block holds a whole small group; large groups are dealt twice, so that blocks overlap
    turns = F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    first = rows.withColumn("turn", F.explode(turns)).withColumn("blk", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", "turn"), F.col("blocks"))).otherwise(F.lit(0)))
    found = stash(first.select("gid", "turn", "blk", "id", F.col("id").alias("label"), "words").groupBy("gid", "turn", "blk").applyInPandas(_within, _LINKS), "links-1")
    large = rows.where("blocks > 1")
    labels = connected(spark, found, "groups", found.count())
    parts = large.select("gid", "id", "words").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    parts = stash(parts, "parts")
    # second round: groups that still have several components, in blocks by component
    by_label = parts.groupBy("gid", "label").agg(F.count("*").alias("k"))
    several = by_label.groupBy("gid").agg(F.count("*").alias("c"), F.sum(F.when(F.col("k") < BLOCK, F.col("k")).otherwise(0)).alias("small")).where("c > 1")
    blocked = parts.join(by_label, ["gid", "label"]).join(several, "gid")
    own = F.col("k") >= BLOCK
    blk = F.when(own, F.struct(F.col("label").alias("l"), F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / BLOCK)).alias("h"))).otherwise(F.struct(F.lit(None).cast("bigint").alias("l"), F.pmod(F.xxhash64("label"), F.ceil(F.col("small") / BLOCK)).alias("h")))
    blocked = blocked.withColumn("blk", blk).select("gid", "id", "label", "words", "blk")
    names = blocked.groupBy("gid", "blk").agg(F.max(F.length("words")).alias("high"), F.min(F.length("words")).alias("low"))
    left = names.select("gid", F.col("blk").alias("x"), F.col("low").alias("x_low"), F.col("high").alias("x_high"))
    right = names.select(F.col("gid").alias("g2"), F.col("blk").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    # blocks of one component never meet; blocks whose sizes can't link neither
    fit = (F.col("gid") == F.col("g2")) & (F.col("x") <= F.col("y")) & ~(F.coalesce(F.col("x.l") == F.col("y.l"), F.lit(False))) & (100 * F.least("x_high", "y_high") >= PERCENT * F.greatest("x_low", "y_low"))
    pairs = left.join(right, fit).select("gid", "x", "y").withColumn("meet", F.xxhash64("gid", "x", "y"))
    sides = pairs.select("gid", "meet", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("blk"))
    met = sides.join(blocked, ["gid", "blk"]).withColumn("side", (F.col("blk") == F.col("y")).cast("int"))
    more = met.select("gid", "meet", "side", "id", "label", "words").groupBy("gid", "meet").applyInPandas(_across, _LINKS)
    out = found.union(stash(more, "links-2"))
    for t in (labels, parts):
        unstash(t)
    return out


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reachable by links."""
    spark = docs.sparkSession
    keyed = stash(_with_keys(small_batches(docs), id_col, text_col), "prefixes")
    edges = stash(_candidates(keyed.where("n > 0")), "candidates")
    documents = keyed.count()
    rows = stash(keyed.select("id", "n", "f1"), "fingerprints", documents)
    unstash(keyed)
    free_shuffles(spark)
    groups = connected(spark, edges, "grouped", edges.count())
    unstash(edges)
    reps = rows.where("n > 0 and id is not null").groupBy("f1").agg(F.min("id").alias("id"))
    grouped = stash(reps.join(groups, F.col("f1") == F.col("node")).select("id", "f1", F.col("label").alias("gid")), "grouped-sets", documents)
    # sizes are joined before the words are there; a table of its own, so that Spark can split a group with very many sets
    sizes = stash(grouped.groupBy("gid").agg(F.count("*").alias("m")), "sizes", documents)
    wanted = stash(grouped.join(sizes, "gid"), "wanted", documents)
    # a set is named by its fingerprint: an id can have several
    sets = stash(_sets_of(docs, wanted, id_col, text_col).select("gid", "m", F.col("f1").alias("id"), "words"), "sets")
    free_shuffles(spark)
    links = _tree_join(spark, sets)
    unstash(sets)
    labels = connected(spark, links, "components", links.count())
    known = reps.join(labels.select(F.col("node").alias("f1"), "label"), "f1", "left").withColumn("label", F.coalesce("label", "f1"))
    known = stash(known, "known", documents)
    low = known.groupBy("label").agg(F.min("id").alias("low"))
    low = stash(known.join(low, "label").select("f1", "low"), "lows", documents)  # a table of its own, so that a set with very many copies is a join that Spark can split
    some = rows.where("n > 0").join(low, "f1", "left").select("id", "n", F.coalesce("low", "id").alias("component_id"))
    out = some.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
