"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits recursively at a threshold of a random direction; vectors within SPILL of a
threshold go to both sides. Vectors are compared with all others in their leaves, pairs are
verified by cosine in double precision, and links are united.

Trees are fitted on a bounded sample, every vector is indexed; where the sample is too thin for
the vectors it stands for, splits below its leaves are fitted on further rows of each leaf. A
threshold is put where few vectors lie near it, in the sample and among the further rows alike;
where none is found (a dense clump) the leaf stays whole. A leaf
of more than BLOCK vectors is compared in pairs of blocks, so no task holds more than two
blocks and no leaf is capped. A pair that meets in several leaves counts in the first of them.
Equal vectors are one representative with a multiplicity.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components
link with nothing, and so does a vector without an id; vectors of different lengths do not
link; rows with one id are one vector; where they differ, the one of the smallest component counts, then of the fewest links; an empty
table gives no rows.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Forest, connected, stash

THRESHOLD = 0.9
#: Sample rows that the trees are fitted on.
SAMPLE = 8192
TREES = 10
#: Vectors a leaf should hold, and fewest sample vectors of a split's side.
LEAF, LEAST = 256, 8
#: Directions that the splits below a tree's leaves choose from.
DEEPEST = 32
#: Further rows of a thin leaf that its splits are fitted on, for each LEAF of its vectors.
FURTHER = 64
#: Half width of the overlap at a threshold, as a cosine of the direction.
SPILL = 0.02
#: Most of a node's sample vectors that may lie in the overlap.
CROWD = 0.3
BLOCK = 512
SEED = 5


@dataclass
class Deep:
    """Splits below a leaf, in directions of its tree's pool; small, as there are as many as leaves of the input."""

    which: np.ndarray
    thresholds: np.ndarray
    kids: np.ndarray
    root: int


@dataclass
class Tree:
    directions: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    kids: list[tuple[int, int]] = field(default_factory=list)  # negative: leaf -1 - number
    #: By leaf: about how many levels of splits it lacks, and the splits below it, once they are fitted.
    deeper: list[tuple[int, Deep | None]] = field(default_factory=list)
    common: np.ndarray | None = None  # the directions of these splits
    root: int = 0

    @property
    def leaves(self) -> int:
        return len(self.deeper)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors; a row can be in several leaves."""
        rows, leaves = [], []
        for leaf, own in _walk(x, np.arange(len(x)), self.root, self.directions, self.thresholds, self.kids):
            deep = self.deeper[leaf][1]
            below = [(0, own)] if deep is None else _walk(x, own, deep.root, self.common[deep.which], deep.thresholds, deep.kids)
            for code, part in below:
                rows.append(part)
                leaves.append(np.full(len(part), code << 24 | leaf))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _walk(x: np.ndarray, own: np.ndarray, root: int, directions, thresholds, kids) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of x) for each leaf that rows of `own` reach."""
    stack = [(root, own)]
    while stack:
        node, own = stack.pop()
        if not len(own):
            continue
        if node < 0:
            yield -1 - int(node), own
            continue
        at = x[own] @ directions[node] - thresholds[node]
        stack += [(kids[node][0], own[at < SPILL]), (kids[node][1], own[at >= -SPILL])]


def _split(x: np.ndarray, directions: Iterable[tuple[object, np.ndarray]]) -> tuple | None:
    """(crowd, name, direction, cut, projections): the threshold that the fewest rows of x lie near."""
    best = None
    for name, d in directions:
        at = x @ d
        for cut in np.quantile(at, np.linspace(0.3, 0.7, 9)):
            crowd = np.mean(np.abs(at - cut) < SPILL)
            side = np.count_nonzero(at < cut)
            if min(side, len(x) - side) >= LEAST and (best is None or crowd < best[0]):
                best = (crowd, name, d, cut, at)
    return best


def grow(sample: np.ndarray, total: int, rng: np.random.Generator) -> Tree:
    """A tree over unit vectors that stand for `total` vectors."""
    tree = Tree()
    weight = total / max(1, len(sample))

    def drawn() -> Iterator[tuple[None, np.ndarray]]:
        for _ in range(8):
            d = rng.normal(size=sample.shape[1])
            yield None, d / np.linalg.norm(d)

    def node(own: np.ndarray) -> int:
        if len(own) * weight > LEAF and len(own) >= 2 * LEAST:
            best = _split(sample[own], drawn())
            if best and best[0] <= CROWD:
                _, _, d, cut, at = best
                k = len(tree.kids)
                tree.directions.append(d)
                tree.thresholds.append(float(cut))
                tree.kids.append((0, 0))
                tree.kids[k] = (node(own[at - cut < SPILL]), node(own[at - cut >= -SPILL]))
                return k
        # the sample is too thin to split on, the vectors it stands for are many: deepen() goes on, in
        # directions common to all leaves, so that the splits are small
        bits = 0
        if len(own) < 2 * LEAST and len(own) * weight > LEAF:
            bits = int(np.ceil(np.log2(len(own) * weight / LEAF)))
        tree.deeper.append((bits, None))
        return -tree.leaves

    tree.common = rng.normal(size=(DEEPEST, sample.shape[1]))
    tree.common /= np.linalg.norm(tree.common, axis=1, keepdims=True)
    tree.root = node(np.arange(len(sample)))
    return tree


def grow_below(x: np.ndarray, weight: float, pool: np.ndarray, rng: np.random.Generator) -> Deep:
    """Splits of one leaf, fitted on rows of it in random order that stand for `weight` vectors each.

    As in grow(); but a threshold is chosen on every second row, and the others must not crowd it
    either: the least crowded of many thresholds looks emptier than it is.
    """
    which, thresholds, kids, leaves = [], [], [], 0

    def node(own: np.ndarray) -> int:
        nonlocal leaves
        if len(own) * weight > LEAF and len(own) >= 4 * LEAST:
            best = _split(x[own[::2]], [(int(k), pool[k]) for k in rng.permutation(len(pool))[:8]])
            if best and best[0] <= CROWD:
                _, name, d, cut, _ = best
                at = x[own] @ d - cut
                if np.mean(np.abs(at[1::2]) < SPILL) <= CROWD:
                    k = len(kids)
                    which.append(name)
                    thresholds.append(float(cut))
                    kids.append((0, 0))
                    kids[k] = (node(own[at < SPILL]), node(own[at >= -SPILL]))
                    return k
        leaves += 1
        return -leaves

    root = node(np.arange(len(x)))
    return Deep(np.array(which, np.int16), np.array(thresholds), np.array(kids, np.int32).reshape(-1, 2), root)


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(docs: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, dim, raw bytes) of comparable vectors, and the number type of the bytes."""
    kind = "<f4" if docs.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    arrow = pa.float32() if kind == "<f4" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, raws = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.asarray(v.values.cast(arrow)) + 0  # -0.0 and 0.0 are equal components
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    raws.append(np.where(x == 0, 0, x).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["id", "dim", "raw"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), vector_col).mapInArrow(run, "id bigint, dim int, raw binary"), kind


def fit(reps: DataFrame, kind: str, seed: int = SEED) -> dict[int, tuple[int, list[Tree]]]:
    """By dimension: (first leaf number, trees), on SAMPLE representatives with the smallest hashes."""
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    level = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    share = min(1.0, (1.5 * SAMPLE + 64) / total)
    rows = reps.where(level < int(share * (1 << 30))).select("dim", "raw", "id", level.alias("h")).collect()
    rows.sort(key=lambda r: (r["h"], r["id"]))
    out, at = {}, 0
    for dim in sorted(counts):
        own = [bytes(r["raw"]) for r in rows[:SAMPLE] if r["dim"] == dim]
        rng = np.random.default_rng([seed, dim])
        sample = unit(own, kind) if own else np.zeros((0, dim))
        trees = [grow(sample, counts[dim], rng) for _ in range(TREES)]
        out[dim] = (at, trees)
        at += sum(t.leaves for t in trees)
    return deepen(reps, kind, out, seed)


def deepen(reps: DataFrame, kind: str, forest: dict[int, tuple[int, list[Tree]]], seed: int) -> dict[int, tuple[int, list[Tree]]]:
    """The forest with splits below its thin leaves, each fitted on further rows of that leaf in a task of its own."""
    if not any(bits for _, trees in forest.values() for t in trees for bits, _ in t.deeper):
        return forest
    held = reps.sparkSession.sparkContext.broadcast(forest)
    share = min(1.0, FURTHER / LEAF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = unit(part.column(1).to_pylist(), kind)
                for k, tree in enumerate(held.value[int(dim)][1]):
                    rows, leaves = tree.assign(x)
                    thin = np.array([bits > 0 for bits, _ in tree.deeper])[leaves]
                    take, leaves = pa.array(rows[thin]), leaves[thin]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(np.full(len(leaves), k, np.int32)), pa.array(leaves), part.column(2).take(take), part.column(1).take(take)], names=["dim", "tree", "leaf", "h", "raw"])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        dim, k, leaf = (int(frame[c].iloc[0]) for c in ("dim", "tree", "leaf"))
        x = unit(list(frame.sort_values(["h", "raw"])["raw"]), kind)
        deep = grow_below(x, 1 / share, held.value[dim][1][k].common, np.random.default_rng([seed, dim, k, leaf]))
        return pd.DataFrame({"dim": [dim], "tree": [k], "leaf": [leaf], "deep": [pickle.dumps(deep)]})

    h = F.xxhash64(F.lit(seed + 1), "id")
    some = reps.select("dim", "raw", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.mapInArrow(run, "dim int, tree int, leaf bigint, h bigint, raw binary")
    # about 14 bytes a split come back, one split for each LEAF vectors or so in each tree
    for r in rows.groupBy("dim", "tree", "leaf").applyInPandas(one, "dim int, tree int, leaf bigint, deep binary").toLocalIterator():
        tree = forest[r["dim"]][1][r["tree"]]
        tree.deeper[r["leaf"]] = (tree.deeper[r["leaf"]][0], pickle.loads(r["deep"]))
    return forest


def _leaves(reps: DataFrame, forest: dict, kind: str) -> DataFrame:
    """Every representative in each of its leaves: (leaf, id, times, raw, leaves)."""
    held = reps.sparkSession.sparkContext.broadcast(forest)  # bounded by SAMPLE and TREES, and about 14 bytes for each split below thin leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                at, trees = held.value[int(dim)]
                x = unit(part.column(3).to_pylist(), kind)
                rows, leaves = [], []
                for tree in trees:
                    r, leaf = tree.assign(x)
                    rows.append(r)
                    leaves.append(leaf + at)  # leaves are numbered in the low 24 bits
                    at += tree.leaves
                rows, leaves = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((leaves, rows))
                rows, leaves = rows[order], leaves[order]
                own = np.split(leaves, np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])
                lists = pa.array(own, pa.list_(pa.int64()))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(leaves), part.column(0).take(take), part.column(1).take(take), part.column(3).take(take), lists.take(take)], names=["leaf", "id", "times", "raw", "leaves"])

    return reps.select("id", "times", "dim", "raw").mapInArrow(run, "leaf bigint, id bigint, times bigint, raw binary, leaves array<bigint>")


def _first_shared(left: list[np.ndarray], right: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether `leaf` is the first leaf that the rows of left and right share."""
    a, b = [x[x < leaf] for x in left], [x[x < leaf] for x in right]
    names = np.intersect1d(np.concatenate(a) if a else [], np.concatenate(b) if b else [])
    if not len(names):
        return np.ones((len(left), len(right)), np.bool_)

    def flags(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), len(names)), np.float32)
        for k, x in enumerate(lists):
            at = np.searchsorted(names, x)
            at = at[(at < len(names))]
            hit = at[np.isin(names[at], x)] if len(at) else at
            out[k, hit] = 1
        return out

    return flags(a) @ flags(b).T == 0


def _compare(kind: str, threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        leaf = int(frame["leaf"].iloc[0])
        sides = [p for _, p in frame.groupby("side")]
        left, right = sides[0], sides[-1]
        x = unit(list(left["raw"]), kind)
        y = x if len(sides) == 1 else unit(list(right["raw"]), kind)
        near = x @ y.T >= threshold
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        if len(sides) == 1:
            np.fill_diagonal(near, False)
        if not near.any():
            return pd.DataFrame({"id": [], "other": [], "n": []}, dtype="int64")
        lists = [np.asarray(v) for v in left["leaves"]]
        near &= _first_shared(lists, lists if len(sides) == 1 else [np.asarray(v) for v in right["leaves"]], leaf)
        out = []
        times, other_times = left["times"].to_numpy(), right["times"].to_numpy()
        out.append(pd.DataFrame({"id": ids, "other": ids, "n": near @ other_times}))
        if len(sides) > 1:
            out.append(pd.DataFrame({"id": others, "other": others, "n": near.T @ times}))
        # spanning edges of this block's links are enough to unite them
        forest, edges = Forest(len(ids) + len(others)), []
        shift = 0 if len(sides) == 1 else len(ids)
        for i in range(len(ids)):
            for j in np.flatnonzero(near[i]):
                if forest.join(i, shift + int(j)):
                    edges.append((ids[i], others[j]))
        out.append(pd.DataFrame({"id": [a for a, _ in edges], "other": [b for _, b in edges], "n": [0] * len(edges)}, dtype="int64"))
        whole = pd.concat(out)
        return whole[(whole["n"] > 0) | (whole["id"] != whole["other"])]

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    raw, kind = _raw(vectors, id_col, vector_col)
    raw = stash(raw, "vectors")
    reps = stash(raw.groupBy("dim", "raw").agg(F.min("id").alias("id"), F.count("*").alias("times")), "reps")
    forest = fit(reps, kind)
    rows = _leaves(reps, forest, kind)
    rows = stash(rows, "leaves")
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1").select("leaf", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, "leaf").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # block i meets every block: as the first side with those after it, as the second with those before
    dealt = dealt.withColumn("meet", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("leaf", F.least("blk", "meet").alias("x"), F.greatest("blk", "meet").alias("y"), (F.col("blk") > F.col("meet")).cast("int").alias("side"), "id", "times", "raw", "leaves")
    # a block meets itself once, as one side
    found = stash(dealt.groupBy("leaf", "x", "y").applyInPandas(_compare(kind, threshold), "id bigint, other bigint, n bigint"), "found")
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected(spark, found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), "vectors")
    known = reps.join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("dim", "raw", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("label", "id").alias("low"))
    out = raw.join(known, ["dim", "raw"]).select("id", "links", "low")
    ids = vectors.select(F.col(id_col).alias("v"), F.col(id_col).cast("bigint").alias("id"))
    one = out.groupBy("id").agg(F.min(F.struct("low", "links")).alias("x")).select("id", "x.links", "x.low")
    whole = ids.join(one, "id", "left")
    low = F.coalesce("low", "id")
    return whole.select(F.col("v").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), low.alias("component_id"), F.coalesce(F.col("id") == low, F.lit(True)).alias("kept"))
