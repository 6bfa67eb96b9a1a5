"""A Merkle manifest of a dataset: one tree a group, a tree over the groups, a path for every row.

1. Leaves are hashed in the JVM. A range sort by (group, id, leaf) numbers them inside their
   group: the sorted rows are written once, and an offset for each (partition, group) is added.
2. A block is WIDTH aligned leaves of a group. Its root is computed where its rows meet; the
   roots are the leaves of the next tier, until one node a group is left. The groups' roots
   form one more tree in the same way.
3. Paths come from the top down. A block gets the path of its own root as one more row. Over
   its leaves runs a fractal traversal: stacked subtrees of height STEP hold the nodes that the
   present paths need, the next subtrees grow by two steps of a tree hash a leaf, and the path of
   each leaf is read off the stack, so that no more than two subtrees a layer are held. The
   block root's own path is appended.

Hash of a node: SHA-256 of its children's lowercase hex digests, one after the other. A node
without a sibling has a parent of its own all the same, unless it is the only one of its tree.

Defined results: nulls are hashed as `-`, in ids too; null ids come first; rows that are alike
are leaves of their own, next to each other; an empty table has no rows. Groups order by UTF-8
bytes, null first. Columns that are not hashed are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stash, unstash

#: Log2 of the leaves of a block, and height of a stacked subtree.
HEIGHT, STEP = 10, 5
WIDTH = 1 << HEIGHT


def leaf_hash(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns: `-` for null, else UTF-8 byte count, `:` and value."""

    def said(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[said(c) for c in columns]), 256)


def combine(left: str | None, right: str | None) -> str | None:
    """The parent of two nodes; there is none beyond a tree's right edge."""
    if left is None:
        return None
    return hashlib.sha256(f"{left}{right or ''}".encode()).hexdigest()


class Subtree:
    """The nodes of one aligned subtree of height `height`, over nodes of height `base`: those that paths need."""

    def __init__(self, base: int, height: int, index: int) -> None:
        self.base, self.height, self.index = base, height, index
        #: By height above base, the nodes from left to right; its root is a node of the layer above.
        self.rows: list[list[str | None]] = [[None] * (1 << (height - k)) for k in range(height)]

    def keep(self, level: int, index: int, node: str | None) -> None:
        """Store a node of the tree if it is one of this subtree's."""
        k = level - self.base
        if 0 <= k < self.height:
            at = index - (self.index << (self.height - k))
            if 0 <= at < len(self.rows[k]):
                self.rows[k][at] = node

    def sibling(self, leaf: int, level: int) -> str | None:
        k = level - self.base
        return self.rows[k][((leaf >> level) ^ 1) - (self.index << (self.height - k))]


class TreeHash:
    """Computes one subtree from its leaves by steps of one leaf or one hash each."""

    def __init__(self, leaves: list[str], base: int, height: int, index: int) -> None:
        self.leaves, self.into = leaves, Subtree(base, height, index)
        self.next = index << (base + height)
        self.end = (index + 1) << (base + height)
        self.stack: list[tuple[int, int, str | None]] = []

    def step(self) -> bool:
        """One step; false when the subtree is complete."""
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            level, index, right = self.stack.pop()
            _, _, left = self.stack.pop()
            node = (level + 1, index >> 1, combine(left, right))
        elif self.next < self.end:
            node = (0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
            self.next += 1
        else:
            return False
        self.stack.append(node)
        self.into.keep(*node)
        return True

    def finish(self) -> Subtree:
        while self.step():
            pass
        return self.into


def paths(leaves: list[str], height: int, step: int = STEP) -> Iterator[list[str | None]]:
    """The sibling of every level from leaf to root, for each leaf in order; None where there is none."""
    layers = [(base, min(step, height - base)) for base in range(0, height, step)]
    existing = [TreeHash(leaves, base, tall, 0).finish() for base, tall in layers]
    desired = [TreeHash(leaves, base, tall, 1) if base + tall < height else None for base, tall in layers]
    for leaf in range(len(leaves)):
        yield [tree.sibling(leaf, level) for tree in existing for level in range(tree.base, tree.base + tree.height)]
        for k, (base, tall) in enumerate(layers):
            if desired[k] is None:
                continue
            for _ in range(2):
                desired[k].step()
            if (leaf + 1) % (1 << (base + tall)) == 0:
                existing[k] = desired[k].finish()
                desired[k] = TreeHash(leaves, base, tall, existing[k].index + 1)


def block_root(leaves: list[str], height: int) -> str:
    nodes: list[str | None] = list(leaves)
    for _ in range(height):
        nodes = [combine(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None) for i in range(0, len(nodes), 2)]
    return nodes[0]


def fold(leaf: str, index: int, path: list[str | None]) -> str:
    """The root that a leaf and the siblings of its path give."""
    node = leaf
    for sibling in path:
        node = combine(node, sibling) if index & 1 == 0 else hashlib.sha256(f"{sibling}{node}".encode()).hexdigest()
        index >>= 1
    return node


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (with grp) sorted by (grp, order) and numbered from 0 in each grp as `idx`, with the group's size `total`.

    One range shuffle; the sorted rows are written once, so that a task run again numbers alike.
    """
    keys = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    laid = stash(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    laid = laid.withColumn("part", F.call_function("shiftright", F.col("at"), F.lit(33)))
    # a row for each partition and group: groups are contiguous, so about as many as partitions and groups
    runs = laid.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select(F.col("part").alias("of_part"), F.col("grp").alias("of_grp"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    met = laid.join(shift, (F.col("part") == F.col("of_part")) & F.col("grp").eqNullSafe(F.col("of_grp")))
    return met.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "of_part", "of_grp", "shift")


def tall(total: int) -> int:
    """Levels between a node and its block's root, where its tier has `total` nodes."""
    return min(HEIGHT, (total - 1).bit_length())


def _block() -> Column:
    return F.floor(F.col("idx") / WIDTH).cast("bigint")


def raised(tier: DataFrame) -> DataFrame:
    """The block roots of a tier of nodes (grp, idx, total, node)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        total = rows["total"][0].as_py()
        root = block_root(rows["node"].to_pylist(), tall(total))
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "idx": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([-(-total // WIDTH)], pa.int64()), "node": pa.array([root], pa.string())})

    return tier.select("grp", "idx", "total", "node", _block().alias("block")).groupBy("grp", "block").applyInArrow(run, "grp string, idx bigint, total bigint, node string")


#: The siblings of a path by level, empty where there is none; and its first positions' bits, which tell left from right.
_UP = "grp string, block bigint, up array<string>, up_idx bigint, subroot string, root string"


def lowered(tier: DataFrame, above: DataFrame, schema: str, emit) -> DataFrame:
    """emit(rows of a block in order, (position bits, path) of each, subroot, root) for every block of a tier.

    above has a row (grp, block, up, up_idx, subroot, root) for every block: its root's path. It
    travels as one more row of the block, so that paths are not repeated for each leaf.
    """
    both = tier.withColumn("block", _block()).unionByName(above, allowMissingColumns=True)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        is_top = pc.is_null(rows["idx"])
        top = rows.filter(is_top).slice(0, 1).to_pylist()[0]
        own = rows.filter(pc.invert(is_top)).sort_by("idx")
        levels = tall(own["total"][0].as_py())
        up = [x or None for x in top["up"]]
        found = ((i | top["up_idx"] << levels, path + up) for i, path in enumerate(paths(own["node"].to_pylist(), levels)))
        return emit(own, found, top["subroot"], top["root"])

    return both.groupBy("grp", "block").applyInArrow(run, schema)


def _passed_down(own: pa.Table, found: Iterator, subroot: str, root: str, grp: str = "grp", block: str | None = "idx", sub: str | None = None) -> pa.Table:
    n, found = own.num_rows, list(found)
    same = lambda value: pa.array([value] * n, pa.string())
    return pa.table(
        {
            "grp": own[grp],
            "block": own[block] if block else pa.array([0] * n, pa.int64()),
            "up": pa.array([[x or "" for x in path] for _, path in found], pa.list_(pa.string())),
            "up_idx": pa.array([at for at, _ in found], pa.int64()),
            "subroot": own[sub] if sub else same(subroot),
            "root": same(root),
        }
    )


def tree(tier: DataFrame, tops, name: str) -> DataFrame:
    """_UP of every block of tier, given by tops() for the roots of its trees.

    The number of tiers is the logarithm, to base WIDTH, of the largest tree's leaves.
    """
    tiers = []
    while True:
        tier = stash(raised(tier), f"{name}-{len(tiers)}")
        tiers.append(tier)
        most = tier.agg(F.max("total")).first()[0]
        if most is None or most <= 1:
            break
    above = tops(tier.select("grp", F.col("node").alias("subroot")))
    for up in reversed(tiers[:-1]):
        above = stash(lowered(up, above, _UP, _passed_down), f"{name}-up")
    return above


def over_groups(roots: DataFrame) -> DataFrame:
    """_UP of the roots (grp, subroot) of all groups, by the tree over them, which is one group itself."""
    top = numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("node")), ["name"], "roots")

    def last(root: DataFrame) -> DataFrame:
        return root.select("grp", F.lit(0).cast("bigint").alias("block"), F.array().cast("array<string>").alias("up"), F.lit(0).cast("bigint").alias("up_idx"), F.lit("").alias("subroot"), F.col("subroot").alias("root"))

    def named(own: pa.Table, found: Iterator, subroot: str, root: str) -> pa.Table:
        return _passed_down(own, found, subroot, root, grp="name", block=None, sub="node")

    return stash(lowered(top, tree(top, last, "groups"), _UP, named), "groups-up")


def proofs(leaves: DataFrame) -> DataFrame:
    """A row for each leaf (grp, id, leaf, tampered): its path, subroot, root, and what the path folds to.

    -> id, leaf, subroot, root, path (the siblings, level by level), folded_root, verified.
    tampered, where it is not null, is folded in place of leaf.
    """
    made = stash(leaves.withColumnRenamed("leaf", "node"), "hashed")
    placed = numbered(made, ["id", "node"], "leaves")
    unstash(made)
    above = tree(placed, over_groups, "tier")

    def told(own: pa.Table, found: Iterator, subroot: str, root: str) -> pa.Table:
        kept, folded = [], []
        for leaf, changed, (at, path) in zip(own["node"].to_pylist(), own["tampered"].to_pylist(), found):
            kept.append([x for x in path if x])
            folded.append(fold(changed or leaf, at, path))
        same = lambda value: pa.array([value] * len(kept), pa.string())
        return pa.table({"id": own["id"], "leaf": own["node"], "subroot": same(subroot), "root": same(root), "path": pa.array(kept, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded])})

    kind = leaves.schema["id"].dataType.simpleString()
    return lowered(placed, above, f"id {kind}, leaf string, subroot string, root string, path array<string>, folded_root string, verified boolean", told)


def manifest(docs: DataFrame, columns: list[str], group_col: str, id_col: str, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """proofs() of the rows of docs, hashed over columns, with id_col as id.

    tampered gives columns other values; rows where `where` holds are folded with these.
    """
    leaf = leaf_hash(*[F.col(c) for c in columns])
    other = F.lit(None).cast("string")
    if tampered:
        other = F.when(F.lit(True) if where is None else where, leaf_hash(*[tampered.get(c, F.col(c)) for c in columns]))
    return proofs(docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), other.alias("tampered"))).withColumnRenamed("id", id_col)
