"""The Merkle manifest against a plain build of every tree."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from waymesh.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, id int, node string, path string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf_of(r)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        groups[x].sort(key=lambda e: (e[0][0] is not None, e[0][0] or 0, e[1]))
        trees[x] = levels([e[1] for e in groups[x]])
    top, out = levels([trees[x][-1][0] for x in order]), []
    for g, x in enumerate(order):
        for i, (row, leaf) in enumerate(groups[x]):
            path = []
            for tree, at in ((trees[x], i), (top, g)):
                for nodes in tree[:-1]:
                    path.append((at & 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else None))
                    at >>= 1
            changed = list(row)
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                changed[3] += 1
            node = leaf_of(changed)
            for right, sibling in path:
                node = digest(node if sibling is None else sibling + node if right else node + sibling)
            out.append((row[0], leaf, trees[x][-1][0], top[-1][0], tuple(s for _, s in path if s), node, node == top[-1][0]))
    return out


def key(row):
    return str(row)


def rows_of(n, seed):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        lang = rng.choice(["b", None, "é", "", *(f"g{k}" for k in range(30))]) if rng.random() < 0.5 else "a"
        made.append((None if rng.random() < 0.05 else rng.randrange(1 << 60), "s", lang, rng.choice([None, 5, 6]), rng.choice([None, "", "xé", "long " * 300])))
    return made + made[: n // 10]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 1100, 2400])
def test_paths(spark, n):
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    found = merkle.manifest(docs, COLUMNS, "lang", "doc_id", tampered={"n_chars": F.col("n_chars") + 1}, where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple(r.path), r.folded_root, r.verified) for r in found.collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame(rows_of(300, 9), "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(docs, COLUMNS, "lang", "doc_id").where("NOT verified").count() == 0


@pytest.mark.parametrize("height,step", [(0, 5), (1, 1), (4, 2), (5, 2), (6, 3), (6, 5)])
def test_traversal(height, step):
    for n in {1, (1 << height) - 1 or 1, 1 << height, max(1, (1 << height) // 2 + 1)}:
        leaves = [digest(str(i)) for i in range(n)]
        tree = [leaves]
        for _ in range(height):
            tree.append([digest("".join(tree[-1][i : i + 2])) for i in range(0, len(tree[-1]), 2)])
        want = [[tree[k][(i >> k) ^ 1] if (i >> k) ^ 1 < len(tree[k]) else None for k in range(height)] for i in range(n)]
        assert list(merkle.paths(leaves, height, step)) == want
        assert merkle.block_root(leaves, height) == tree[-1][0]


def test_traversal_holds_few_nodes():
    """Subtrees under way and in use never hold the whole block's tree."""
    height, step, most = 10, 2, 0
    made = []
    real = merkle.TreeHash.__init__

    def noted(self, *args):
        real(self, *args)
        made.append(self)

    merkle.TreeHash.__init__ = noted
    try:
        for _ in merkle.paths([digest(str(i)) for i in range(1 << height)], height, step):
            most = max(most, max(len(t.stack) for t in made[-10:]))
    finally:
        merkle.TreeHash.__init__ = real
    assert most <= height + 2
