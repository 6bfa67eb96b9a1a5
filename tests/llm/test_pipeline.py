import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymesh.llm._shared import connected, stash

from .test_corpus import SCHEMA, corpus, sets


def test_stages(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stash(stage(spark, kept, ""), name)
        if name != "byte_bpe":
            assert kept.columns == docs.columns
            ids = {r["doc_id"] for r in kept.collect()}
            assert ids <= {r["doc_id"] for r in before.collect()}
        if name == "language_id":
            assert all(t and any(c.isalpha() for c in t) for t in (r["text"] for r in kept.collect()))
        if name == "ngram_jaccard":
            s = sets()
            left = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
            left = sorted(set(left))
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    assert not (s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]))
        if name == "secret_scans":
            assert kept.count() == before.count()
    assert kept.where("round_trip").count() == kept.count() > 0


def test_empty(spark):
    kept = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        kept = stash(stage(spark, kept, ""), "empty")
    assert kept.count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (9, 8), (2, 1), (7, 7)], [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]])
def test_connected(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in connected(spark, df).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {n: root(n) for n in up}
    assert F is not None
