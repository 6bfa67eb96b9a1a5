"""Collocations against counts of every phrase."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from waymesh.llm import _shared, collocation

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=3):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, least, top):
    f, n = counted(rows)
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = collections.Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    most[q] = max(most[q], a)
        kept = []
        for p, a in candidates.items():
            if 100 * most[p] < 50 * a:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "cé", "d", "the", "of", "x" * 100, "日本", "cÉ"]
    made = []
    for _ in range(60):
        text = rng.choice([None, "", " \t", "..", "one"]) if rng.random() < 0.1 else "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\r\n", "\x0b"]) for _ in range(rng.randrange(200)))
        made.append((rng.choice(["en", "fr", None, "und"]), text))
    return made + made[:5] + [("en", "w1 w2 " * 20000)]


@pytest.mark.parametrize("seed", range(3))
def test_mine(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "lang string, text string, grp string, n int, phrase string").repartition(3)
    got = sorted((r.grp, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocation.mine(docs, top=15 + seed).collect())
    assert got == brute(rows, 10, 15 + seed)


def test_empty(spark):
    assert collocation.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocation.mine(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_scores_are_exact(spark):
    """Counts whose products pass 64 bits."""
    big = spark.createDataFrame([(10**13, 3 * 10**13, 10**13 + 1), (7, 7, 7), (10, 33, 1000)], "a bigint, l bigint, r bigint")
    got = [r["s"] for r in big.select(collocation._score(big.a, big.l, big.r).alias("s")).collect()]
    assert got == [1000000 * a * a // (left * r) for a, left, r in [(10**13, 3 * 10**13, 10**13 + 1), (7, 7, 7), (10, 33, 1000)]]


def shard_of(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["g", "t"])
    (made,) = collocation._shards(iter([batch]))
    return made


@pytest.mark.parametrize("seed,depth", [(0, 2), (1, 3), (2, 3), (3, 4), (4, 1)])
def test_automaton(seed, depth):
    """Every phrase is in one state, with its count; links lead to the longest suffix that ends at more places."""
    rows = [r for r in rows_of(seed) if r[1] is None or len(r[1]) < 10000]
    shard, names = shard_of(rows)
    automaton = collocation.Automaton(shard, depth)
    data, starts, ends = _shared.strings(shard.names)
    word = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]

    def phrase(state, length):
        at = automaton.at[state]
        numbers = shard.number[at - length + 1 : at + 1] - 1
        return names[shard.of[numbers[0]]], tuple(word[shard.name[x]] for x in numbers)

    f, _ = counted(rows, depth)
    got = {}
    for length in range(1, depth + 1):
        for state in automaton.phrases(length):
            lang, words = phrase(state, length)
            assert (lang, words) not in got
            got[lang, words] = int(automaton.count[state])
            suffix = automaton.link[state]
            if suffix >= 0:
                assert automaton.longest[suffix] == automaton.shortest[state] - 1
                assert phrase(suffix, int(automaton.longest[suffix])) == (lang, words[len(words) - automaton.longest[suffix] :])
                assert automaton.count[suffix] > automaton.count[state]
    assert got == {(lang, p): n for lang, c in f.items() for p, n in c.items()}


def test_filter_keeps_all_frequent(spark):
    rows = rows_of(5)
    docs = spark.createDataFrame(rows, "grp string, t string")
    bitmap = np.frombuffer(collocation.frequent(docs, 10, collocation.hash_ranges(docs)), np.uint8)
    shard, names = shard_of(rows)
    automaton = collocation.Automaton(shard, 2)
    collocation._coded(shard, names)
    for length in (1, 2):
        states = automaton.phrases(length)
        found = collocation._in(bitmap, collocation.phrase_hash(shard, automaton.at[states], length))
        assert found[automaton.count[states] >= 10].all()
