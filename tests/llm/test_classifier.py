"""The quality classifier: its units, sums, gradients, calibration, and learning on a made corpus."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import _words, classifier

SCHEMA = "doc_id bigint, text string, lang string, i string, y int, level int"


def texts_of(*texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return classifier.Texts(data, ends - np.array([len(r) for r in raw], np.int64), ends)


def test_units():
    t = texts_of("The cat, the CAT!! cat,", "", "cat, 12 É|", " ")
    assert t.counts.tolist() == [5, 0, 3, 0] and t.word[1] == t.word[4] == t.word[5] and len(t.hash) == 6
    forms = t.form_of[t.word]
    assert forms[0] != forms[1] and forms[1] == forms[4] and forms[3] not in forms[[0, 1, 2]]
    assert texts_of("abc, x").form_hash.tolist() != texts_of("ABC, x").form_hash.tolist()
    assert texts_of("zz zz a zz").repeats(1).tolist() == [False, True, False, False] and texts_of("zz zz a zz").repeats(2).tolist() == [False, False, False, True]


def test_contexts_by_hand():
    """Sums of index vectors against a loop over occurrences."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "Bb", "c!", "dd", "E"]) for _ in range(rng.randrange(12))) for _ in range(9)]
    table = np.zeros((classifier.UNITS, classifier.PLACES + 1), np.int64)
    t = texts_of(*texts)
    classifier.contexts(t, table)
    want = np.zeros_like(table)
    rows, f_rows = t.word_rows(), t.form_rows()

    def add(row, h):
        for place, sign in classifier.places(np.array([h], np.uint64)):
            want[row, place[0]] += sign[0]

    for i, w in enumerate(t.word):
        form = t.form_of[w]
        want[rows[w], -1] += 1
        want[f_rows[form], -1] += 1
        add(rows[w], t.form_hash[form])
        for j in (i - 1, i + 1):
            if 0 <= j < len(t.word) and t.text[j] == t.text[i]:
                add(rows[w], t.hash[t.word[j]])
                add(f_rows[form], t.form_hash[t.form_of[t.word[j]]])
        for back in (1, 2):
            if i >= back and t.text[i - back] == t.text[i] and t.word[i - back] == w:
                add(rows[w], classifier._REPEATS[back - 1])
                add(f_rows[form], classifier._REPEATS[back - 1])
    assert (table == want).all()


def test_pooling_is_by_document():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(classifier.UNITS, classifier.PLACES)).astype(np.float32)
    texts = ["the cat sat", "", "the the THE!! cat", "x " * 70_000]
    together = classifier.pooled(texts_of(*texts), vectors)
    for k, text in enumerate(texts):
        assert np.allclose(classifier.pooled(texts_of(text), vectors)[0], together[k], atol=1e-5)
    t = texts_of(texts[0])
    assert np.allclose(together[0, : classifier.PLACES], vectors[t.word_rows()[t.word]].mean(0), atol=1e-5) and not together[1].any()


def test_gradients():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(7, 5)), rng.integers(0, 2, 7).astype(float), rng.random(7)
    parts = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), 0.3]

    def loss(p):
        z = np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]
        return float((w * np.logaddexp(0, -z * (2 * y - 1))).mean())

    for k, g in enumerate(classifier.gradients(x, y, w, *parts)):
        flat = np.atleast_1d(np.asarray(parts[k], float))
        for at in np.ndindex(flat.shape):
            moved = []
            for step in (1e-6, -1e-6):
                other = flat.copy()
                other[at] += step
                moved.append(loss([*parts[:k], other if k < 3 else float(other[0]), *parts[k + 1 :]]))
            assert np.atleast_1d(g)[at] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-6)


def corpus(n=400):
    rng = random.Random(4)
    vocab = [a + b for a in ("ri", "sto", "wal", "gre", "hou") for b in ("ver", "ne", "king", "en", "se")]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            how = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if how == 0 else [w + "***" for w in words] if how == 1 else [w for w in words for _ in range(4)]
        rows.append((i, " ".join(words) + ".", "en", "clash", 9, 9, int(not bad)))
    return rows


def test_learns_and_is_calibrated(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:6] for r in rows], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows], "doc_id bigint, quality int")
    model = classifier.fit(docs, labels.where(~classifier.held_out()))
    got = {r["doc_id"]: r["score"] for r in classifier.predict(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(classifier.held_out()).collect()}
    right = [(got[r[0]] >= 0.5) == bool(r[6]) for r in rows if r[0] in held]
    assert len(right) > 40 and sum(right) >= 0.95 * len(right)
    brier = np.mean([(got[r[0]] - r[6]) ** 2 for r in rows if r[0] in held])
    assert brier < 0.05 and abs(np.mean([got[r[0]] - r[6] for r in rows if r[0] in held])) < 0.08
    again = classifier.fit(docs.repartition(2), labels.where(~classifier.held_out()))
    assert (again.vectors == model.vectors).all() and np.allclose(again.first, model.first)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([r[:6] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows], "doc_id bigint, quality int")
    turned = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifier.fit(docs, x.where(~classifier.held_out())) for x in (labels, turned))
    assert np.array_equal(a.first, b.first) and a.temperature == b.temperature


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = classifier.fit(empty, none)
    assert classifier.predict(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None, None), (2, "", None, None, None, None), (None, "some words", None, None, None, None), (2, "é" * 300_000, None, None, None, None), (3, "w " * 200_000, None, None, None, None)], SCHEMA)
    assert {r["score"] for r in classifier.predict(odd, model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0), (3, 7)], "doc_id bigint, quality int")
    alike = classifier.fit(odd, labels)
    # ids 1 and 2 are learned from, once each
    assert {round(r["score"], 9) for r in classifier.predict(odd, alike).collect()} == {0.75}
    both = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id bigint, quality int")
    assert all(0 <= r["score"] <= 1 for r in classifier.predict(odd, classifier.fit(odd, both)).collect())


def thue_morse(n, x="a", y="b"):
    word = x
    while len(word) < n:
        word += word.translate({ord(x): y, ord(y): x})
    return word, word.translate({ord(x): y, ord(y): x})


@pytest.mark.parametrize("n", [32, 64, 128, 1024, 2048, 4096])
def test_hashes_tell_complements_apart(n):
    """Strings that collide under every polynomial hash modulo a power of two."""
    a, b = thue_morse(n)
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    starts = np.array([0, n + 1, 2 * n + 2])
    h = _words.segment_hashes(data, starts, starts + n)
    assert h[0] == h[2] != h[1]
    ids = _words.word_ids(data, starts, starts + n)
    assert ids[0] == ids[2] != ids[1]
