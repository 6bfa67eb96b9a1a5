"""Quality classification by random-indexing word vectors and a two-layer network in numpy.

Units are words as they are written, and their forms: the kinds of characters in a word, each
run once (`Aa`, `a.`, `A!`). Every unit has an index vector, a few signs at places that its
hash gives. A unit's word vector is the mean of the index vectors of what stands around it:
neighbouring words and forms, its own form, and whether it repeats one of the two words before.
The sums behind the means are taken over all documents, in a table of UNITS hashed rows that
every task fills for itself; they are integers, so that any order of adding gives the same.

A document is pooled into the means of its words' vectors, of its forms' vectors, and of the
index vectors of its own contexts. Two layers (tanh, then logistic) are fitted on a bounded
sample of labelled rows by stochastic gradient descent with momentum; every fourth row of a
class is kept from it and gives the temperature. Classes are drawn to a bound each and weighted
back, so that scores are probabilities under the labelled rows' share of classes.

Memory of a task: a batch of texts and the table (20 MB).

Defined results: a null text and one without words is pooled to zeros and scored like any
other. Rows without a label, with a null one or without an id are scored and not learned from;
several labels of an id each count; of several texts of a labelled id the one with the smallest
hash is learned from. If all labels are alike each score is (ones + 1) / (rows + 2); with none, 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._shared import lean, slices, small_batches, strings

#: Rows of the table for words and for forms, and places of an index vector.
WORDS, FORMS, PLACES = 1 << 15, 1 << 12, 64
UNITS = WORDS + FORMS
#: Labelled rows of each class at most.
SAMPLE_PER_CLASS = 6000
HIDDEN, EPOCHS, BATCH, RATE, MOMENTUM, DECAY, SEED = 32, 40, 64, 0.05, 0.9, 1e-4, 20250311
#: Occurrences that every unit is taken to have besides its own, without contexts.
DRAWN = 1.0
U = np.uint64
#: Kinds of characters: other bytes than these stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
#: Hashes of the contexts that are no units: repeats the word before, or the one before that.
_REPEATS = _words.mix(np.array([0xA1, 0xA2], np.uint64))
#: Words looked at together when vectors are pooled.
_CHUNK = 1 << 15


def places(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index vectors of hashes: places, and the signs there."""
    for k in range(2):
        yield (hashes >> U(7 * k) & U(PLACES - 1)).astype(np.int64), 1 - 2 * (hashes >> U(7 * k + 6) & U(1)).astype(np.int64)


class Texts:
    """The words of a batch of texts: number, form and text of each, with hashes by number and by form."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        begin, end, at = _words.word_spans(data, starts, ends)
        self.counts = np.diff(at)
        self.text = np.repeat(np.arange(len(starts)), self.counts)
        self.word = _words.word_ids(data, begin, end).astype(np.int64)
        n = int(self.word.max()) + 1 if len(self.word) else 0
        first = np.zeros(n, np.int64)
        first[self.word[::-1]] = np.arange(len(self.word))[::-1]  # numbers go by first occurrence, so these ascend
        self.hash = _words.segment_hashes(data, begin[first], end[first])
        self.form_of, self.form_hash = self._forms(data, begin[first], end[first])

    def _forms(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The form of each distinct word, and the hash of each form."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        kind = _KIND[data[int(begin[0]) : int(end[-1])]]
        edge = np.zeros(len(kind) + 1, np.int8)
        edge[begin - begin[0]] += 1
        edge[end - begin[0]] -= 1
        keep = np.cumsum(edge[:-1], dtype=np.int8).astype(np.bool_)
        same = np.zeros(len(kind), np.bool_)
        same[1:] = kind[1:] == kind[:-1]
        same[begin - begin[0]] = False
        keep &= ~same
        total = np.r_[np.zeros(1, np.int64), np.cumsum(keep)]
        hashes = _words.segment_hashes(kind[keep], total[begin - begin[0]], total[end - begin[0]])
        forms, of = np.unique(hashes, return_inverse=True)
        return of.astype(np.int64), _words.mix(forms ^ U(0xF0F0))

    def repeats(self, back: int) -> np.ndarray:
        """Whether a word equals the one `back` places before, in the same text."""
        out = np.zeros(len(self.word), np.bool_)
        out[back:] = (self.word[back:] == self.word[:-back]) & (self.text[back:] == self.text[:-back])
        return out

    def neighbours(self) -> np.ndarray:
        """Positions whose next word is in the same text."""
        return np.flatnonzero(self.text[1:] == self.text[:-1])

    def word_rows(self) -> np.ndarray:
        """The table's row of each distinct word."""
        return (self.hash >> U(20) & U(WORDS - 1)).astype(np.int64)

    def form_rows(self) -> np.ndarray:
        return WORDS + (self.form_hash >> U(20) & U(FORMS - 1)).astype(np.int64)


def _counted(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each comes."""
    if below > 1 << 22:
        return np.unique(keys, return_counts=True)
    times = np.bincount(keys, minlength=below)
    some = np.flatnonzero(times)
    return some, times[some]


def contexts(texts: Texts, into: np.ndarray) -> None:
    """Add the index vectors of all contexts to the table `into`: UNITS x (PLACES + 1), occurrences last."""
    if not len(texts.word):
        return
    rows, n = texts.word_rows(), len(texts.hash)
    left = texts.neighbours()
    flat = into.reshape(-1)
    width = PLACES + 1

    def add(row: np.ndarray, hashes: np.ndarray, times: np.ndarray | None = None) -> None:
        for place, sign in places(hashes):
            if times is None:  # of every word
                flat[:] += np.bincount(row * width + place, sign, len(flat)).astype(np.int64)
            else:
                np.add.at(flat, row * width + place, sign * times)

    a, b = texts.word[left], texts.word[left + 1]
    add(rows[a], texts.hash[b])
    add(rows[b], texts.hash[a])
    times = np.bincount(texts.word, minlength=n)
    into[:, PLACES] += np.bincount(rows, times, UNITS).astype(np.int64)
    add(rows, texts.form_hash[texts.form_of], times)
    form, f_rows, f = texts.form_of, texts.form_rows(), len(texts.form_hash)
    into[:, PLACES] += np.bincount(f_rows, np.bincount(form, times, f), UNITS).astype(np.int64)
    pairs, together = _counted(form[a] * f + form[b], f * f)
    add(f_rows[pairs // f], texts.form_hash[pairs % f], together)
    add(f_rows[pairs % f], texts.form_hash[pairs // f], together)
    for back, mark in zip((1, 2), _REPEATS):
        again = np.bincount(texts.word[texts.repeats(back)], minlength=n)
        some = np.flatnonzero(again)
        marks = np.full(len(some), mark)
        add(rows[some], marks, again[some])
        add(f_rows[form[some]], marks, again[some])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all units, from every text: UNITS x PLACES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((UNITS, PLACES + 1), np.int64)
        for batch in batches:
            data, starts, ends = strings(batch.column(0))
            for i, j in slices(starts, ends, 8 << 20):
                contexts(Texts(data, starts[i:j], ends[i:j]), table)
        met = np.flatnonzero(table[:, PLACES])
        for i in range(0, len(met), 1 << 12):
            part = met[i : i + (1 << 12)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(table[part, k]) for k in range(PLACES + 1)]], names=["unit", *names])

    names = [f"p{k}" for k in range(PLACES + 1)]
    sums = small_batches(docs.select(text_col)).mapInArrow(lean(run), "unit int, " + ", ".join(f"{x} bigint" for x in names))
    got = sums.groupBy("unit").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # UNITS rows at most
    out = np.zeros((UNITS, PLACES))
    if got.num_rows:
        unit = np.asarray(got["unit"])
        out[unit] = np.stack([np.asarray(got[x]) for x in names[:-1]], 1) / (np.asarray(got[names[-1]]) + DRAWN)[:, None]
    return out.astype(np.float32)


def pooled(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: means of its words' vectors, its forms' vectors, and its own contexts' index vectors."""
    n = len(texts.counts)
    out = np.zeros((n, 3 * PLACES), np.float64)
    if not len(texts.word):
        return out
    rows = texts.word_rows()[texts.word]
    for i in range(0, len(rows), _CHUNK):
        owner = texts.text[i : i + _CHUNK]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first], :PLACES] += np.add.reduceat(vectors[rows[i : i + _CHUNK]], first, dtype=np.float64)
    form, f = texts.form_of[texts.word], len(texts.form_hash)
    pairs, times = _counted(texts.text * f + form, n * f)
    owner, of = pairs // f, pairs % f
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    f_vectors = vectors[texts.form_rows()]
    for i in range(0, len(pairs), _CHUNK):
        own = owner[i : i + _CHUNK]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first], PLACES : 2 * PLACES] += np.add.reduceat(f_vectors[of[i : i + _CHUNK]] * times[i : i + _CHUNK, None], first)
    own = np.zeros(n * PLACES)
    for place, sign in places(texts.form_hash):
        own += np.bincount(owner * PLACES + place[of], sign[of] * times, n * PLACES)
    for back, mark in zip((1, 2), _REPEATS):
        again = np.bincount(texts.text[texts.repeats(back)], minlength=n)
        for place, sign in places(mark[None]):
            own.reshape(n, PLACES)[:, int(place[0])] += again * int(sign[0])
    out[:, 2 * PLACES :] = own.reshape(n, PLACES)
    return out / np.maximum(texts.counts, 1)[:, None]


@dataclass
class Model:
    vectors: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    first: np.ndarray  # inputs x HIDDEN
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def constant(vectors: np.ndarray, ones: int, rows: int) -> Model:
    """The model of labels that are all alike."""
    share, size = (ones + 1) / (rows + 2), 3 * PLACES
    return Model(vectors, np.zeros(size), np.ones(size), np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))


def gradients(x: np.ndarray, y: np.ndarray, weight: np.ndarray, first: np.ndarray, first_bias: np.ndarray, second: np.ndarray, second_bias: float) -> tuple:
    """Of the weighted mean cross entropy, by first, first_bias, second, second_bias."""
    hidden = np.tanh(x @ first + first_bias)
    z = hidden @ second + second_bias
    error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight / len(y)
    back = error[:, None] * second * (1 - hidden**2)
    return x.T @ back, back.sum(0), hidden.T @ error, error.sum()


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, shares: tuple[float, float], seed: int = SEED) -> Model:
    """Fit on pooled rows x with labels y; shares are those of the classes among all labelled rows."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return constant(vectors, int(y.sum()), len(y))
    place = np.zeros(len(y), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        place[own] = np.arange(len(own))
    fit, tune = np.flatnonzero(place % 4 != 3), np.flatnonzero(place % 4 == 3)
    weight = np.where(y == 1, shares[1] / max(1e-9, y.mean()), shares[0] / max(1e-9, 1 - y.mean()))
    model = constant(vectors, 0, 0)
    model.middle, scale = x[fit].mean(0), x[fit].std(0)
    model.scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0]
    speed = [0.0 * np.asarray(p) for p in parts]
    z = (x - model.middle) / model.scale
    epochs = max(EPOCHS, -(-600 * BATCH // len(fit)))  # few rows are seen more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            for k, g in enumerate(gradients(z[rows], y[rows], weight[rows], *parts)):
                decay = DECAY * parts[k] if k in (0, 2) else 0.0
                speed[k] = MOMENTUM * speed[k] - rate * (g + decay)
                parts[k] = parts[k] + speed[k]
    model.first, model.first_bias, model.second, model.second_bias = parts[0], parts[1], parts[2], float(parts[3])
    if len(tune):
        logits, truth, w = model.logits(x[tune]), y[tune], weight[tune]

        def loss(t: float) -> float:
            m = logits / t * (2 * truth - 1)
            return float((w * np.logaddexp(0, -m)).mean())

        model.temperature = float(min(np.geomspace(0.1, 20, 80), key=loss))
    return model


def sample(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, label_col: str, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """(pooled rows, labels, shares of the classes) of at most per_class labelled rows a class.

    Labels are drawn by a hash of their id before any text is met; they are 2 * per_class at most
    but for chance, so they travel to the texts and not the texts to them.
    """
    level = F.pmod(F.xxhash64(F.lit(SEED), F.col("i")), F.lit(1 << 30))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).distinct().withColumn("level", level)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return np.zeros((0, 3 * PLACES)), np.zeros(0), (0.5, 0.5)
    cut = F.lit(None)
    for y, n in sizes.items():
        cut = F.when(F.col("y") == y, F.lit(int(min(1.0, (1.05 * per_class + 50) / n) * (1 << 30)))).otherwise(cut)
    drawn = known.where(F.col("level") < cut)
    met = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(drawn), "i").select("i", "y", "level", "t")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = strings(batch.column(3))
            for i, j in slices(starts, ends, 8 << 20):
                x = pooled(Texts(data, starts[i:j], ends[i:j]), held.value)
                tie = _words.segment_hashes(data, starts[i:j], ends[i:j]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], batch.column(2)[i:j], pa.array(tie), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "level", "tie", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(met).mapInArrow(lean(run), f"i {kind}, y int, level bigint, tie bigint, x array<double>")
    got = rows.groupBy("i", "y", "level").agg(F.min_by("x", "tie").alias("x")).toArrow().sort_by([("y", "ascending"), ("level", "ascending"), ("i", "ascending")])
    y = np.asarray(got["y"])
    keep = np.concatenate([np.flatnonzero(y == c)[:per_class] for c in (0, 1)])
    x = np.array(got["x"].to_pylist(), np.float64).reshape(len(y), 3 * PLACES)
    n = sum(sizes.values())
    return x[keep], y[keep], (sizes.get(0, 0) / n, sizes.get(1, 0) / n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    vectors = word_vectors(docs, text_col)
    return train(vectors, *sample(docs, labels, vectors, id_col, text_col, label_col, per_class))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; rows are independent: no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the table and the network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            data, starts, ends = strings(batch.column(1))
            for i, j in slices(starts, ends, 8 << 20):
                score = own.scores(pooled(Texts(data, starts[i:j], ends[i:j]), own.vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(score, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs.select(id_col, text_col)).mapInArrow(lean(run), f"{id_col} {kind}, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The rows whose labels are never learned: crc32 of the id as text, modulo 5, is 0; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
