"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed subwords (character n-grams inside
words, with word boundaries); a linear softmax on the average gives the classes. Both are
trained together by stochastic gradient descent in numpy, on a bounded stratified sample of
labelled rows. Sample rows that the descent does not see calibrate: a temperature makes scores
probabilities, so that one under 1 - COST is more likely wrong than right and is rejected. But
a softmax over the learned languages is sure of anything, so besides a share of subwords that no
training row holds, far over those of right rows, rejects a text: other scripts, other
languages, letters at random. Short texts are drawn towards the mean share, so that one odd
word rejects nothing.

Because average and classifier are linear, prediction folds them into one score row per
bucket, so that a text of any length costs one table look-up per subword.

Defined results: null text, and text without a letter, is `und` with score 0 and rejected;
without any learned language everything is `und`. Ties go to the first language by name. A
row without an id is predicted, counts as not held out, and is not learned from.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean, small_batches, trim

#: Buckets of the hashed subwords.
BUCKETS = 1 << 17
#: Character n-gram orders inside words.
ORDERS = (1, 2, 3)
#: Labelled rows used for each language (the rows with the smallest hashes), three quarters for training.
SAMPLE_PER_LANGUAGE = 600
#: What a rejected right prediction costs, an accepted wrong one being 1.
COST = 0.5
#: The limit of unseen subwords lies beyond this share of right calibration rows, by MARGIN times
#: its distance from their median; never under LEAST_STRANGE, as rows of one corpus are much alike.
REJECTED_RIGHT, MARGIN, LEAST_STRANGE = 0.01, 2.0, 0.15
#: Subwords of the mean share that each text is taken to have besides its own.
DRAWN = 40
DIMENSION, EPOCHS, BATCH, RATE, SEED = 16, 8, 32, 2.0, 20240917
#: An embedding is touched by few rows, so it moves by so much more.
EMBEDDING_RATE = 20
#: Descent steps at the least: few labelled rows are seen more often.
STEPS = 300
_M = np.uint64(0x9E3779B97F4A7C15)
UND = "und"


def _letters() -> np.ndarray:
    """Which code points are letters (a table over all of them), by Python's Unicode data."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(_letters())
    return _LETTER[0]


def _lower() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x2000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


_LOWER: list[np.ndarray] = []


def subwords(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, index of the text it is in); non-letters are one boundary mark."""
    if not _LOWER:
        _LOWER.append(_lower())
    points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = letter_table()[points]
    mark = np.where(letter, _LOWER[0][points], np.uint32(0))
    # a run of non-letters is one mark: keep letters, each text's start, and the first non-letter after a letter
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.cumsum(sizes) - sizes] = True
    mark, owner, letter = mark[keep].astype(np.uint64), owner[keep], letter[keep]
    found, owners = [], []
    for n in ORDERS:
        m = len(mark) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n), np.uint64)
        for j in range(n):
            h = (h ^ mark[j : j + m]) * _M
            h ^= h >> np.uint64(29)
        # inside one text, and only where a mark stands at an end of the n-gram
        good = owner[:m] == owner[n - 1 :]
        if n == 1:
            good &= letter
        elif n > 2:
            for j in range(1, n - 1):
                good &= letter[j : j + m]
        found.append((h[good] >> np.uint64(20)).astype(np.int64) & (buckets - 1))
        owners.append(owner[:m][good])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: folded embeddings and classifier
    bias: np.ndarray
    temperature: float
    threshold: float  # the least accepted score
    seen: np.ndarray  # buckets that training rows hold
    unseen_mean: float = 0.0
    unseen_most: float = 1.0  # the largest accepted share of other buckets

    def unseen(self, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Share of subwords in buckets not seen, DRAWN towards the mean."""
        return (others + DRAWN * self.unseen_mean) / (counts + DRAWN)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected, share of unseen subwords) of each text."""
        n, k = len(texts), len(self.languages)
        names, best, rejected = [UND] * n, np.zeros(n), np.ones(n, np.bool_)
        if not k:
            return names, best, rejected, np.ones(n)
        sums, counts, others = np.zeros((n, k)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        i = 0
        while i < n:  # a bounded number of characters at a time; one text may be longer
            j, size = i, 0
            while j < n and (j == i or size + len(texts[j] or "") <= 1 << 18):
                size += len(texts[j] or "")
                j += 1
            self._add([t or "" for t in texts[i:j]], sums[i:j], counts[i:j], others[i:j])
            i = j
        has = counts > 0
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top = p.argmax(1)
        for x in np.flatnonzero(has):
            names[x] = self.languages[top[x]]
        best[has] = p[has, top[has]]
        strange = self.unseen(counts, others)
        rejected = ~has | (best < self.threshold) | (strange > self.unseen_most)
        return names, best, rejected, strange

    def _add(self, texts: list[str], sums: np.ndarray, counts: np.ndarray, others: np.ndarray) -> None:
        limit = 1 << 20
        if len(texts) == 1 and len(texts[0]) > limit:
            # a very long text in pieces that end at a character that is no letter
            text, at, parts = texts[0], 0, []
            while at < len(text):
                end = min(len(text), at + limit)
                while end < len(text) and text[end - 1].isalpha() and end - at < 2 * limit:
                    end += 1
                parts.append(text[at:end])
                at = end
            for part in parts:
                self._add_one([part], sums, counts, others)
        else:
            self._add_one(texts, sums, counts, others)

    def _add_one(self, texts: list[str], sums: np.ndarray, counts: np.ndarray, others: np.ndarray) -> None:
        bucket, owner = subwords(texts, len(self.scores))
        if not len(bucket):
            return
        for c in range(len(self.languages)):
            sums[:, c] += np.bincount(owner, self.scores[bucket, c], len(texts))
        counts += np.bincount(owner, minlength=len(texts))
        others += np.bincount(owner[~self.seen[bucket]], minlength=len(texts))


def gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the mean cross entropy of (buckets, counts) rows: (buckets, their rows' gradients, out's, bias's)."""
    idx = np.concatenate([b for b, _ in rows])
    weight = np.concatenate([c / c.sum() for _, c in rows])
    sizes = np.array([len(b) for b, _ in rows])
    hidden = np.add.reduceat(emb[idx] * weight[:, None], np.cumsum(sizes) - sizes)
    z = hidden @ out + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(rows)), y] -= 1
    p /= len(rows)
    back = (p @ out.T)[np.repeat(np.arange(len(rows)), sizes)]
    order = np.argsort(idx, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(idx[order]) > 0])
    return idx[order[first]], np.add.reduceat((weight[:, None] * back)[order], first), hidden.T @ p, p.sum(0)


def _beyond(values: np.ndarray, share: float) -> float:
    """A limit past the quantile `share` of values, on its side of the median."""
    middle, edge = np.quantile(values, [0.5, share])
    return float(middle + MARGIN * (edge - middle))


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], buckets: int = BUCKETS, seed: int = SEED) -> Model:
    """Fit on (buckets, counts) rows; every fourth row of each language calibrates instead."""
    languages = sorted(set(labels))
    k = len(languages)
    if not k:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0, np.zeros(buckets, np.bool_))
    y = np.array([languages.index(x) for x in labels])
    place = np.zeros(len(y), np.int64)
    for c in range(k):
        own = np.flatnonzero(y == c)
        place[own] = np.arange(len(own))
    fit, tune = np.flatnonzero(place % 4 != 3), np.flatnonzero(place % 4 == 3)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets, DIMENSION))
    out, bias = np.zeros((DIMENSION, k)), np.zeros(k)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(fit))) if len(fit) else 0)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            idx, of_emb, of_out, of_bias = gradients(emb, out, bias, [features[r] for r in rows], y[rows])
            out -= rate * of_out
            bias -= rate * of_bias
            emb[idx] -= rate * EMBEDDING_RATE * of_emb
    seen = np.zeros(buckets, np.bool_)
    for r in fit:
        seen[features[r][0]] = True
    emb[~seen] = 0  # says nothing of any language
    model = Model(languages, emb @ out, bias, 1.0, 0.0, seen)
    if not len(tune):
        return model
    logits = np.stack([(model.scores[b] * (c / c.sum())[:, None]).sum(0) + bias for b, c in (features[r] for r in tune)])
    truth = y[tune]

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

    model.threshold = 1 - COST
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    z = logits / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == truth
    if right.any():
        counts = np.array([features[r][1].sum() for r in tune])[right]
        others = np.array([features[r][1][~seen[features[r][0]]].sum() for r in tune])[right]
        model.unseen_mean = float(others.sum() / counts.sum())
        model.unseen_most = max(LEAST_STRANGE, _beyond(model.unseen(counts, others), 1 - REJECTED_RIGHT))
    return model


def sample_features(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list, list]:
    """Hashed counts of the per_language rows of each language whose id hashes are smallest.

    The threshold hash of each language comes from a grouped, bounded histogram, so no task
    sorts a language; what reaches the driver is per_language sparse rows for each language.
    They come as bytes, 8 for a bucket and its count: as lists each number would be an object,
    in the driver's JVM and again in its Python.
    """
    level = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1 << 30))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), level.alias("h"))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return [], []
    # at twice the wanted share a language has enough rows but for chance; the order settles the rest
    cut = F.lit(None)
    for r in sizes:
        share = min(1.0, (2.0 * per_language + 50) / r["n"])
        cut = F.when(F.col("l") == r["l"], F.lit(int(share * (1 << 30)))).otherwise(cut)
    near = small_batches(rows).where(F.col("h") < cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                b, _ = subwords([text])
                u, c = np.unique(b, return_counts=True)
                out.append((u.astype(">i4").tobytes(), c.astype(">i4").tobytes()))  # these bytes sort as the numbers do
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["i", "l", "h", "b", "c"])

    kept = near.mapInArrow(lean(run), f"i {labelled.schema[id_col].dataType.simpleString()}, l string, h bigint, b binary, c binary").where(F.length("b") > 0)
    # rows that tie in language, hash and id differ in their subwords, or are alike
    got = sorted(kept.collect(), key=lambda r: (r["l"], r["h"], r["i"], r["b"], r["c"]))
    features, labels, seen = [], [], {}
    for r in got:
        seen[r["l"]] = seen.get(r["l"], 0) + 1
        if seen[r["l"]] <= per_language:
            features.append((np.frombuffer(r["b"], ">i4").astype(np.int32), np.frombuffer(r["c"], ">i4").astype(np.int32)))
            labels.append(r["l"])
    return features, labels


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, **columns: str) -> Model:
    model = train(*sample_features(labelled, per_language, **columns))
    trim()
    return model


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that few texts at a time are Python strings."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected, unseen) of every whole text; rows are independent: no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in _small(batches):
            names, score, rejected, strange = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(strange, pa.float64())], names=[id_col, "lang_pred", "score", "rejected", "unseen"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, lang_pred string, score double, rejected boolean, unseen double")


def held_out(id_col: str = "doc_id"):
    """The rows that are never learned from: crc32 of the id as text, modulo 4, is 2; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def in_training(id_col: str = "doc_id"):
    """The rows that may be learned from."""
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose prediction is not rejected; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in _small(batches):
            rejected = own.predict(batch.column(text_col).to_pylist())[2]
            yield batch.filter(pa.array(~rejected))

    return small_batches(docs).mapInArrow(lean(run), docs.schema)
