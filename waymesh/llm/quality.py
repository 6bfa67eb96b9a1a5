"""Quality rules as a short-circuit cascade.

A rule computes one measure of a batch of texts and fails those beyond its limit. On a bounded
sample each rule's cost (seconds a text) and rejection rate are estimated; rules are then run
in the order of rejections per second, each only on texts that no earlier rule has failed. The
order changes what the cascade costs, never its verdict: a text is kept iff no rule fails it.
A measure that several rules need, or that is asked for as well, is computed once for a text.

Defined results: null text and text without words has all measures 0; such a text fails the
word-count rule. Rules with a share of nothing (no words, no lines) do not fail a text.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._shared import lean, slices, small_batches, strings

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000
_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[list(b"#*$%&|<>")] = True
#: UTF-8 continuation bytes do not begin a code point.
_BEGINS = (np.arange(256) & 0xC0) != 0x80


class Texts:
    """A batch of UTF-8 texts, or some of another one's; each measure of a text is computed once."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: Texts | None = None, rows: np.ndarray | None = None) -> None:
        self.data, self.starts, self.ends = data, starts, ends
        self._spans = self._words = None
        self.whole, self.rows = (self, np.arange(len(starts))) if whole is None else (whole, rows)
        #: In the whole batch: by measure, its values and the texts that it is known of.
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, rows: np.ndarray) -> Texts:
        """The texts of the given rows, bytes copied so that they adjoin."""
        parts = [self.data[self.starts[r] : self.ends[r]] for r in rows]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return Texts(data, ends - np.array([len(p) for p in parts], np.int64), ends, self.whole, self.rows[rows])

    def measure(self, f: Callable[[Texts], np.ndarray]) -> np.ndarray:
        """f of each text, computed only where no rule has asked for it before."""
        values, known = self.whole.known.setdefault(f.__name__, (np.zeros(len(self.whole), np.int64), np.zeros(len(self.whole), np.bool_)))
        missing = np.flatnonzero(~known[self.rows])
        if len(missing):
            values[self.rows[missing]] = f(self if len(missing) == len(self) else self.take(missing))
            known[self.rows[missing]] = True
        return values[self.rows]

    def spans(self):
        if self._spans is None:
            self._spans = _words.word_spans(self.data, self.starts, self.ends)
        return self._spans

    def words(self) -> np.ndarray:
        if self._words is None:
            begin, end, _ = self.spans()
            self._words = _words.mix(_words.word_ids(self.data, begin, end))  # one to one
        return self._words


def _per_row(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    return total[at[1:]] - total[at[:-1]]


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.spans()[2])


def word_chars(t: Texts) -> np.ndarray:
    if not len(t):
        return np.zeros(0, np.int64)
    a, b = int(t.starts[0]), int(t.ends.max())
    part = t.data[a:b]
    total = _sums(_BEGINS[part] & ~_words._SEPARATOR[part])
    return total[t.ends - a] - total[t.starts - a]


def n_symbols(t: Texts) -> np.ndarray:
    if not len(t):
        return np.zeros(0, np.int64)
    a, b = int(t.starts[0]), int(t.ends.max())
    total = _sums(_SYMBOL[t.data[a:b]])
    return total[t.ends - a] - total[t.starts - a]


def _again(owner: np.ndarray, key: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an earlier equal (owner, key), has any other equal one) for each element.

    parts, if given, are what key is a hash of: elements are equal only if all of these are.
    """
    n = len(key)
    both = _words.mix(key ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(both, kind="stable")
    same = np.zeros(n, np.bool_)
    if n > 1:
        alike = both[order[1:]] == both[order[:-1]]
        same[1:] = alike & (owner[order[1:]] == owner[order[:-1]])
        for part in parts:
            same[1:] &= part[order[1:]] == part[order[:-1]]
        if (same[1:] != alike).any():  # a hash of different elements: they may stand between equal ones
            order = np.lexsort((*parts[::-1], key, owner))
            same[1:] = (owner[order[1:]] == owner[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
            for part in parts:
                same[1:] &= part[order[1:]] == part[order[:-1]]
    later = np.zeros(n, np.bool_)
    later[order] = same
    shared = same.copy()
    shared[:-1] |= same[1:]
    every = np.zeros(n, np.bool_)
    every[order] = shared
    return later, every


def line_spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the lines of every text, split at \\n."""
    if not len(t):
        z = np.zeros(0, np.int64)
        return z, z, z
    a, b = int(t.starts[0]), int(t.ends.max())
    breaks = np.flatnonzero(t.data[a:b] == 10) + a
    owner = np.searchsorted(t.starts, breaks, side="right") - 1
    # an empty row shares its start with the next one: the last of them owns the byte
    begins = np.concatenate([t.starts, breaks + 1])
    rows = np.concatenate([np.arange(len(t)), owner])
    order = np.lexsort((begins, rows))
    begins, rows = begins[order], rows[order]
    ends = np.empty_like(begins)
    ends[:-1] = np.where(rows[:-1] == rows[1:], begins[1:] - 1, t.ends[rows[:-1]])
    ends[-1:] = t.ends[rows[-1:]]
    return begins, ends, rows


def lines_with_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begins, ends, rows = line_spans(t)
    if not len(begins):
        return begins, ends, rows
    a, b = int(t.starts[0]), int(t.ends.max())
    total = _sums(~_words._SEPARATOR[t.data[a:b]])
    good = total[ends - a] > total[begins - a]
    return begins[good], ends[good], rows[good]


def n_dup_lines(t: Texts) -> np.ndarray:
    begins, ends, rows = lines_with_words(t)
    full = ends > begins
    ids = np.zeros(len(rows), np.uint64)
    ids[full] = _words.word_ids(t.data, begins[full], ends[full])
    later, _ = _again(rows, ids)
    return np.bincount(rows[later], minlength=len(t)).astype(np.int64)


def n_lines(t: Texts) -> np.ndarray:
    return np.bincount(lines_with_words(t)[2], minlength=len(t)).astype(np.int64)


def n_repeat_words(t: Texts, size: int = 5) -> np.ndarray:
    at = t.spans()[2]
    words = t.words()
    windows = _words.window_hashes(words, size)
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(t)), counts)
    inside = owner[: len(windows)] == owner[size - 1 :] if len(windows) else np.zeros(0, np.bool_)
    at_window = np.flatnonzero(inside)
    _, every = _again(owner[at_window], windows[at_window], *(words[at_window + k] for k in range(size)))
    edge = np.zeros(len(words) + 1, np.int64)
    hit = at_window[every]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return _per_row(_sums(covered), at)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Texts], np.ndarray]


def default_rules() -> list[Rule]:
    """The base rules, and limits that only texts far from prose reach."""
    return [
        Rule("few_words", lambda t: t.measure(n_words) < 10),
        Rule("repeated_windows", lambda t: 100 * t.measure(n_repeat_words) > 20 * t.measure(n_words)),
        # a symbol for each fifth character of words, or more
        Rule("symbols", lambda t: (5 * t.measure(n_symbols) > t.measure(word_chars)) & (t.measure(n_words) > 0)),
        # mean word of under two or over forty characters
        Rule("word_length", lambda t: (t.measure(word_chars) < 2 * t.measure(n_words)) | (t.measure(word_chars) > 40 * t.measure(n_words))),
        # more than half of the lines repeat an earlier one
        Rule("repeated_lines", lambda t: 2 * t.measure(n_dup_lines) > t.measure(n_lines)),
    ]


def cascade(texts: Texts, rules: list[Rule]) -> np.ndarray:
    """Index of the first failing rule of each text, -1 where none fails."""
    first = np.full(len(texts), -1, np.int64)
    rows, current = np.arange(len(texts)), texts
    for k, rule in enumerate(rules):
        open_ = first[rows] < 0
        if not open_.any():
            break
        if open_.mean() < 0.75:  # copying the open texts pays only when enough are settled
            rows = rows[open_]
            current, open_ = current.take(np.flatnonzero(open_)), np.ones(len(rows), np.bool_)
        bad = rule.fails(current) & open_
        first[rows[bad]] = k
    return first


def estimate(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share it fails) measured on at most `rows` texts, those of a seeded share of the ids."""
    every = max(1, docs.count() // (2 * rows))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(every)) == 0).select(F.col(text_col).alias("t")).limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, failed, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            data, starts, ends = strings(batch.column(0))
            for i, j in slices(starts, ends):
                seen += j - i
                for k, rule in enumerate(rules):
                    texts = Texts(data, starts[i:j], ends[i:j])  # nothing shared: each rule pays for itself
                    began = time.perf_counter()
                    failed[k] += int(rule.fails(texts).sum())
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent), pa.array(failed), pa.array([seen] * len(rules), pa.int64())], names=["rule", "spent", "failed", "seen"])

    got = sample.mapInArrow(lean(run), "rule string, spent double, failed bigint, seen bigint").groupBy("rule").agg(F.sum("spent").alias("s"), F.sum("failed").alias("f"), F.sum("seen").alias("n")).collect()
    by = {r["rule"]: r for r in got}
    return [(r.name, by[r.name]["s"] / max(1, by[r.name]["n"]), by[r.name]["f"] / max(1, by[r.name]["n"])) if r.name in by else (r.name, 0.0, 0.0) for r in rules]


def ordered(rules: list[Rule], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; ties by name."""
    gain = {name: share / max(cost, 1e-9) for name, cost, share in measured}
    return sorted(rules, key=lambda r: (-gain.get(r.name, 0.0), r.name))


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", measures: bool = False) -> DataFrame:
    """(id, kept, failed_rule) of every text; measures adds the measures of rules' texts.

    failed_rule is the first failing rule in the estimated order, null for kept texts. Rows
    are independent: no shuffle. Other columns are not read.
    """
    rules = default_rules() if rules is None else rules
    rules = ordered(rules, estimate(docs, rules, id_col, text_col))
    names = [r.name for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = strings(batch.column(1))
            for i, j in slices(starts, ends):
                texts = Texts(data, starts[i:j], ends[i:j])
                first = cascade(texts, rules)
                columns = [batch.column(0)[i:j], pa.array(first < 0, pa.bool_()), pa.array([names[k] if k >= 0 else None for k in first], pa.string())]
                out = ["id", "kept", "failed_rule"]
                if measures:
                    for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words):
                        columns.append(pa.array(texts.measure(f), pa.int64()))
                        out.append(f.__name__)
                yield pa.RecordBatch.from_arrays(columns, names=out)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint" if measures else ""
    return small_batches(docs).select(F.col(id_col).alias("id"), text_col).mapInArrow(lean(run), f"id {kind}, kept boolean, failed_rule string{more}").withColumnRenamed("id", id_col)
