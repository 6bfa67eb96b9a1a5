"""Phrases whose words occur together more often than their parts explain, per group of documents.

Counting is done in shards, a few MB of texts each, by a generalised suffix automaton cut at the
depth of the longest phrase. Its states are the classes of phrases that end at the same places;
they are the nodes of the tree of reversed contexts, so one sort of (word, word before, ...)
keys builds them: a run of equal keys is a node, a node with the count of its parent is the
parent's state, and the parent of a state's shortest phrase is its suffix link. Every state
yields the phrases from its shortest to its longest with one count.

1. Words and pairs: every shard gives hashes with counts, packed by ranges of the hash whose
   number grows with the text; hashes whose sum reaches the least count are put into a bitmap of
   fixed size.
2. Every shard gives, in words, the phrases that may reach the least count: those in the bitmap,
   and longer ones whose first part is in it and whose suffix link leads to one that is. Their
   counts are summed by words, so they are exact whatever the hashes; those of hashes only leave
   phrases out that are too rare. Where the bitmap is full it leaves out less, and the result is the same.
3. Parts are looked up, candidates scored at each cut in exact decimals, and phrases inside a
   longer one dropped: a longer phrase reports its count to its suffix and its prefix.
4. The best of each group are found in rounds, so that no task sorts a group.

Memory of a task: one shard, and the bitmap (8 MB).

Defined results: null texts have no words; a null group is `und`; repeated rows count each time;
an empty table has no rows. Other columns are not read. Texts are split by bytes: only A-Z are
lower-cased. Counts are exact up to 10^16 occurrences of a phrase.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words
from ._shared import lean, small_batches, stash, strings, unstash

UND = "und"
#: Most words of a phrase, and fewest occurrences.
LONGEST, LEAST = 3, 10
#: Bytes of texts in a shard; one longer text is a shard of its own.
SHARD = 6 << 20
#: Bytes of text for each range of hashes.
RANGE_BYTES = 16 << 20
#: Bits of the bitmap of frequent phrases, and of a page of it.
BITS, PAGE_BITS = 1 << 26, 1 << 15
#: A phrase that makes up this share of all words, of which there are at most as many, is hot.
HOT = 10_000
U = np.uint64
_BREAK, _SPACE = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_KIND[list(b" \t")] = _SPACE


class Shard:
    """Words of some texts as numbers, in order, with where pieces begin."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> None:
        a, b = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
        data = _words.LOWER[data[a:b]]
        kind = _KIND[data]
        word = kind == 0
        # texts adjoin: each begins and ends words
        full = ends > starts
        edge = np.zeros(len(data) + 1, np.bool_)
        edge[starts[full] - a] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        begin = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        end = np.flatnonzero(last) + 1
        breaks = np.cumsum(kind == _BREAK, dtype=np.int32)
        text = np.searchsorted(starts[full] - a, begin, side="right") - 1
        self.group = group[full][text] if len(begin) else np.zeros(0, np.int64)
        #: The word before it, in the same piece, exists.
        self.joined = np.zeros(len(begin), np.bool_)
        if len(begin):
            self.joined[1:] = (breaks[begin[1:]] == breaks[begin[:-1]]) & (text[1:] == text[:-1])
        self.names = self._named(data, begin, end)
        del data, kind, word, first, last, breaks, edge
        self._tell_apart()

    def _named(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        size = end - begin
        mask = np.zeros(len(data) + 1, np.int8)
        mask[begin] += 1
        mask[end] -= 1
        packed = data[np.cumsum(mask[:-1], dtype=np.int8).astype(np.bool_)]
        offsets = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        self.number = np.asarray(coded.indices).astype(np.int64)
        return coded.dictionary

    def _tell_apart(self) -> None:
        """Numbers from 1 on that differ between groups; name and group of each."""
        n = len(self.names)
        both, self.number = np.unique(self.group * max(n, 1) + self.number, return_inverse=True)
        self.number = self.number.astype(np.int32) + np.int32(1)
        self.name, self.of = both % max(n, 1), both // max(n, 1)
        data, starts, ends = strings(self.names)
        self.hash = _words.segment_hashes(data, starts, ends)[self.name] if n else np.zeros(0, np.uint64)


class Automaton:
    """States of the suffix automaton of a shard's pieces, for phrases of at most `depth` words.

    shortest, longest: lengths of a state's phrases; count: places they end at; at: one of these
    (a word's position); link: the state of the longest phrase that ends at more places, -1 if none.
    """

    def __init__(self, shard: Shard, depth: int) -> None:
        n, words, open_ = len(shard.number), [shard.number], np.ones(len(shard.number), np.bool_)
        for d in range(1, depth):  # the word d places before, or 0 beyond the piece
            joined = np.zeros(n, np.bool_)
            joined[d - 1 :] = shard.joined[: n - d + 1] if n >= d else False
            open_ = open_ & joined
            before = np.zeros(n, np.int32)
            before[d:] = shard.number[:-d] if n > d else 0
            words.append(np.where(open_, before, 0))
        bits = 64 // depth
        if n and int(shard.number.max()) < 1 << bits:
            key = np.zeros(n, np.uint64)
            for w in words:
                key = key << U(bits) | w.astype(np.uint64)
            order = np.argsort(key)
            del key
        else:
            order = np.lexsort(words[::-1])
        new = np.ones(n, np.bool_)
        new[1:] = False
        at, count, shortest, longest, link = [], [], [], [], []
        above, base = np.full(n, -1, np.int64), 0
        for d in range(1, depth + 1):
            word = words[d - 1][order]
            new[1:] |= word[1:] != word[:-1]
            first = np.flatnonzero(new)
            sizes = np.diff(np.r_[first, n])
            real = word[first] != 0  # the d words are in one piece
            parent = above[first]
            total = np.concatenate(count) if count else np.zeros(0, np.int64)
            same = real & (parent >= 0)
            same[same] = total[parent[same]] == sizes[same]
            fresh = real & ~same
            state = np.where(same, parent, -1)
            state[fresh] = base + np.arange(np.count_nonzero(fresh))
            if same.any():  # these phrases end where their suffix does: its state reaches further
                reach = np.concatenate(longest)
                reach[parent[same]] = d
                parts = np.cumsum([len(x) for x in longest])[:-1]
                longest = list(np.split(reach, parts))
            at.append(order[first[fresh]])
            count.append(sizes[fresh])
            shortest.append(np.full(len(at[-1]), d, np.int8))
            longest.append(np.full(len(at[-1]), d, np.int8))
            link.append(parent[fresh])
            base += len(at[-1])
            above = np.repeat(state, sizes)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.at, self.count, self.shortest, self.longest, self.link = join(at), join(count), join(shortest), join(longest), join(link)

    def phrases(self, length: int) -> np.ndarray:
        """The states that have a phrase of this length: one for each such phrase."""
        return np.flatnonzero((self.shortest <= length) & (length <= self.longest))


def phrase_hash(shard: Shard, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the phrase of `length` words that ends at each position, and its group."""
    out = _words.mix(shard.of[shard.number[at] - 1].astype(np.uint64) + U(length))
    for k in range(length - 1, -1, -1):
        out = _words.mix(out * U(0x9E3779B97F4A7C15) + shard.hash[shard.number[at - k] - 1])
    return out


def group_code(name: str) -> int:
    """A number of a group's name that all tasks share; collisions only weaken the filter."""
    data = np.frombuffer(name.encode(), np.uint8)
    return int(_words.segment_hashes(data, np.zeros(1, np.int64), np.array([len(data)]))[0] & U((1 << 62) - 1))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, list[str]]]:
    """(shard, names of its groups by number) of batches (group, text)."""

    def made(held: list[pa.RecordBatch]) -> tuple[Shard, list[str]]:
        table = pa.Table.from_batches(held)
        groups = pc.fill_null(table.column(0).cast(pa.string()), UND).combine_chunks().dictionary_encode()
        data, starts, ends = strings(table.column(1).cast(pa.large_string()).combine_chunks())
        shard = Shard(data, starts, ends, np.asarray(groups.indices).astype(np.int64))
        return shard, groups.dictionary.to_pylist()

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= SHARD:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _coded(shard: Shard, names: list[str]) -> None:
    """Give groups the codes that all tasks share, for hashes."""
    shard.of = np.array([group_code(x) for x in names], np.int64)[shard.of] if len(shard.of) else shard.of


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash's lowest 40 bits."""
    mixed = _words.mix(hashes & U(LOW))
    return (mixed & U(BITS - 1)).astype(np.int64), (mixed >> U(32) & U(BITS - 1)).astype(np.int64)


#: Bits of a hash that are shuffled.
LOW = (1 << 40) - 1


def squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def restored(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)


def _packed(hashes: np.ndarray, counts_: np.ndarray, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """(range, number of hashes, packed) of hashes: LOW bits in order, a plane for each byte, and counts up to 255."""
    key = range_of(hashes, ranges).astype(np.uint64) << U(40) | hashes & U(LOW)
    order = np.argsort(key)
    key, n = key[order], np.minimum(counts_[order], 255).astype(np.uint8)
    planes = key.astype("<u8").view(np.uint8).reshape(-1, 8)
    of = (key >> U(40)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    for i, j in zip(cut, np.r_[cut[1:], len(of)]):
        yield int(of[i]), int(j - i), squeezed(b"".join(planes[i:j, k].tobytes() for k in range(4, -1, -1)) + n[i:j].tobytes())


def _unpacked(number: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(restored(packed, 6 * number), np.uint8).reshape(6, number)
    h = np.zeros(number, np.uint64)
    for k in range(5):
        h = h << U(8) | planes[k]
    return h, planes[5]


def hash_ranges(texts: DataFrame) -> int:
    """Ranges of hashes to deal phrases to: one for about RANGE_BYTES of text, whatever the input's size."""
    size = texts.agg(F.sum(F.octet_length("t").cast("bigint"))).first()[0] or 0
    return min(1 << 24, max(64, -(-size // RANGE_BYTES)))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(40)) * U(ranges) >> U(24)).astype(np.int64)


def frequent(texts: DataFrame, least: int, ranges: int) -> bytes:
    """A bitmap that holds the hashes of all words and pairs that occur `least` times (255 at most); others by chance."""
    if least > 255:
        raise ValueError("least is 255 at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names in _shards(batches):
            automaton = Automaton(shard, 2)
            _coded(shard, names)
            both = [(phrase_hash(shard, automaton.at[x], k), automaton.count[x]) for k, x in ((k, automaton.phrases(k)) for k in (1, 2))]
            found = list(_packed(np.concatenate([h for h, _ in both]), np.concatenate([n for _, n in both]), ranges))
            del shard, automaton, both
            for i in range(0, len(found), 1 << 12):
                part = found[i : i + (1 << 12)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.binary())], names=["r", "m", "x"])

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [_unpacked(m, x) for m, x in zip(rows["m"].to_pylist(), rows["x"].to_pylist())]
        h, n = np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.add.reduceat(n[order].astype(np.int64), first) >= least
        return pa.table({"bit": np.unique(np.concatenate(_places(h[first[many]])))})

    bits = texts.mapInArrow(lean(run), "r int, m int, x binary").groupBy("r").applyInArrow(summed, "bit bigint")
    pages = bits.groupBy(F.floor(F.col("bit") / PAGE_BITS).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % PAGE_BITS).alias("map"))
    out = bytearray(BITS // 8)
    for row in pages.collect():  # at most BITS / PAGE_BITS rows of 4 KB
        out[row["page"] * PAGE_BITS // 8 : (row["page"] + 1) * PAGE_BITS // 8] = row["map"]
    return bytes(out)


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, other = _places(hashes)
    return (bitmap[one >> 3] >> (one & 7) & bitmap[other >> 3] >> (other & 7) & 1).astype(np.bool_)


_BLOCK = "r int, grp string, k int, size int, phrases binary, n binary"


def _blocks(k: int, hashes: np.ndarray, ranges: int, groups: np.ndarray, names: list[str], phrases, sums: np.ndarray) -> pa.RecordBatch:
    """A row for each range and group of some phrases of k words: their texts as lines, and their counts, both compressed."""
    key = range_of(hashes, ranges) * len(names) + groups
    order = np.argsort(key, kind="stable")  # phrases with one ending stay together
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    at = np.r_[first, len(key)].astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), phrases.take(pa.array(order))), b"\n").to_pylist()
    sums = sums[order].astype("<u4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array((key[first] // len(names)).astype(np.int32)),
            pa.array(names, pa.string()).take(pa.array(key[first] % len(names))),
            pa.array(np.full(len(first), k, np.int32)),
            pa.array([len(x) for x in texts], pa.int32()),
            pa.array([squeezed(x) for x in texts], pa.binary()),
            pa.array([squeezed(sums[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])], pa.binary()),
        ],
        names=["r", "grp", "k", "size", "phrases", "n"],
    )


def counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(grp, k, phrase, n) of texts (group, text): exact counts of all phrases that occur `least` times.

    One more row a group, k 0 and an empty phrase, has the number of its words.
    """
    ranges = hash_ranges(texts)
    held = texts.sparkSession.sparkContext.broadcast(frequent(texts, least, ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held.value, np.uint8)
        for shard, names in _shards(batches):
            automaton = Automaton(shard, longest)
            of = shard.of
            _coded(shard, names)
            codes = np.array([group_code(x) for x in names], np.uint64)
            yield _blocks(0, _words.mix(codes), ranges, np.arange(len(names)), names, pa.array([b""] * len(names), pa.binary()), np.bincount(shard.group, minlength=len(names)))
            kept = np.zeros(len(automaton.at), np.bool_)  # the state's phrase one word shorter than the present length
            for length in range(1, longest + 1):
                states = automaton.phrases(length)
                at = automaton.at[states]
                if length <= 2:
                    good = _in(bitmap, phrase_hash(shard, at, length))
                else:
                    # its suffix is in the same state, or where the link leads; its first pair ends there
                    suffix = np.where(automaton.shortest[states] < length, states, automaton.link[states])
                    good = kept[suffix]
                    good[good] = _in(bitmap, phrase_hash(shard, at[good] - length + 2, 2))
                kept[:] = False
                kept[states[good]] = True
                states, at = states[good], at[good]
                if not len(states):
                    continue
                words = [pc.take(shard.names, pa.array(shard.name[shard.number[at - k] - 1])) for k in range(length - 1, -1, -1)]
                phrases = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if length > 1 else words[0]
                del words
                yield _blocks(length, phrase_hash(shard, at, length), ranges, of[shard.number[at] - 1], names, phrases.cast(pa.binary()), automaton.count[states])
                del phrases

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        texts = [restored(x, size).decode() for x, size in zip(rows["phrases"].to_pylist(), rows["size"].to_pylist())]
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
        owner = pc.list_parent_indices(lists)
        sizes = pc.list_value_length(lists).to_pylist()
        n = np.concatenate([np.frombuffer(restored(x, 4 * m), "<u4") for x, m in zip(rows["n"].to_pylist(), sizes)])
        flat = pa.table({"grp": rows["grp"].combine_chunks().take(owner), "k": rows["k"].combine_chunks().take(owner), "phrase": pc.list_flatten(lists).cast(pa.string()), "n": n.astype(np.int64)})
        del texts, lists
        total = flat.group_by(["grp", "k", "phrase"]).aggregate([("n", "sum")]).rename_columns(["grp", "k", "phrase", "n"])
        return total.filter(pc.or_(pc.greater_equal(total["n"], least), pc.equal(total["k"], 0)))

    return texts.mapInArrow(lean(run), _BLOCK).groupBy("r").applyInArrow(summed, "grp string, k int, phrase string, n bigint")


def _looked_up(rows: DataFrame, key: str, known: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """rows with the count of the phrase in `key` as `name`.

    Hot phrases, HOT at most for each length, are met by broadcast; the others, each in few
    rows, by a shuffle.
    """
    told = rows.join(F.broadcast(hot.select(F.col("grp"), F.col("phrase").alias(key), F.col("n").alias("__hot"))), ["grp", key], "left")
    met = told.where("__hot IS NOT NULL").withColumn(name, F.col("__hot")).drop("__hot")
    rest = told.where("__hot IS NULL").drop("__hot").join(known.select("grp", F.col("phrase").alias(key), F.col("n").alias(name)), ["grp", key])
    return met.unionByName(rest)


def _part(first: int, size: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) without rounding."""
    wide = lambda c: c.cast("decimal(16,0)")
    whole = F.lit(1_000_000).cast("decimal(7,0)") * wide(a)
    return F.call_function("div", (whole * wide(a)).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).cast("bigint")


def best(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each grp, as rank from 1 on, found in rounds of ever fewer groups."""
    for share in (4096, 128, 4):
        own = Window.partitionBy("grp", F.pmod(F.xxhash64("phrase"), F.lit(share))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def mine(docs: DataFrame, group_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int | None = 2000) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): phrases of 2 and 3 words that occur `least` times.

    score is that of the cut that explains the phrase best, the shortest first part among equals.
    A phrase is dropped when a longer one that holds it occurs at least half as often. Ranks go
    by score, count, phrase; top=None gives all, without rank.
    """
    texts = small_batches(docs).select(F.col(group_col).cast("string").alias("grp"), F.col(text_col).alias("t"))
    all_ = stash(counts(texts, least), "phrases")
    sizes = all_.where("k = 0").select("grp", F.col("n").alias("words"))
    known = all_.where("k > 0")
    whole = sizes.agg(F.sum("words").alias("all_words"))
    hot = known.where("k < 3").join(F.broadcast(whole), F.col("n") * HOT >= F.col("all_words")).select("grp", "phrase", "n")
    longer = known.where("k = 3").select("grp", F.explode(F.array(_part(1, 2), _part(2, 2))).alias("phrase"), "n").groupBy("grp", "phrase").agg(F.max("n").alias("most"))

    def cut(rows: DataFrame, after: int, words: int) -> DataFrame:
        parts = rows.withColumn("p", _part(1, after)).withColumn("q", _part(after + 1, words - after))
        met = _looked_up(_looked_up(parts, "p", known, hot, "l"), "q", known, hot, "r")
        return met.select("grp", "phrase", F.col("n").alias("a"), F.lit(after).alias("cut"), "l", "r", _score(F.col("n"), F.col("l"), F.col("r")).alias("score"))

    pairs = cut(known.where("k = 2"), 1, 2)
    pairs = pairs.join(longer, ["grp", "phrase"], "left").where("most IS NULL OR 100 * most < 50 * a").drop("most")
    three = known.where("k = 3")
    cuts = cut(three, 1, 3).unionByName(cut(three, 2, 3))
    lowest = cuts.groupBy("grp", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("grp", "phrase", "x.a", "x.cut", "x.l", "x.r", "x.score")
    scored = pairs.unionByName(lowest).drop("cut")
    if top is not None:
        scored = best(scored, [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    # groups are few against phrases, and their number is not bounded: Spark picks the join
    done = stash(scored.join(sizes, "grp").withColumnRenamed("words", "n"), "mined")
    unstash(all_)
    return done
