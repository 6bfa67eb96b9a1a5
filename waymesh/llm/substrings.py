"""Removal of repeated 100-byte substrings by hash-compared suffix sorting.

A byte is removed when a string of LENGTH bytes that covers it also starts earlier (in a
document with a smaller id, or earlier in the same one). Strings are judged on the input.

1. Anchors. Every window of LENGTH bytes has an anchor: the leftmost K bytes in it with the
   smallest hash. Equal windows have equal anchors at equal offsets, so only windows of one
   anchor string can be equal. Consecutive windows with one anchor are a context: the bytes
   they cover. A document has about three contexts for a hundred bytes.
2. Of contexts that are equal as a whole all but the first are repeats entirely: they are
   marked where they meet, in a batch or in the run of their anchor, and go no further.
3. What is left of an anchor's contexts is suffix-sorted in blocks: prefix polynomial hashes
   give the common extension of two suffixes by binary search, so that a mergesort compares in
   logarithmic time; neighbours that agree on LENGTH bytes are compared byte by byte against
   collisions. All but the first of equal windows are marked.
4. An anchor with more contexts than a block holds is dealt to several blocks; the windows that
   are first in their block meet once more under the hash of the window.
5. Marks are merged and applied document by document.

No step gathers an unbounded group: runs are streamed in sorted order, blocks are bounded, and
copies of a text are dropped in their batch and have a rule of their own.

A match of whole contexts in a batch, and every match of the sort, is compared byte by byte;
contexts of several tasks match by 128 bits of hash (anchor and context), windows of several
blocks likewise, and whole texts by SHA-256.

Defined results: null text is empty; texts under LENGTH bytes keep all; rows with equal ids and
equal texts are one document; several texts of one id are documents of their own, in the order
of their SHA-256 (2^22 of one id at most); of equal texts all but the smallest id's are removed
whole; a document without an id keeps all and is no earlier document.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words
from ._shared import free_shuffles, lean, slices, small_batches, stash, strings, unstash

LENGTH = 100
K = 28
#: Contexts of a block.
BLOCK = 512
#: Bytes of a long text that are looked at together.
PIECE = 1 << 20
#: Bytes of texts whose contexts are first compared with each other.
STRETCH = 8 << 20
U = np.uint64
_rng = np.random.default_rng(0x5EED)
#: Codes of bytes and the base of the prefix hashes modulo 2^64. Strings of under 1,024 bytes are
#: compared by them; only longer ones can collide whatever the codes.
CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0xD6E8FEB86659FD93)
_POWER: list[np.ndarray] = []
_EMPTY = hashlib.sha256(b"").hexdigest()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP^i and STEP^-i modulo 2^64 for i < n."""
    if not _POWER or len(_POWER[0]) < n:
        size = max(n, PIECE + (1 << 12))
        inverse = U(pow(int(STEP), -1, 1 << 64))
        _POWER[:] = [_series(STEP, size), _series(inverse, size)]
    return _POWER[0], _POWER[1]


def _series(base: np.uint64, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    filled, top = 1, int(base)
    while filled < size:
        more = min(filled, size - filled)
        out[filled : filled + more] = out[:more] * U(top)
        top = top * top % (1 << 64)
        filled += more
    return out


def pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, row, offset in the row) of adjacent spans; a long row comes in overlapping parts of its own."""
    for i, j in slices(starts, ends, PIECE):
        if j == i + 1 and ends[i] - starts[i] > 2 * PIECE:
            for at in range(int(starts[i]), int(ends[i]) - LENGTH + 1, PIECE):
                end = min(int(ends[i]), at + PIECE + LENGTH - 1)
                yield np.array([at]), np.array([end]), np.array([i]), np.array([at - int(starts[i])])
        else:
            yield starts[i:j], ends[i:j], np.arange(i, j), np.zeros(j - i, np.int64)


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, row, first byte, bytes, anchor's place in it) of the rows' contexts."""
    out = []
    for s, e, row, base in pieces(starts, ends):
        a, b = int(s[0]), int(e[-1])
        n = b - a
        if n < LENGTH:
            continue
        d = data[a:b]
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(CODE[d] * power[:n], out=total[1:])
        gram = _words.mix((total[K:] - total[:-K]) * inverse[: n - K + 1])
        low = (gram >> U(22)) << U(22) | np.arange(len(gram), dtype=np.uint64)
        width, have = LENGTH - K + 1, 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if width > have:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        anchor = (low & U((1 << 22) - 1)).astype(np.int64)
        # windows stay inside their row
        full = e - s >= LENGTH
        edge = np.zeros(n - LENGTH + 2, np.int64)
        np.add.at(edge, s[full] - a, 1)
        np.add.at(edge, e[full] - a - LENGTH + 1, -1)
        good = np.cumsum(edge[:-1]) > 0
        first = good.copy()
        first[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
        first[(s[full] - a)] = True
        lo = np.flatnonzero(first)
        if not len(lo):
            continue
        last = good.copy()
        last[:-1] &= ~good[1:] | first[1:]
        hi = np.flatnonzero(last)
        at = anchor[lo]
        size = hi + LENGTH - lo
        context = _words.mix((total[lo + size] - total[lo]) * inverse[lo] + (size * 256 + at - lo).astype(np.uint64))
        own = np.searchsorted(s, lo + a, side="right") - 1
        out.append((gram[at], context, row[own], lo + a - s[own] + base[own], size, at - lo))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


_FOUND = "kind int, key bigint, win bigint, doc bigint, lo bigint, size int, place int"


def _found(kind: int, key, doc, lo, size, place, win=None) -> pa.RecordBatch:
    n = len(doc)
    win = np.zeros(n, np.int64) if win is None else win.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(key).astype(np.int64)), pa.array(win), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(lo, np.int64)), pa.array(np.asarray(size).astype(np.int32)), pa.array(np.asarray(place).astype(np.int32))], names=["kind", "key", "win", "doc", "lo", "size", "place"])


MARK, CONTEXT = 0, 1
#: A place in a document is `lo`: which of its id's texts it is in, and the byte's offset there.
OFFSET_BITS = 40
OFFSETS = (1 << OFFSET_BITS) - 1


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal, for each element."""
    out = np.ones(len(a), np.bool_)
    span = np.arange(int(size.max()) if len(size) else 0)
    for i in range(0, len(a), 1 << 13):
        j = slice(i, i + (1 << 13))
        inside = span < size[j][:, None]
        at = np.where(inside, span, 0)
        out[j] = ((data[a[j][:, None] + at] == data[b[j][:, None] + at]) | ~inside).all(1)
    return out


def _scan(docs: DataFrame) -> DataFrame:
    """Contexts of (doc, raw, alt) that are first in their batch, and marks for those that repeat in it.

    (key, ctx, tag, doc, lo): tag holds kind, size and the anchor's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[bytes, int] = {}
        for batch in batches:
            data, starts, ends = strings(batch.column(1))
            ids, alt = np.asarray(batch.column(0)), np.asarray(batch.column(2)).astype(np.int64)
            for i, j in slices(starts, ends, STRETCH):  # bounds the arrays of contexts
                yield stretch(smallest, data, starts[i:j], ends[i:j], ids[i:j], alt[i:j] << OFFSET_BITS)

    def stretch(smallest: dict[bytes, int], data, starts, ends, ids, base) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        live = []
        for r in order:  # a text met before in this task with a smaller id goes no further
            if ends[r] - starts[r] < LENGTH:
                continue
            key = hashlib.blake2b(data[starts[r] : ends[r]], digest_size=16).digest()
            if smallest.get(key, ids[r] + 1) > ids[r]:
                smallest[key] = ids[r]
                live.append(r)
        keep = np.zeros(len(ids), np.bool_)
        keep[live] = True
        key, ctx, row, lo, size, place = contexts_kept(data, starts, np.where(keep, ends, starts), keep)
        doc, at = ids[row], starts[row] + lo
        lo = base[row] + lo
        order = np.lexsort((lo, doc, size, place, ctx, key))
        key, ctx, doc, lo, at, size, place = (x[order] for x in (key, ctx, doc, lo, at, size, place))
        again = np.zeros(len(key), np.bool_)
        again[1:] = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (size[1:] == size[:-1]) & (place[1:] == place[:-1])
        hit = np.flatnonzero(again)
        for k in hit[~_equal_bytes(data, at[hit], at[hit - 1], size[hit])]:  # collisions get another hash
            again[k] = False
            ctx[k] = np.frombuffer(hashlib.blake2b(data[at[k] : at[k] + size[k]], digest_size=8).digest(), np.uint64)[0]
        tag = (np.where(again, MARK, CONTEXT) << 16 | size << 8 | place).astype(np.int32)
        # a mark has no use for its anchor any more; under a key of its own it burdens no run
        key = np.where(again, _words.mix(doc.astype(np.uint64) * U(0x9E3779B97F4A7C15) + lo.astype(np.uint64)), key)
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ctx.astype(np.int64)), pa.array(tag), pa.array(doc), pa.array(lo)], names=["key", "ctx", "tag", "doc", "lo"])

    return docs.select("doc", "raw", "alt").mapInArrow(lean(run), "key bigint, ctx bigint, tag int, doc bigint, lo bigint")


def contexts_kept(data, starts, ends, keep):
    """contexts() of the kept rows only; the others are skipped without copying."""
    rows = np.flatnonzero(keep)
    # spans of adjacent kept rows
    out, i = [], 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j] == rows[j - 1] + 1 and starts[rows[j]] == ends[rows[j - 1]]:
            j += 1
        got = contexts(data, starts[rows[i:j]], ends[rows[i:j]])
        out.append((got[0], got[1], rows[i:j][got[2]], *got[3:]))
        i = j
    if not out:
        return contexts(data, starts[:0], ends[:0])
    return tuple(np.concatenate(x) for x in zip(*out))


def _resolve(scanned: DataFrame) -> DataFrame:
    """Runs of each anchor in sorted order: repeats of whole contexts become marks; anchors with several contexts stay."""
    dealt = scanned.repartition("key").sortWithinPartitions("key", "ctx", "tag", "doc", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (key, ctx, tag, doc, lo) of the last row
        waiting = None  # the only context so far of the last key
        for batch in batches:
            key, ctx, tag, doc, lo = (np.asarray(batch.column(c)) for c in range(5))
            if (m := tag >> 16 == MARK).any():  # of the batch they come from; they only pass through
                yield _found(MARK, key[m], doc[m], lo[m], (tag[m] >> 8) & 0xFF, tag[m] & 0xFF)
                key, ctx, tag, doc, lo = key[~m], ctx[~m], tag[~m], doc[~m], lo[~m]
            # one place met twice: a row that is in the table more than once
            twice = np.zeros(len(key), np.bool_)
            twice[1:] = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & (tag[1:] == tag[:-1]) & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1])
            if before is not None and len(key):
                twice[0] = (key[0], ctx[0], tag[0], doc[0], lo[0]) == before
            if twice.any():
                key, ctx, tag, doc, lo = key[~twice], ctx[~twice], tag[~twice], doc[~twice], lo[~twice]
            n = len(key)
            if not n:
                continue
            new_key, new_ctx = np.ones(n, np.bool_), np.ones(n, np.bool_)
            new_key[1:] = key[1:] != key[:-1]
            new_ctx[1:] = new_key[1:] | (ctx[1:] != ctx[:-1]) | (tag[1:] != tag[:-1])
            if before is not None:
                new_key[0] = key[0] != before[0]
                new_ctx[0] = new_key[0] or (ctx[0], tag[0]) != before[1:3]
            size, place = (tag >> 8) & 0xFF, tag & 0xFF
            if not new_ctx.all():
                m = ~new_ctx
                yield _found(MARK, key[m], doc[m], lo[m], size[m], place[m])
            group = np.cumsum(new_key)  # 0: the key of the last batch goes on
            several = np.bincount(group, new_ctx, minlength=group[-1] + 1)[group]
            held = several > 1
            if before is not None and not new_key[0]:
                goes_on = group == 0
                if waiting is not None and (new_ctx & goes_on).any():
                    yield _found(CONTEXT, *[[x] for x in waiting])
                    waiting = None
                held = np.where(goes_on, waiting is None, held)
            emit = held & new_ctx
            if emit.any():
                yield _found(CONTEXT, key[emit], doc[emit], lo[emit], size[emit], place[emit])
            last = group == group[-1]
            if group[-1] > 0:
                waiting = None
                if np.count_nonzero(new_ctx & last) == 1:
                    k = int(np.flatnonzero(new_ctx & last)[0])
                    waiting = (key[k], doc[k], lo[k], size[k], place[k])
            before = (key[-1], ctx[-1], tag[-1], doc[-1], lo[-1])

    return dealt.mapInArrow(lean(run), _FOUND)


class Suffixes:
    """Suffixes of a byte buffer, each at least LENGTH long, compared by prefix hashes."""

    def __init__(self, buffer: np.ndarray, at: np.ndarray) -> None:
        self.buffer, self.at = buffer, at
        power, inverse = powers(len(buffer) + 1)
        self.total = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(CODE[buffer] * power[: len(buffer)], out=self.total[1:])
        self.scale, self.base = inverse[at], self.total[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a and b, up to LENGTH, by binary search over prefix hashes."""
        at_a, at_b, scale_a, scale_b, base_a, base_b = self.at[a], self.at[b], self.scale[a], self.scale[b], self.base[a], self.base[b]
        size = np.zeros(len(a), np.int64)
        for step in (64, 32, 16, 8, 4, 2, 1):
            more = np.minimum(size + step, LENGTH)
            same = (self.total[at_a + more] - base_a) * scale_a == (self.total[at_b + more] - base_b) * scale_b
            size = np.where(same, more, size)
        return size

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0, 1: a sorts before b, equal on LENGTH bytes, after."""
        size = self.common(a, b)
        equal = size >= LENGTH
        place = np.minimum(size, LENGTH - 1)
        left, right = self.buffer[self.at[a] + place].astype(np.int16), self.buffer[self.at[b] + place].astype(np.int16)
        return np.where(equal, 0, np.sign(left - right))

    def sort(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort inside classes [start, start + size) of suffix numbers; all classes a level at a time."""
        n = len(self.at)
        order = np.arange(n)
        cls = np.repeat(np.arange(len(start)), size)
        first, length = start[cls], size[cls]
        place = np.arange(n) - first
        width = 1
        while True:
            busy = np.flatnonzero(length > width)
            if not len(busy):
                return order
            q, f, m = place[busy], first[busy], length[busy]
            run = q // width
            is_right = run % 2 == 1
            other = np.where(is_right, run - 1, run + 1) * width
            lo = f + np.minimum(other, m)
            hi = f + np.minimum(other + width, m)
            begin, own = lo.copy(), order[busy]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                side = self.before(order[mid], own[open_])
                right = np.where(is_right[open_], side <= 0, side < 0)
                lo[open_] = np.where(right, mid + 1, lo[open_])
                hi[open_] = np.where(right, hi[open_], mid)
            target = f + (q // (2 * width)) * 2 * width + q % width + (lo - begin)
            moved = order.copy()
            moved[target] = own
            order, width = moved, 2 * width

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the LENGTH bytes of a and b really are equal."""
        out = np.ones(len(a), np.bool_)
        span = np.arange(LENGTH)
        for i in range(0, len(a), 1 << 14):
            j = slice(i, i + (1 << 14))
            out[j] = (self.buffer[self.at[a[j]][:, None] + span] == self.buffer[self.at[b[j]][:, None] + span]).all(1)
        return out


def repeated(group: np.ndarray, rank: np.ndarray, size: np.ndarray, place: np.ndarray, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Suffixes]:
    """For contexts laid end to end in buffer: (context, window offset in it, is a repeat) of all their windows.

    group is the context's block, rank its order among the documents' places.
    """
    count = size - LENGTH + 1
    begin = np.cumsum(size) - size
    ctx = np.repeat(np.arange(len(size)), count)
    offset = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    # windows can be equal only in one block and with the anchor at one distance
    cls = group[ctx].astype(np.int64) * 128 + (place[ctx] - offset)
    order = np.argsort(cls, kind="stable")
    ctx_s, cls_s = ctx[order], cls[order]
    new = np.ones(len(order), np.bool_)
    new[1:] = cls_s[1:] != cls_s[:-1]
    start = np.flatnonzero(new)
    suffixes = Suffixes(buffer, (begin[ctx] + offset)[order])
    sorted_ = suffixes.sort(start, np.diff(np.r_[start, len(order)]))
    same = np.zeros(len(order), np.bool_)
    cand = np.flatnonzero(~new) if len(order) else np.zeros(0, np.int64)
    hit = cand[suffixes.common(sorted_[cand - 1], sorted_[cand]) >= LENGTH]
    hit = hit[suffixes.verified(sorted_[hit - 1], sorted_[hit])]
    same[hit] = True
    repeat = np.zeros(len(order), np.bool_)
    if len(order):
        head = np.flatnonzero(~same)
        ranks = rank[ctx_s[sorted_]]
        first = np.minimum.reduceat(ranks, head)
        repeat[order[sorted_]] = ranks != np.repeat(first, np.diff(np.r_[head, len(order)]))
    return ctx, offset, repeat, suffixes


def _sorted_blocks(blocks: DataFrame) -> DataFrame:
    """Suffix sort of whole blocks, streamed: marks, and first windows of blocks that are not their anchor's only one."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, blk, many = (np.asarray(rows[c]) for c in ("key", "blk", "many"))
        doc, lo, place = np.asarray(rows["doc"]), np.asarray(rows["lo"]), np.asarray(rows["place"]).astype(np.int64)
        raw = rows["bytes"].combine_chunks()
        data, starts, ends = strings(raw)
        buffer = data[starts[0] : ends[-1]]
        size = ends - starts
        new = np.ones(len(key), np.bool_)
        new[1:] = (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])
        # the order of places; a row that is in the table more than once is at one place
        order, at = np.lexsort((lo + place, doc)), lo + place
        step = np.zeros(len(key), np.int64)
        step[1:] = (doc[order[1:]] != doc[order[:-1]]) | (at[order[1:]] != at[order[:-1]])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(step)
        ctx, offset, repeat, suffixes = repeated(np.cumsum(new), rank, size, place, buffer)
        edge = np.flatnonzero(repeat)
        if len(edge):
            jump = np.ones(len(edge), np.bool_)
            jump[1:] = (edge[1:] != edge[:-1] + 1) | (ctx[edge[1:]] != ctx[edge[:-1]])
            a, b = edge[jump], edge[np.r_[jump[1:], True]]
            yield _found(MARK, key[ctx[a]], doc[ctx[a]], lo[ctx[a]] + offset[a], offset[b] - offset[a] + LENGTH, np.zeros(len(a)))
        left = np.flatnonzero(~repeat & (many[ctx] > 1))
        if len(left):
            c = ctx[left]
            begin = (np.cumsum(size) - size)[c] + offset[left]
            _, inverse = powers(len(buffer) + 1)
            window = _words.mix((suffixes.total[begin + LENGTH] - suffixes.total[begin]) * inverse[begin] + (place[c] - offset[left]).astype(np.uint64))
            # key and window hash together name the string: both of 64 bits
            yield _found(CONTEXT, key[c], doc[c], lo[c] + offset[left], np.full(len(c), LENGTH), np.zeros(len(c)), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < PIECE:
                continue
            rows = pa.Table.from_batches(held)
            key, blk = np.asarray(rows["key"]), np.asarray(rows["blk"])
            cut = int(np.flatnonzero((key != key[-1]) | (blk != blk[-1]))[-1]) + 1 if ((key != key[-1]) | (blk != blk[-1])).any() else 0
            if cut:
                for i in _cuts(rows.slice(0, cut)):
                    yield from solve(i)
            held = rows.slice(cut).to_batches()
            size = sum(b.nbytes for b in held) if cut else size
        if held:
            for i in _cuts(pa.Table.from_batches(held)):
                yield from solve(i)

    return blocks.select("key", "blk", "many", "doc", "lo", "place", "bytes").mapInArrow(lean(run), _FOUND)


def _cuts(rows: pa.Table) -> Iterator[pa.Table]:
    """Whole blocks of about 4096 contexts at a time."""
    key, blk = np.asarray(rows["key"]), np.asarray(rows["blk"])
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])])
    i = 0
    while i < len(key):
        later = new[new > i]
        beyond = later[later >= i + 4096]
        j = int(beyond[0]) if len(beyond) else len(key)
        yield rows.slice(i, j - i)
        i = j


def _first_windows(windows: DataFrame) -> DataFrame:
    """Marks for all but the first of equal windows from several blocks, streamed in sorted order."""
    dealt = windows.select("key", "win", "doc", "lo").repartition("key", "win").sortWithinPartitions("key", "win", "doc", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, win, doc, lo = (np.asarray(batch.column(c)) for c in range(4))
            if not len(key):
                continue
            new = np.ones(len(key), np.bool_)
            new[1:] = (key[1:] != key[:-1]) | (win[1:] != win[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            first_doc, first_lo = doc[head], lo[head]
            if last is not None and (key[0], win[0]) == last[:2]:  # the run goes on from the last batch
                first_doc[head == 0], first_lo[head == 0] = last[2:]
            again = (doc != first_doc) | (lo != first_lo)  # one place met twice is no repeat
            last = (key[-1], win[-1], first_doc[-1], first_lo[-1])
            doc, lo = doc[again], lo[again]
            order = np.lexsort((lo, doc))
            doc, lo = doc[order], lo[order]
            if len(doc):  # adjacent windows as one mark
                head = np.ones(len(doc), np.bool_)
                head[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + 1)
                a, b = np.flatnonzero(head), np.r_[np.flatnonzero(head)[1:] - 1, len(doc) - 1]
                yield _found(MARK, np.zeros(len(a)), doc[a], lo[a], lo[b] - lo[a] + LENGTH, np.zeros(len(a)))

    return dealt.mapInArrow(lean(run), _FOUND)


def _context_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's contexts (key, doc, lo, size, place, blk, many) with their bytes."""
    lists = wanted.groupBy("doc", F.shiftright("lo", OFFSET_BITS).alias("alt")).agg(F.collect_list(F.struct("key", "lo", "size", "place", "blk", "many")).alias("need"))
    joined = docs.join(lists, ["doc", "alt"]).select("doc", "raw", "need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, _ = strings(batch.column(1))
            need = batch.column(2)
            flat = need.flatten()
            owner = np.repeat(np.arange(len(need)), np.diff(np.asarray(need.offsets)))
            lo, size = np.asarray(flat.field("lo")), np.asarray(flat.field("size")).astype(np.int64)
            for i in range(0, len(owner), 1 << 15):
                j = slice(i, min(len(owner), i + (1 << 15)))
                at, n = starts[owner[j]] + (lo[j] & OFFSETS), size[j]
                offsets = np.r_[0, np.cumsum(n)]
                index = np.repeat(at - offsets[:-1], n) + np.arange(offsets[-1])
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])
                part = flat.slice(j.start, j.stop - j.start)
                yield pa.RecordBatch.from_arrays([part.field("key"), part.field("blk"), part.field("many"), batch.column(0).take(pa.array(owner[j])), part.field("lo"), part.field("place"), raw], names=["key", "blk", "many", "doc", "lo", "place", "bytes"])

    return joined.mapInArrow(lean(run), "key bigint, blk bigint, many bigint, doc bigint, lo bigint, place int, bytes binary")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc, raw, alt) and facts (doc, alt, sha, n_bytes), written; alt tells an id's different texts apart."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc"), raw.alias("raw"))
    facts = stash(rows.select("doc", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2("raw", 256).alias("sha")), "facts")
    several = facts.where("doc is not null").groupBy("doc").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("doc")
    shas = facts.join(several, "doc", "left_semi").select("doc", "sha").distinct()
    later = shas.withColumn("alt", F.dense_rank().over(Window.partitionBy("doc").orderBy("sha")).cast("bigint") - 1).where("alt > 0")
    later = stash(later, "later")
    if later.isEmpty():  # no id has two texts
        none = F.lit(0).cast("bigint").alias("alt")
        return rows.select("doc", "raw", none), facts.select("doc", none, "sha", "n_bytes")
    alt = F.coalesce("alt", F.lit(0).cast("bigint")).alias("alt")
    return rows.withColumn("sha", F.sha2("raw", 256)).join(later, ["doc", "sha"], "left").select("doc", "raw", alt), stash(facts.join(later, ["doc", "sha"], "left").select("doc", alt, "sha", "n_bytes"), "facts")


def spans(rows: DataFrame) -> DataFrame:
    """(doc, alt, r): each document's sorted byte ranges to remove, overlapping; rows are texts_of() a table.

    A copy of an earlier document's text may lack some of its ranges: it is removed whole by apply().
    """
    spark = rows.sparkSession
    rows = rows.where("doc is not null")
    found = stash(_resolve(_scan(rows)), "resolved")
    free_shuffles(spark)
    left = found.where(F.col("kind") == CONTEXT)
    # a table of its own, so that an anchor with very many contexts is a join that Spark can split
    counts = stash(left.groupBy("key").agg(F.count("*").alias("m")), "counts")
    wanted = left.join(counts, "key").withColumn("many", F.ceil(F.col("m") / BLOCK)).withColumn("blk", F.pmod(F.xxhash64("doc", "lo"), F.col("many")))
    bytes_ = _context_bytes(rows, wanted.select("key", "doc", "lo", "size", "place", "blk", "many"))
    blocks = bytes_.repartition("key", "blk").sortWithinPartitions("key", "blk")
    solved = stash(_sorted_blocks(blocks), "sorted")
    free_shuffles(spark)
    across = _first_windows(solved.where(F.col("kind") == CONTEXT))
    out = found.where(F.col("kind") == MARK).select("doc", "lo", "size").union(solved.where(F.col("kind") == MARK).select("doc", "lo", "size")).union(across.select("doc", "lo", "size"))
    merged = stash(_merged(out), "ranges")
    for t in (found, solved):
        unstash(t)
    free_shuffles(spark)
    return merged


def _merged(ranges: DataFrame) -> DataFrame:
    """(doc, alt, r): each document's sorted byte ranges to remove; they may overlap."""
    own = F.col("lo").bitwiseAND(F.lit(OFFSETS))
    placed = ranges.distinct().select("doc", F.shiftright("lo", OFFSET_BITS).alias("alt"), F.struct(own.alias("lo"), (own + F.col("size")).alias("hi")).alias("x"))
    return placed.groupBy("doc", "alt").agg(F.array_sort(F.collect_list("x")).alias("r"))


def _cut(batch: pa.RecordBatch, keep_text: bool) -> pa.RecordBatch:
    """Documents (doc, raw, r, alt) without their ranges r; ranges are merged as arrays of numbers."""
    data, starts, ends = strings(batch.column(1))
    ranges = batch.column(2)
    flat, offsets = ranges.flatten(), np.asarray(ranges.offsets)
    lo, hi = np.asarray(flat.field("lo")), np.asarray(flat.field("hi"))
    owner = np.repeat(np.arange(len(ranges)), np.diff(offsets))
    base = owner << 42  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(hi + base) - base if len(hi) else hi
    head = np.ones(len(lo), np.bool_)
    head[1:] = (owner[1:] != owner[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(head)
    own, begin, end = owner[first], lo[first], reach[np.r_[first[1:] - 1, len(lo) - 1]] if len(first) else lo[:0]
    removed = np.bincount(own, end - begin, len(ranges)).astype(np.int64)
    count = np.bincount(own, minlength=len(ranges))
    at = np.searchsorted(own, np.arange(len(ranges) + 1))
    shas, kept = [], []
    for k in range(len(ranges)):
        raw = data[starts[k] : ends[k]].tobytes()
        edges = [0, *np.stack([begin[at[k] : at[k + 1]], end[at[k] : at[k + 1]]], 1).ravel().tolist(), len(raw)]
        left = b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
        shas.append(hashlib.sha256(left).hexdigest())
        if keep_text:
            kept.append(left)
    columns = [batch.column(0), batch.column(3), pa.array(removed), pa.array(count.astype(np.int64)), pa.array(shas)]
    if keep_text:
        columns.append(pa.array(kept, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["doc", "alt", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])


def apply(rows: DataFrame, facts: DataFrame, ranges: DataFrame, id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Per document: (id, n_bytes, n_removed, n_spans, kept_sha256), with keep_text also `kept` bytes."""
    # a table of its own: joining it, Spark can split a text with very many copies
    firsts = stash(facts.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc").alias("first")), "firsts")
    known = facts.join(firsts, "sha", "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)))
    schema = "doc bigint, alt bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                yield _cut(batch.slice(i, 512), keep_text)

    cut = rows.join(ranges, ["doc", "alt"]).select("doc", "raw", "r", "alt").mapInArrow(lean(run), schema)
    if not keep_text:
        cut = stash(cut, "cut")
    best = known.join(cut.dropDuplicates(["doc", "alt"]), ["doc", "alt"], "left")
    none = ~F.col("copy") & F.col("n_removed").isNull()
    picked = [
        F.col("doc").alias(id_col), "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).when(none, F.lit(0)).otherwise(F.col("n_removed")).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).when(none, F.lit(0)).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"),
        F.when(F.col("copy"), F.lit(_EMPTY)).when(none, F.col("sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if keep_text:
        picked.append(F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return best.select(*picked)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    rows, facts = texts_of(docs, id_col, text_col)
    return apply(rows, facts, spans(rows), id_col, keep_text)
