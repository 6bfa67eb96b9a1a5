"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that may stand last in the
prefix's encoding: a vocabulary entry t that ends there and whose predecessor (the last
token of what is left of t) does not merge differently with t. Storing that one token per
prefix gives the encoding of every prefix, so bytes can be appended exactly, and after an
edit only the prefixes from the edit to where the old tokens stand again are computed.

Defined results: null text is empty text (no ids, digests of nothing); every string is
ordinary text, special tokens do not exist.
"""
from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, small_batches

#: Pieces in a generation, and token pairs, that a task remembers.
REMEMBERED, REMEMBERED_PAIRS = 200_000, 500_000
#: Pieces longer than this are encoded each time.
LONGEST_REMEMBERED = 64


class Vocabulary:
    """Ranks of a .tiktoken file, and which two tokens may be neighbours."""

    def __init__(self, path: str, pairs: int = REMEMBERED_PAIRS) -> None:
        self.most_pairs = pairs
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.sizes = list(map(len, self.bytes_of))
        self.longest = max(self.sizes)
        self._pairs: dict[int, bool] = {}  # by left + 1 and right in one number

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first; only ever used on two joined tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens encode to just these two tokens.

        left is -1 at the start of a piece: a token that merging never makes can't stand there.
        """
        pair = left + 1 << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= self.most_pairs:
                self._pairs.clear()
            first = self.bytes_of[left] if left >= 0 else b""
            known = self.merged(first + self.bytes_of[right]) == ([left, right] if left >= 0 else [right])
            self._pairs[pair] = known
        return known

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> None:
        """Put the last token of each prefix of `piece` beyond len(last), of up to `upto` bytes, into `last`."""
        find, known, longest = self.ranks.get, self._pairs.get, self.longest
        for end in range(len(last) + 1, (len(piece) if upto is None else upto) + 1):
            # only one entry can stand last, so short ones, which mostly do, are tried first
            for start in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                token = find(piece[start:end])
                if token is None:
                    continue
                before = last[start - 1] if start else -1
                good = known(before + 1 << 32 | token)
                if good or good is None and self.neighbours(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {piece[end - 1]} is not in the vocabulary")

    def unwind(self, last: list[int]) -> list[int]:
        """The ids that the last tokens of all prefixes stand for."""
        out, end, sizes = [], len(last), self.sizes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out


class PrefixState:
    """The last token of every prefix of one piece, open to appends and cuts."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"") -> None:
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Add bytes; nothing before them is computed again."""
        self.piece += more
        self.vocabulary.extend(self.piece, self.last)

    def cut(self, size: int) -> None:
        """Keep the first `size` bytes; their prefixes stay valid."""
        self.piece, self.last = self.piece[:size], self.last[:size]

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put `new` in place of bytes [start, end).

        Prefixes are computed from `start` on, until as many in a row as the longest entry has
        bytes end in their old tokens: all that follow depend on these alone, and stay.
        """
        old, step = self.last[end:], self.vocabulary.longest
        tail = start + len(new)
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start:]
        self.vocabulary.extend(self.piece, self.last, tail)
        for done in range(0, len(old), step):
            self.vocabulary.extend(self.piece, self.last, min(tail + done + step, len(self.piece)))
            if self.last[tail + done :] == old[done : done + step]:
                self.last += old[done + step :]
                return

    def ids(self) -> list[int]:
        return self.vocabulary.unwind(self.last)


class _Pieces(dict):
    """Ids of pieces met before, in two generations: what is not met again goes; a long piece is not kept."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Whole texts: each match of the pattern is a piece of its own."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED) -> None:
        self.vocabulary = Vocabulary(path, remembered * REMEMBERED_PAIRS // REMEMBERED)
        self.pattern = regex.compile(pattern)
        self._pieces = _Pieces(self.piece, remembered)

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        last: list[int] = []
        self.vocabulary.extend(raw, last)
        return array("I", self.vocabulary.unwind(last)).tobytes()

    def encode(self, text: str) -> bytes:
        self._pieces.age()
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class OpenText:
    """An encoded text that is appended to or edited; pieces far from the change are kept."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.pieces: list[tuple[int, int, bytes]] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put `new` for characters [start, end); returns how many pieces were encoded.

        Pieces are matched again from two pieces before the change (a piece can depend on
        the white space that follows it) until a boundary meets an old one behind the change.
        """
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] < start:
            keep += 1
        keep = max(0, keep - 2)
        at = self.pieces[keep - 1][1] if keep else 0
        old = {a + shift: i for i, (a, _, _) in enumerate(self.pieces) if a >= end}
        made, tail = [], len(self.pieces)
        for m in self.encoder.pattern.finditer(text, at):
            if m.start() >= start + len(new) + 2 and m.start() in old:
                tail = old[m.start()]
                break
            made.append((m.start(), m.end(), self.encoder.piece(m.group())))
        self.pieces[keep:] = made + [(a + shift, b + shift, x) for a, b, x in self.pieces[tail:]]
        self.text = text
        return len(made)

    def ids(self) -> bytes:
        return b"".join(x for _, _, x in self.pieces)


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit integers")


def encoder(path: str, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    """A task's encoder. It takes a tenth of a second to make, and goes with its task: workers live on."""
    return Encoder(path, pattern, remembered)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, round_trip (decoded bytes equal the text's).

    remembered is how many pieces a task keeps: memory against time, the result is the same. keep_ids adds the ids themselves as `ids` array<int>. Rows are independent: no shuffle.
    A null text counts as empty; an empty table gives an empty result; other columns are not read.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, remembered)
        for batch in batches:
            counts, sums, back, same, all_ids = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = own.encode(text)
                raw = own.decode(ids)
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == text.encode())
                if keep_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return small_batches(docs).select(id_col, text_col).mapInArrow(lean(run), T.StructType(fields))


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """Per row: its encoded length `n_tokens` (and `grp`, the text of group_col or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            sizes = [len(own.encode(x.as_py() or "")) // 4 for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), batch.column(1)], names=["n_tokens", "grp"])

    grp = (F.col(group_col) if group_col else F.lit(None)).cast("string").alias("grp")
    return small_batches(docs).select(F.col(text_col), grp).mapInArrow(lean(run), "n_tokens bigint, grp string")
