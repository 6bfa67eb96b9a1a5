"""Secret scans by multipart credential linking, in DataFrame functions only.

Base finds are strong by their form alone: assignments to a secret's name, access key ids, and
long hexadecimal runs. Weak candidates (account identifiers, short or unnamed secrets,
endpoints) mean little alone; they are reported only when a complementary part co-occurs: an
interval join of parts within a scope (the same text, at most SCOPE code points between
starts) keeps an identifier or an endpoint near a secret, and a secret near an identifier or an
endpoint.

The join is on (document, bin of SCOPE code points): the parts of each class are first reduced
to their first and last start in a bin, so a part meets at most three rows of a class and no
pairs are made, however many parts a text has. Texts whose parts can't complement each other do
not enter it.

Positions are code points, ends exclusive; a span is the whole match. Defined results: null
and empty text has no spans; repeated rows with one id each give a row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stash

#: Code points between the starts of parts of one credential.
SCOPE = 200

#: Patterns of the base kinds; fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 characters or more: a run is matched whole either way
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Weak candidates.
WEAK_ID = r"""\b(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"""\b(?i:pwd|pass|passphrase|auth|bearer|credential|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}|(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"""
ENDPOINT = r"""\b[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D"'<>]{3,}|\b(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/-]{3,}"""

#: kind, order among spans that start together, class of part
KINDS = [("assign", 0, "secret"), ("access", 1, "id"), ("hex", 2, "secret"), ("weak_id", 3, "id"), ("weak_secret", 4, "secret"), ("endpoint", 5, "endpoint")]
BASE = ("assign", "access", "hex")


#: Parts whose running sums are folded together; a fold copies what it has at each step.
RUN = 256
#: Code points of a text that are cut together.
CHUNK = 1024
#: Encloses matches. Texts that hold it are searched with STAND_IN in its place, which no pattern tells from it.
MARKER, STAND_IN = "\x01", "\x02"
_SPANS = "array<struct<s:int,e:int>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _positions(parts: Column) -> Column:
    """Places of the wanted ones of array<struct<n, ok>> parts that lie end to end: running sums in blocks of RUN."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["n"]
        return F.struct(end.alias("at"), F.when(x["ok"], F.array_append(acc["out"], F.struct(acc["at"].alias("s"), end.alias("e")))).otherwise(acc["out"]).alias("out"))

    def moved(block: Column, base: Column) -> Column:
        return F.transform(block["out"], lambda x: F.struct((x["s"] + base).alias("s"), (x["e"] + base).alias("e")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(parts, k * RUN + 1, F.lit(RUN)), start, step))

    def based(found: Column) -> Column:
        bases = F.aggregate(found, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b["at"]))
        return F.flatten(F.zip_with(found, F.slice(bases, F.lit(1), F.size(found)), moved))

    return _let(blocks, based)


def spans(text: Column, pattern: str, good=None) -> Column:
    """array<struct<s, e>> of the leftmost non-overlapping matches, without those that `good` refuses.

    One pass of the pattern encloses the matches in MARKER; the parts between markers are then
    a gap, a match, a gap and so on. The time is in proportion to the text and its matches.
    """
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARKER}$0{MARKER}")), MARKER, -1)

    def found(p: Column) -> Column:
        parts = F.transform(p, lambda x, i: F.struct(F.length(x).alias("n"), ((i % 2 == 1) & (good(x) if good else F.lit(True))).alias("ok")))
        return F.when(F.size(p) > 1, _let(parts, _positions)).otherwise(F.array().cast(_SPANS))

    return _let(pieces, found)


def _scanned(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(F.contains(text, F.lit(MARKER)), F.translate(text, MARKER, STAND_IN)).otherwise(text)
    patterns = {
        "assign": spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN),
        "access": spans(text, ACCESS, lambda m: F.length(m) >= MIN_ACCESS),
        "hex": spans(text, HEX),
        "weak_id": spans(text, WEAK_ID), "weak_secret": spans(text, WEAK_SECRET), "endpoint": spans(text, ENDPOINT),
    }
    return docs.select(*kept, F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in patterns.items()])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, one array of spans for each kind) of every whole text; no shuffle."""
    return _scanned(docs, text_col, F.col(id_col).alias("id"))


def _some(kinds) -> Column:
    return sum((F.size(k) for k in kinds[1:]), F.size(kinds[0])) > 0


def _linkable() -> Column:
    """Whether a scanned text has weak candidates and parts that complement each other at all."""
    secret, other = [k for k, _, c in KINDS if c == "secret"], [k for k, _, c in KINDS if c != "secret"]
    return _some(secret) & _some(other) & _some([k for k, _, _ in KINDS if k not in BASE])


def _as_part(kind: str, order: int, part: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), F.lit(part).alias("part"))


def _as_found(kind: str, order: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def link(scanned: DataFrame) -> DataFrame:
    """(row, weak): the weak spans that have a complementary part in their scope."""
    kinds = F.array(*[F.transform(F.col(k), _as_part(k, o, c)) for k, o, c in KINDS])
    parts = scanned.where(_linkable()).select("row", F.explode(F.flatten(kinds)).alias("p")).select("row", "p.*").withColumn("bin", F.floor(F.col("s") / SCOPE))
    # of each class in a bin only the first and the last start can be the nearest to another bin
    seen = parts.withColumn("wants", F.when(F.col("part") == "secret", F.array(F.lit("id"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret"))))
    ends = parts.groupBy("row", "part", "bin").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    weak = seen.where(~F.col("kind").isin(*BASE)).withColumn("want", F.explode("wants")).withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    right = ends.select(F.col("row").alias("r_row"), F.col("part").alias("r_part"), F.col("bin").alias("r_bin"), "lo", "hi")
    close = (F.col("r_bin") == F.col("bin")) | ((F.col("r_bin") < F.col("bin")) & (F.col("s") - F.col("hi") <= SCOPE)) | ((F.col("r_bin") > F.col("bin")) & (F.col("lo") - F.col("s") <= SCOPE))
    linked = weak.join(right, (F.col("row") == F.col("r_row")) & (F.col("want") == F.col("r_part")) & (F.col("near") == F.col("r_bin")) & close, "left_semi")
    return linked.groupBy("row").agg(F.collect_set(F.struct("s", "o", "e", "kind")).alias("weak"))


_FOUND = "array<struct<s:int,o:int,e:int,kind:string>>"


def _base() -> Column:
    return F.flatten(F.array(*[F.transform(F.col(k), _as_found(k, o)) for k, o, _ in KINDS if k in BASE]))


def _all_found() -> Column:
    return F.array_sort(F.concat(_base(), F.coalesce("weak", F.array().cast(_FOUND))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): every document's spans as array<struct<s, o, e, kind>> by start, then kind."""
    scanned = stash(scan(docs, id_col, text_col), "scanned")
    rows = scanned.join(link(scanned), "row", "left")
    return rows.select(F.col("id").alias(id_col), "row", _all_found().alias("found"))


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[redacted]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by `mark`; same columns and rows.

    Overlapping spans are merged. Texts without spans pass unchanged. The spans stay beside
    their text: only texts with complementary parts meet the links in a join.
    """
    scanned = stash(_scanned(docs, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src")), "scanned")
    alone = scanned.where(~_linkable()).select("src", F.array_sort(_base()).alias("found"))
    met = scanned.where(_linkable()).join(link(scanned), "row", "left").select("src", _all_found().alias("found"))
    text = F.col("src")[text_col]
    clean = F.when(F.size("found") > 0, _without(text, F.col("found"), mark)).otherwise(text)
    return alone.union(met).select(*[clean.alias(c) if c == text_col else F.col("src")[c].alias(c) for c in docs.columns])


def _without(text: Column, found: Column, mark: str) -> Column:
    """text with each found span replaced by mark, in pieces of CHUNK code points: in proportion to text and spans."""
    chunk = lambda at: F.floor(at / CHUNK).cast("int")

    def parted(x: Column) -> Column:  # a span as its parts in chunks; the first is its head
        def part(k: Column) -> Column:
            return F.struct(k.alias("c"), (F.greatest(x["s"], k * CHUNK) - k * CHUNK).alias("s"), (k == chunk(x["s"])).alias("head"), (F.least(x["e"], (k + 1) * CHUNK) - k * CHUNK).alias("e"))

        return F.transform(F.sequence(chunk(x["s"]), chunk(x["e"] - 1)), part)

    def grouped(parts: Column) -> Column:  # chunk -> its parts, which adjoin in their order
        numbered = F.transform(parts, lambda x, i: F.struct(x["c"].alias("c"), i.alias("i"), F.coalesce(F.get(parts, i - 1)["c"] != x["c"], F.lit(True)).alias("first")))

        def entries(heads: Column) -> Column:
            def entry(h: Column, j: Column) -> Column:
                return F.struct(h["c"].alias("c"), F.slice(parts, h["i"] + 1, F.coalesce(F.get(heads, j + 1)["i"], F.size(parts)) - h["i"]).alias("own"))

            return F.map_from_entries(F.transform(heads, entry))

        return _let(F.filter(numbered, lambda x: x["first"]), entries)

    by_chunk = _let(F.array_sort(F.flatten(F.transform(found, parted))), grouped)

    def cut(piece: Column, own: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            more = F.concat(F.substring(piece, acc["at"] + 1, x["s"] - acc["at"]), F.when(x["head"], F.lit(mark)).otherwise(F.lit("")))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.array_append(acc["out"], more)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array(F.lit("")).alias("out"))
        return F.aggregate(own, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(piece, acc["at"] + 1, F.lit(CHUNK))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return _let(by_chunk, lambda m: F.array_join(F.transform(pieces, lambda p, k: F.coalesce(cut(p, m[k]), p)), ""))
