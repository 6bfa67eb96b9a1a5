"""Keys, digests, arrays, maps and embedded JSON as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column, size: int = 20) -> Column:
    """First characters of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, size)


def pattern_key(route_id: Column, stop_ids: Column) -> Column:
    """Content key of (route, ordered stops): SHA-256 of the JSON list [route, [stops...]], 20 characters.

    Byte-identical to a JSON writer with ', ' separators for ids that need no escaping.
    """
    body = F.concat(F.lit('["'), route_id, F.lit('", ["'), F.array_join(stop_ids, '", "'), F.lit('"]]'))
    return short_hash(body)


def blob_sha(content: Column) -> Column:
    """SHA-1 of 'blob <size>NUL<bytes>', the name a version store gives a file."""
    raw = content.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(raw).cast("string"), F.lit("\0")).cast("binary")
    return F.sha1(F.concat(head, raw))


def edge_key(system: Column, line: Column, a: Column, b: Column) -> Column:
    """'system:line:a>b' with integer station numbers where they are numbers."""
    plain = lambda x: F.coalesce(x.try_cast("bigint").cast("string"), x)
    return F.concat_ws(":", system, line, F.concat(plain(a), F.lit(">"), plain(b)))


def neighbours(items: Column) -> Column:
    """Consecutive pairs (a, b) of an array."""
    n = F.size(items)
    return F.when(n > 1, F.zip_with(F.slice(items, F.lit(1), n - 1), F.slice(items, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def sub_path(items: Column, i: Column, j: Column, mark: str = ">") -> Column:
    """Items i..j (from 0, both included) joined to a key."""
    return F.array_join(F.slice(items, i + 1, j - i + 1), mark)


def between(items: Column, first: Column, last: Column) -> Column:
    """Items from `first` to `last` (both included) where each occurs just once and in this order, else null."""
    i, j = F.array_position(items, first), F.array_position(items, last)
    once = (F.size(F.filter(items, lambda x: x == first)) == 1) & (F.size(F.filter(items, lambda x: x == last)) == 1)
    return F.when(once & (i > 0) & (i <= j), F.slice(items, i.cast("int"), (j - i + 1).cast("int")))


def overlaps(left: Column, right: Column) -> Column:
    """Sizes n, 2 <= n < both, at which left's last n items equal right's first n."""
    most = F.least(F.size(left), F.size(right)) - 1
    sizes = F.when(most >= 2, F.sequence(F.lit(2), most)).otherwise(F.array().cast("array<int>"))
    return F.filter(sizes, lambda n: F.slice(left, -n, n) == F.slice(right, F.lit(1), n))


def nested(map_: Column, a: Column, b: Column) -> Column:
    return F.try_element_at(F.try_element_at(map_, a), b)


def ordered_from_one(numbers: Column) -> Column:
    """Exactly 1..n with n >= 2, in any order."""
    n = F.size(numbers)
    return (n >= 2) & (F.array_sort(numbers.cast("array<int>")) == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))


def strictly_increasing_to(times: Column, total: Column) -> Column:
    """Starts at 0, rises at each step, ends at total."""
    n = F.size(times)
    rising = F.forall(F.zip_with(F.slice(times, F.lit(1), n - 1), F.slice(times, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] < p["b"])
    return F.when(n > 1, (times[0] == 0) & rising & (F.element_at(times, -1) == total)).otherwise(F.lit(False))


def profile(times: Column) -> Column:
    """Times relative to the first."""
    return F.transform(times, lambda t: t - times[0])


def embedded_object(html: Column, name: str) -> Column:
    """The JSON object assigned to `name` in a script, as variant."""
    body = F.regexp_extract(html, rf"{name}\s*=\s*(\{{.*?\}})\s*;", 1)
    return F.try_parse_json(F.when(body != "", body))


def base64_json(text: Column, schema: str) -> Column:
    return F.from_json(F.try_to_binary(text, F.lit("base64")).cast("string"), schema)


def headway(start: Column, end: Column, seconds: Column, upper: Column) -> Column:
    """One published headway row to struct(kind, start, end, low, high, error).

    Without an interval it is a departure. A band that ends at or before its start wraps past
    midnight; equal ends are refused, and so are intervals outside 1 s..4 h or upper < lower.
    """
    wrapped = F.when(end < start, end + 86_400).otherwise(end)
    high = F.coalesce(upper, seconds)
    error = F.when(start.isNull(), "no start").when(seconds.isNull() & end.isNull(), F.lit(None)).when(end.isNull(), "no end").when(end == start, "zero width").when(~seconds.between(1, 14_400), "interval out of range").when(high < seconds, "range reversed")
    kind = F.when(seconds.isNull(), "departure").otherwise("frequency")
    return F.struct(kind.alias("kind"), start.alias("start"), F.when(kind == "frequency", wrapped).alias("end"), seconds.alias("low"), F.when(kind == "frequency", high).alias("high"), error.alias("error"))
