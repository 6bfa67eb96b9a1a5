"""Sets of dates as bitmaps: pages of 64 days, so that unions, intersections and differences are bit operations.

A relation of date sets is (key.., page, bits): day d since 1970 is bit d mod 64 of page d div 64.
A page without days has no row. Sets of any length stay relational, and partial aggregates (bit_or)
are eight bytes a page before they are shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 64


def number(date: Column) -> Column:
    return F.unix_date(date)


def page_of(date: Column) -> Column:
    return F.floor(number(date) / PAGE).cast("int")


def bit_of(date: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number(date), F.lit(PAGE)))


def pages(rows: DataFrame, key: list[str], date: str = "date") -> DataFrame:
    """(key.., page, bits) of rows (key.., date)."""
    return rows.groupBy(*key, page_of(F.col(date)).alias("page")).agg(F.bit_or(bit_of(F.col(date))).alias("bits"))


def union(sets: DataFrame, key: list[str]) -> DataFrame:
    """The sets of equal keys as one."""
    return sets.groupBy(*key, "page").agg(F.bit_or("bits").alias("bits"))


def both(left: DataFrame, right: DataFrame, key: list[str], right_key: list[str] | None = None) -> DataFrame:
    """Dates of left that are also in right; right's sets are named by right_key, part of left's columns."""
    other = right.select(*(right_key or key), "page", F.col("bits").alias("__r"))
    return left.join(other, [*(right_key or key), "page"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("__r"))).drop("__r").where("bits <> 0").select(*left.columns)


def minus(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Dates of left that are not in right's set of the same key."""
    other = right.select(*key, "page", F.col("bits").alias("__r"))
    kept = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("__r", F.lit(0).cast("bigint"))))
    return left.join(other, [*key, "page"], "left").withColumn("bits", kept).drop("__r").where("bits <> 0").select(*left.columns)


def dates_of(page: Column, bits: Column) -> Column:
    """The dates of one page, as an array."""
    on = F.filter(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda k: F.call_function("shiftright", bits, k.cast("int")).bitwiseAND(F.lit(1)) == 1)
    return F.transform(on, lambda k: F.date_from_unix_date((page * PAGE + k).cast("int")))


def dates(sets: DataFrame, key: list[str]) -> DataFrame:
    """(key.., date) of sets."""
    return sets.select(*key, F.explode(dates_of(F.col("page"), F.col("bits"))).alias("date"))


def signed(sets: DataFrame, key: list[str], keep: bool = False) -> DataFrame:
    """(key.., days, signature): one row a set, with its number of days and a text that equal sets share; kept, its pages and bits as `pages`."""
    one = sets.groupBy(*key).agg(F.sum(F.bit_count("bits")).alias("days"), F.array_sort(F.collect_list(F.struct("page", "bits"))).alias("pages"))
    said = F.array_join(F.transform("pages", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), F.hex(x["bits"]))), ",")
    return one.select(*key, "days", said.alias("signature"), *(["pages"] if keep else []))


def digest(signature: Column) -> Column:
    """A short name of a set."""
    return F.substring(F.sha2(signature, 256), 1, 16)
