"""Exact length histogram of encoded documents.

Documents are aggregated by (group, encoded length); suffix sums over the distinct lengths
then answer, for every context limit, how many documents exceed it, how many tokens remain
after truncation, and the length quantiles. The histogram has one row per distinct length,
and its suffix sums are made in two steps (spans of lengths, then lengths in a span), so no
task ever holds all lengths.

Defined results: a null text has length 0; an empty table gives an empty histogram.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from ._shared import stash

#: Lengths in one span of the two-step suffix sums.
SPAN = 128


def length_histogram(docs: DataFrame, path: str, pattern: str, text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """(grp, n_tokens, n_docs): the exact histogram."""
    counted = bpe.count_tokens(docs, path, pattern, text_col, group_col).groupBy("grp", "n_tokens").agg(F.count("*").alias("n_docs"))
    return stash(counted, "lengths")  # suffix sums read it several times; encoding again would cost most


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to (grp, n_tokens, n_docs) what each context limit n_tokens means.

    tokens: tokens of documents of just this length; docs_longer, tokens_longer: of strictly
    longer documents; truncated_total: tokens left when every document is cut at n_tokens;
    docs_total, tokens_total: of the whole group.
    """
    rows = histogram.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "span": F.floor(F.col("n_tokens") / SPAN)})
    key = F.coalesce(F.concat(F.lit("="), "grp"), F.lit(""))
    rows = rows.withColumn("k", key)
    spans = rows.groupBy("k", "span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.partitionBy("k").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("k")
    spans = spans.select(
        "k", "span",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("span_docs"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("span_tokens"),
        F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("k", "span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"in_docs": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "in_tokens": F.coalesce(F.sum("tokens").over(inside), F.lit(0))}).join(spans, ["k", "span"])
    longer = F.col("in_docs") + F.col("span_docs")
    longer_tokens = F.col("in_tokens") + F.col("span_tokens")
    return out.select(
        "grp", "n_tokens", "n_docs", "tokens", longer.alias("docs_longer"), longer_tokens.alias("tokens_longer"),
        (F.col("tokens_total") - longer_tokens + longer * F.col("n_tokens")).alias("truncated_total"), "docs_total", "tokens_total",
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(grp, share, n_tokens): the smallest length that at least `share` of the documents do not exceed."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    up_to = F.col("docs_total") - F.col("docs_longer")
    return sums.select("grp", "n_tokens", up_to.alias("up_to"), "docs_total", wanted).where(F.col("up_to") >= F.col("share") * F.col("docs_total")).groupBy("grp", "share").agg(F.min("n_tokens").alias("n_tokens"))


def truncated(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(grp, context, tokens_kept, docs_cut) for any context limits, also lengths no document has."""
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])).alias("context")
    rows = sums.select("grp", "n_tokens", "n_docs", "tokens", wanted)
    cut = F.col("n_tokens") > F.col("context")
    return rows.groupBy("grp", "context").agg(
        F.sum(F.when(cut, F.col("context") * F.col("n_docs")).otherwise(F.col("tokens"))).alias("tokens_kept"),
        F.coalesce(F.sum(F.when(cut, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
    )
