"""A training corpus from `documents`: five stages, each applying one corpus operator.

1. language_id     texts whose language is rejected go (no letter, or a score no right row has)
2. ngram_jaccard   of each group of near duplicates the document with the smallest id stays
3. secret_scans    found secrets are redacted in the text; every document stays
4. source_mix      sources are mixed to their target words: a document comes 0 to 3 times
5. byte_bpe        the mixed documents are encoded

All but the last return the columns of documents. Defined results: nulls in any column pass
through, a null text is rejected in stage 1; a null id is a document of its own; an empty
table stays empty.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.llm import bpe, jaccard, langid, mixing, secrets
from waymesh.llm._shared import stash, table, without_ids
from waymesh.llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(langid.in_training()))
    return langid.accepted(docs, model)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.components(docs.where(F.col("doc_id").isNotNull()))
    gone = stash(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return without_ids(docs, gone, "doc_id")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, mixing.weigh_in_turn)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # four stages have filled the executors' heaps by now: half the pieces are remembered
    return bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, remembered=bpe.REMEMBERED // 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Neither the classifier nor the merges can be said in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
