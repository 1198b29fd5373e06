"""Corpus pipeline: from raw documents to encoded training text, as five stages over stored tables.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the
columns of ``docs``.

1. language: texts in which no language can be told (null, or without a letter) go.
2. exact_dedup: of equal texts the longest stays.
3. near_dup: of each class of near-duplicates the document with the smallest id stays.
4. mixing: a document stands as often as the mix draws it (0, 1 or 2 times).  The document at the border of a
   source's target stays whole, so a source may pass its target by a part of one document.  Rows that share an id
   are drawn alike.
5. encode: ids of each text, decoded again; one row of digests for each row of the mix.

Nulls in other columns pass through; empty tables give empty tables; repeated rows fall to one in the
second stage; extra columns stay until the fourth stage, whatever their names.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegauge.llm import exact_dedup, language, mixing, near_dup, sentencepieces  # noqa: E402
from tidegauge.llm.common import free, table  # noqa: E402
from tidegauge.plans.stage import materialise  # noqa: E402


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told, score = free(docs, language.PREDICTED, language.SCORE)
    rows = language.predict(docs, language.learn(docs, language.teaches("doc_id")), keep=docs.columns, names=(told, score))
    return rows.filter(F.col(told) != language.UNKNOWN).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, times, time = free(docs, "__id", "__times", "__time")
    drawn = mixing.mix(docs).groupBy(F.col("doc_id").alias(own)).agg(F.max(F.size("draws")).alias(times)).filter(F.col(times) > 0)
    rows = docs.join(drawn.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)))
    return rows.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dup", without_near_copies),
    ("mixing", mixed),
    ("encode", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
