"""From raw documents to token ids: language, toxicity, near-duplicates, mixture, encoding.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``docs``, so that each can be written and read again as the next one's input.
``run`` does so in the shared folder.

Defined cases: a stage on an empty table gives an empty one. Rows without an id
pass the near-duplicate stage; equal rows count as copies there, one stays. Other
columns of any name pass through all stages but the last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import bpe, language, minhash_forest, mixing, toxicity
from factlake.llm.common import fold, sieved, stored
from factlake.llm.queries import RANK_FILE
from factlake.session import tune

OWN = ("doc_id", "text", "lang", "source")


def hiding(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on columns with names of their own: no other column of ``docs`` can meet a name that a stage uses."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"__kept_{i}__" for i, c in enumerate(docs.columns)}
        hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        return stage(spark, hidden, sf_dir).select(*[F.col(n).alias(c) for c, n in names.items()])

    return run


@hiding
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised."""
    tune(spark)
    model = language.learn(docs.filter(fold("doc_id", 4) != 2), "doc_id", "text", "lang")
    judged = language.predict(docs, docs.columns, "text", model, reject=True)
    return judged.filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


@hiding
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic."""
    tune(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, "doc_id", "text", "toxic", may_learn=fold("doc_id", 5) != 0)
    return toxicity.score(docs, docs.columns, "text", model).filter("predicted = 0").select(*docs.columns)


@hiding
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    tune(spark)
    found = stored(minhash_forest.near_duplicates(docs, "doc_id", "text").filter("doc_id IS NOT NULL"), "pipeline-groups")
    by_id = found.groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("rows"))
    # Most documents are the only ones of their group: they stay where they are.
    looked_at = by_id.filter("NOT stays OR rows > 1")
    maybe, alone = sieved(docs, "doc_id", looked_at.select("doc_id"))
    leaving = looked_at.filter("NOT stays").select("doc_id")
    once = (maybe.filter("doc_id IS NOT NULL").join(leaving, "doc_id", "left_anti")
            .withColumn("__row__", F.xxhash64(*docs.columns)).dropDuplicates(["doc_id", "__row__"]))
    return alone.unionByName(once.select(*docs.columns)).unionByName(maybe.filter("doc_id IS NULL"))


@hiding
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes and repeats documents so that the sources come to their target weights."""
    tune(spark)
    return mixing.mixture(docs, "doc_id", "text", "source")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoding, for each document."""
    tune(spark)
    return bpe.round_trip(docs, ["doc_id", "source"], "text", public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The models of the first two stages can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
