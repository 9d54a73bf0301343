"""The operators applied to the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bit_whitening, bpe, fingerprint, language, minhash_forest, mixing, pair_ranking, pitman_yor, prefix_forest,
               token_align, toxicity, url_filter, warc_derive)
from .common import fold
from .url_filter import Rule

RANK_FILE = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and their decoding, as digests."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), ["doc_id"], "text",
                          public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


#: The rules of the query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@_query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), ["page_id"], "url", RULES)


SQL["op6_url_filter"] = url_filter.duck_sql(RULES)


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.report(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@_query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = language.learn(docs.filter(~F.col("held_out")), "doc_id", "text", "lang")
    return language.predict(docs, ["doc_id", "held_out"], "text", model)


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labels."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", may_learn=fold("doc_id", 5) != 0)
    return toxicity.score(docs, ["doc_id", "held_out"], "text", model)


@_query
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return fingerprint.compare_edits(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    rows = _table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding")


@_query
def op3_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    made = warc_derive.derive(warc_derive.responses(_table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return made.withColumnRenamed("source_key", "page_id")


SQL["op3_warc_derive"] = warc_derive.DUCK_SQL


@_query
def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from six sevenths of them."""
    return pitman_yor.score(_table(spark, sf_dir, "documents"), "doc_id", "text", fold("doc_id", 7) == 2)


@_query
def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens in two vocabularies."""
    return token_align.align(_table(spark, sf_dir, "documents"), ["doc_id"], "text",
                             public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op13_bit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight strongest components; a deviation beyond 64 bits is only in ``deviation_exact``."""
    made = bit_whitening.whiten(_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    return made.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@_query
def op11_pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four fifths of the labels."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = pair_ranking.learn(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "quality", may_learn=fold("doc_id", 5) != 0)
    return pair_ranking.score(docs, ["doc_id", "held_out"], "text", model)
