"""Exact nearest-neighbour search by cosine distance.

One query runs as a column expression under a top-k. Many queries run as a grid
of bounded blocks: each task multiplies one block of query vectors with one
block of fact vectors and keeps ``k`` facts per query, so neither a large
organisation nor a popular channel ends up in one task and no table of all
pairs is ever written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import DIGITS, cosine_distance
from .access import access_class, visible_to, with_access_classes, with_source
from .grouping import first_k, fresh_keys

FACT_BLOCK = 10_000
QUERY_BLOCK = 4_000
CHUNK = 256


def searchable(facts: DataFrame) -> DataFrame:
    """Facts that are active and carry a vector."""
    return facts.filter(F.col("superseded_at").isNull() & F.col("embedding").isNotNull())


def with_distance(facts: DataFrame, vector: Column) -> DataFrame:
    """Replaces the vector of each fact by its distance to ``vector``, a literal or scalar subquery."""
    placed = facts.withColumn("asked_", vector)
    return placed.withColumn("distance", cosine_distance(F.col("embedding"), F.col("asked_"))).drop("embedding", "asked_")


def nearest(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)


def top_k(facts: DataFrame, sources: DataFrame, org_id: str, vector: Column, k: int = 5) -> DataFrame:
    """The ``k`` nearest facts of one organisation. Sources are joined to the ``k`` rows only."""
    hits = nearest(with_distance(searchable(facts).filter(F.col("org_id") == org_id), vector), k)
    return with_source(hits, sources, "permalink", "source_type")


def top_k_visible(
    facts: DataFrame, sources: DataFrame, memberships: DataFrame,
    org_id: str, user_id: str, vector: Column, k: int = 5,
) -> DataFrame:
    """``top_k`` over the facts the user may see.

    The distance replaces the vector before the join, so the shuffle moves a
    number instead of the vector.
    """
    near = with_distance(searchable(facts).filter(F.col("org_id") == org_id), vector)
    placed = with_source(near, sources, "permalink", "source_type", "channel_id", "channel_is_private")
    seen = visible_to(placed, memberships, org_id, user_id)
    return nearest(seen, k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    flat = np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(array), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / length


def _block_top_k(k: int, schema: pa.Schema):
    """Nearest facts of every query of a block among the facts of a block."""

    def run(facts: pa.Table, queries: pa.Table) -> pa.Table:
        if not facts.num_rows or not queries.num_rows:
            return schema.empty_table()
        f_id = facts.column("fact_id").to_numpy()
        f_seq = facts.column("fact_seq").to_numpy()
        q_id = queries.column("query_id").to_numpy()
        q_seq = queries.column("query_seq").to_numpy()
        f_unit, q_unit = _unit(_matrix(facts.column("vector"))), _unit(_matrix(queries.column("vector")))
        out_q, out_f, out_d = [], [], []
        for at in range(0, len(q_id), CHUNK):
            dist = np.round(1.0 - q_unit[at:at + CHUNK] @ f_unit.T, DIGITS)
            dist[np.isnan(dist)] = np.inf
            barred = f_seq[None, :] >= q_seq[at:at + CHUNK, None]
            for row in range(dist.shape[0]):
                allowed = np.flatnonzero(~barred[row])
                d = dist[row, allowed]
                if len(d) > k:
                    keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    allowed, d = allowed[keep], d[keep]
                best = np.lexsort((f_id[allowed], d))[:k]
                out_q.append(np.full(len(best), q_id[at + row]))
                out_f.append(f_id[allowed[best]])
                out_d.append(d[best])
        return pa.table(
            [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_f)), pa.array(np.concatenate(out_d))],
            schema=schema,
        )

    return run


def top_k_many(
    queries: DataFrame, facts: DataFrame, keys: list[str], k: int = 5,
    query_seq: str | None = None, fact_seq: str | None = None,
    fact_block: int = FACT_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` nearest facts of every query with equal ``keys``.

    ``queries`` has ``query_id`` and ``vector``; ``facts`` has ``id`` and
    ``embedding``; ids are integers. With sequence columns a query only meets
    facts of a lower sequence number. Returns ``query_id, id, distance, rank``.
    """
    low, high = -(2**62), 2**62
    # Fresh aliases, so that both sides may come from one table.
    own_keys = [F.col(c).alias(c) for c in keys]
    f = facts.select(
        *own_keys, F.col("id").cast("bigint").alias("fact_id"),
        F.col("embedding").cast("array<float>").alias("vector"),
        (F.col(fact_seq).cast("bigint") if fact_seq else F.lit(low)).alias("fact_seq"),
    ).filter(F.col("vector").isNotNull())
    q = queries.select(
        *own_keys, F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"),
        (F.col(query_seq).cast("bigint") if query_seq else F.lit(high)).alias("query_seq"),
    ).filter(F.col("vector").isNotNull())

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    # Vectors of different lengths never meet.
    f, q = (side.withColumn("dim", F.size("vector").cast("string")) for side in (f, q))
    keys = [*keys, "dim"]
    # One small row per key: how many blocks each side of its grid has.
    grid = fresh_keys(blocks(f, fact_block, "fact_blocks").join(blocks(q, query_block, "query_blocks"), keys), *keys)
    ids = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    f_cells = (
        f.join(grid, keys)
        .withColumn("fb", F.pmod(F.xxhash64("fact_id"), F.col("fact_blocks")).cast("int"))
        .withColumn("qb", ids("query_blocks")).drop("fact_blocks", "query_blocks")
    )
    q_cells = (
        q.join(grid, keys)
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
        .withColumn("fb", ids("fact_blocks")).drop("fact_blocks", "query_blocks")
    )
    out = T.StructType([
        T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()),
        T.StructField("distance", T.DoubleType()),
    ])
    arrow = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    cell = [*keys, "fb", "qb"]
    hits = f_cells.groupBy(*cell).cogroup(q_cells.groupBy(*cell)).applyInArrow(_block_top_k(k, arrow), out)
    # A query that meets several groups of facts (grid blocks, audiences) merges here.
    return first_k(hits, ["query_id"], [F.col("distance"), F.col("id")], k)


def top_k_many_visible(
    questions: DataFrame, facts: DataFrame, sources: DataFrame, memberships: DataFrame, k: int = 5, **grid
) -> DataFrame:
    """``top_k_many`` where each question's user sees only their channels' facts.

    Facts are grouped by audience and each question joins the audiences of its
    user, which turns the access rule into an equi join.
    """
    placed = with_source(
        searchable(facts).select("org_id", "id", "embedding", "source_id"), sources, "channel_id", "channel_is_private"
    )
    classed = placed.withColumn("access_class", access_class())
    asked = with_access_classes(questions, memberships)
    return top_k_many(asked, classed, ["org_id", "access_class"], k, **grid)


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 1536, embed_fn=None) -> DataFrame:
    """Vector of a text column.

    ``embed_fn`` takes a pandas Series of texts and returns one of float lists;
    it runs batch-wise on the executors. Without it, words are hashed into
    ``dim`` counts and scaled to unit length, which needs no model.
    """
    if embed_fn is not None:
        return df.withColumn(out_col, F.pandas_udf(embed_fn, T.ArrayType(T.FloatType()))(F.col(text_col)))
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(inputCol="words_", outputCol="counts_", numFeatures=dim).transform(df.withColumn("words_", words))
    scaled = Normalizer(inputCol="counts_", outputCol="scaled_").transform(counted)
    return scaled.withColumn(
        out_col, F.when(F.size("words_") > 0, vector_to_array(F.col("scaled_"), "float32"))
    ).drop("words_", "counts_", "scaled_")
