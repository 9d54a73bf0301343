"""Bounded, repeatable samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, key: str, label: str, per_label: int, max_labels: int = 1000) -> DataFrame:
    """At most ``per_label`` rows of ``docs`` with each label, the first in a hashed order of the key.

    The ids are picked first, from two columns, and are few enough to broadcast:
    at most ``per_label * max_labels``, which is checked. ``docs`` must hold only
    rows that may be learned from. Rows that share a picked id all come along.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label)
    sizes = known.groupBy(label).agg(F.count("*").alias("held")).limit(max_labels + 1).collect()
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    # A cut in the hashed order leaves about four times what is wanted, so that no
    # label, however common, brings all its rows to one task to be ranked.
    cuts = spark.createDataFrame([(r[0], min(1.0, 4 * per_label / r.held)) for r in sizes],
                                 known.select(F.col(label).alias("named"), F.lit(0.0).alias("part")).schema)
    place = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 11) / float(1 << 53)
    ranked = Window.partitionBy(label).orderBy("place", key)
    ids = (
        known.withColumn("place", place).join(F.broadcast(cuts), known[label] == F.col("named"))
        .filter(F.col("place") < F.col("part")).select(key, label, "place").distinct()
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= per_label)
        .select(F.col(key).alias("picked")).distinct().collect()
    )
    picked = spark.createDataFrame(ids, docs.select(F.col(key).alias("picked")).schema)
    return docs.join(F.broadcast(picked), docs[key] == F.col("picked"), "left_semi")
