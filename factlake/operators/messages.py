"""Message cleaning: noise filter, footer strip, thread bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .grouping import MAX_ROWS, id_slice, ordered_texts


def noise_reasons(messages: DataFrame) -> DataFrame:
    return messages.withColumn(
        "skip_reason", X.skip_reason(F.col("content"), F.col("subtype"), F.col("user_id"))
    )


def drop_noise(messages: DataFrame) -> DataFrame:
    return noise_reasons(messages).filter(F.col("skip_reason").isNull()).drop("skip_reason")


def clean(messages: DataFrame) -> DataFrame:
    return messages.withColumn("content", X.clean_text(F.col("content")))


def is_reply() -> Column:
    """A message in a thread other than the one that opened it."""
    return (F.coalesce(F.col("thread_ts"), F.lit("")) != "") & ~F.col("thread_ts").eqNullSafe(F.col("ts"))


def bundle_threads(messages: DataFrame, order_id: str = "msg_id", slice_width: int = MAX_ROWS) -> DataFrame:
    """One row per standalone message and one per thread of replies.

    Replies are joined in ``order_id`` order; the other columns come from the
    first of them. ``part`` is always 0: a thread is one row however long it is.
    """
    keys = ["org_id", "channel_id", "thread_ts"]
    rest = [c for c in messages.columns if c not in (*keys, "content", order_id)]
    bundles = ordered_texts(
        messages.filter(is_reply()), keys, [id_slice(order_id, slice_width)], order_id, {"body": ("content", "\\n---\\n")},
        [("first", F.min_by(F.struct(order_id, *rest), F.col(order_id)), F.min_by("first", F.col(f"first.{order_id}"))),
         ("replies", F.count("*"), F.sum("replies"))],
    ).select(
        f"first.{order_id}", *keys, F.lit(0).cast("bigint").alias("part"), "replies", *[f"first.{c}" for c in rest],
        F.concat(F.lit("[Thread]\n"), "body").alias("content"),
    )
    standalone = messages.filter(~is_reply()).withColumns(
        {"part": F.lit(0).cast("bigint"), "replies": F.lit(0).cast("bigint")}
    )
    return standalone.unionByName(bundles)


def clean_messages(messages: DataFrame, order_id: str = "msg_id", slice_width: int = MAX_ROWS) -> DataFrame:
    """Filter, then strip footers, then bundle; text that a footer filled alone stays empty."""
    return bundle_threads(clean(drop_noise(messages)), order_id, slice_width)
