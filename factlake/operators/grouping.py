"""Grouping helpers that stay correct and fast when one key holds most rows.

A window over a hot key runs in one task, and so does an ordered text
aggregate. The helpers here cut such groups into ordered slices first, so that
no task sees more than a slice, and give the same rows as the plain form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

MAX_ROWS = 100_000


def fresh_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Text keys computed anew, so that a join shuffles this side again.

    An aggregate is already partitioned by its keys and a join would take it as
    it is; AQE splits a hot key only where both sides were shuffled for the join.
    """
    return df.withColumns({k: F.concat(F.col(k), F.lit("")) for k in keys})


def group_ordinal(
    df: DataFrame,
    keys: list[str],
    slices: list[tuple[str, Column, bool]],
    order: list[Column],
    name: str = "ordinal",
) -> DataFrame:
    """1-based row number inside ``keys`` without one task per key.

    ``slices`` lists ``(column, expression, ascending)``: a coarsened prefix of
    ``order``, such as the hour of a timestamp. Rows are numbered inside each
    slice, and the slice counts, one row each, give the offset.
    """
    names = [c for c, _, _ in slices]
    sliced = df.withColumns({c: e for c, e, _ in slices})
    by_slice = Window.partitionBy(*keys).orderBy(
        *[F.col(c).asc() if up else F.col(c).desc() for c, _, up in slices]
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, *names).agg(F.count("*").alias("n"))
        .select(*keys, *names, F.coalesce(F.sum("n").over(by_slice), F.lit(0)).alias("offset"))
    )
    local = sliced.withColumn(
        "local_no", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    )
    offsets = offsets.select(*[F.col(c).alias(f"o_{c}") for c in keys + names], "offset")
    on = reduce(lambda a, b: a & b, [local[c].eqNullSafe(offsets[f"o_{c}"]) for c in keys + names])
    return (
        local.join(offsets, on)
        .withColumn(name, F.col("offset") + F.col("local_no"))
        .drop("local_no", "offset", *names, *[f"o_{c}" for c in keys + names])
    )


AT, PART = "__at__", "__part__"


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows dealt into ranges of ``(keys, order)`` of about equal size and sorted there, with their ``PART`` and place ``AT``.

    A key may span any number of ranges. Ranges come from a sample and differ
    from run to run, so the placed rows are written to the shared folder once.
    Rows equal in all of ``keys`` and ``order`` lie in one range.
    """
    place = [*keys, *order]
    placed = stored(df.repartitionByRange(*place).sortWithinPartitions(*place).withColumn(AT, F.monotonically_increasing_id()), "ranges")
    # The upper bits of the id are the range.
    return placed.withColumn(PART, F.shiftright(AT, 33))


def with_pieces(placed: DataFrame, keys: list[str], pieces: DataFrame) -> DataFrame:
    """``placed`` with what ``pieces`` says of its range and keys."""
    named = pieces.select(F.col(PART).alias("__in__"), *[F.col(f"`{k}`").alias(f"__key_{k}") for k in keys],
                          *[c for c in pieces.columns if c not in (PART, *keys)])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], F.col(PART) == F.col("__in__"))
    return placed.join(named, on, "left").drop("__in__", *[f"__key_{k}" for k in keys])


def range_ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """1-based row number inside ``keys`` in ``order``, whatever the values and however many rows a key has.

    A row's place in its range is known without a window; how many rows a key
    has in each range, one number per pair, gives the rows before it. The
    numbers don't depend on the ranges as long as ``order`` is total.
    """
    first, n, before = "__first__", "__n__", "__before__"
    placed = in_ranges(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(PART, *keys).agg(F.min(AT).alias(first), F.count("*").alias(n)).withColumn(
        before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    return with_pieces(placed, keys, pieces).withColumn(name, F.col(before) + F.col(AT) - F.col(first) + 1).select(*df.columns, name)


def range_sum_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same keys; no task sees more of a key than a range."""
    before = "__before__"
    placed = in_ranges(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(PART, *keys).agg(F.sum(value).alias("__n__")).withColumn(
        before, F.coalesce(F.sum("__n__").over(earlier), F.lit(0))).drop("__n__")
    here = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__here__", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return with_pieces(local, keys, pieces).withColumn(name, F.col(before) + F.col("__here__")).select(*df.columns, name)


def range_least_after(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Least ``value`` over this and the later rows of the same keys (null: none); no task sees more of a key than a range.

    Windows run from the last row to the first: Spark carries a sum or a least value
    along a window of all rows before, but computes one of all rows after anew for each row.
    """
    after = "__after__"
    placed = in_ranges(df, keys, order)
    later = Window.partitionBy(*keys).orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(PART, *keys).agg(F.min(value).alias("__n__")).withColumn(after, F.min("__n__").over(later)).drop("__n__")
    here = Window.partitionBy(PART, *keys).orderBy(F.col(AT).desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("__here__", F.min(value).over(here))
    return with_pieces(local, keys, pieces).withColumn(name, F.least("__here__", after)).select(*df.columns, name)


def id_slice(col: str, width: int = MAX_ROWS) -> tuple[str, Column, bool]:
    """Slice on an integer column; ``width`` is the range of values it spans."""
    return ("slice_no", F.floor(F.col(col) / width), True)


def ordered_texts(
    df: DataFrame, keys: list[str], slices: list[tuple[str, Column, bool]], order: str,
    texts: dict[str, tuple[str, str]], also: list[tuple[str, Column, Column]] | None = None,
) -> DataFrame:
    """One row per group with its lines joined in ``order``, by one rule at every size.

    ``texts`` maps an output column to the line (SQL) and its separator. Lines
    are sorted and joined slice by slice (see ``group_ordinal`` for ``slices``),
    then the slices are joined, so that no task sorts the lines of a whole large group.
    ``also`` adds aggregates: name, the aggregate of rows, the aggregate of slices.
    """
    also = also or []
    names = [c for c, _, _ in slices]
    pieces = df.withColumns({c: e for c, e, _ in slices}).groupBy(*keys, *names).agg(
        *[joined_lines(line, order, sep, name) for name, (line, sep) in texts.items()], *[rows.alias(name) for name, rows, _ in also])
    by = ", ".join(c if up else f"{c} DESC" for c, _, up in slices)
    return pieces.groupBy(*keys).agg(
        *[joined_lines(name, by, sep, name) for name, (_, sep) in texts.items()], *[parts.alias(name) for name, _, parts in also])


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group with their rank.

    Each map task keeps ``k`` rows per group before the shuffle, so a hot group
    arrives as at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def joined_lines(text: str, order: str, sep: str = "\\n", name: str = "text") -> Column:
    """Ordered text aggregate. ``order`` must be total for the result to be fixed."""
    return F.expr(f"listagg({text}, '{sep}') WITHIN GROUP (ORDER BY {order})").alias(name)
