"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources that hold
them). Flow runs from the patterns to the sources' quotas: the first pass over
a pattern's tokens is free and each repetition costs more than the one before,
so no text is repeated while fresh text can fill the quota. Only the table of
patterns, one row each, comes to the driver. Documents are then picked in a
seeded order until a pattern's share is used up.

Picking needs a running total per pattern, which a hot pattern must not bring
into one task: sizes are summed in 4,096 buckets of the seeded order, whole
buckets before the cut are taken as they are, and only the bucket with the cut
is put in order.

Defined cases: a document with no member source is never taken; null is a
source like any other, after the named ones; a text without words has size 0;
repeated rows are documents of their own, and of rows that share an id the order
follows size and a hash of the row; an empty table gives no rows. More than
``MAX_PATTERNS`` patterns are refused: their table is what the driver holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEED = 20_240_601
REPEATS = 3
MAX_PATTERNS = 100_000

Pattern = tuple[str | None, ...]


def word_count(text: Column) -> Column:
    """Runs of characters other than space and ``\\x09`` to ``\\x0D``; 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(plain, " "), lambda w: w != "")), F.lit(0)).cast("bigint")


def shares(sizes: Mapping[str | None, int], weights: Sequence[float] = (1, 2, 3), most: float = REPEATS) -> dict[str | None, float]:
    """Targets that share the sum of all sizes by weight, none above ``most`` times its source.

    Sources in order of code point, null last, take the weights in turn. What
    the capped ones can't use is shared by the others again.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_sources, target = float(sum(sizes.values())), set(order), {}
    while open_sources:
        total = sum(weight[s] for s in order if s in open_sources)
        part = {s: left * weight[s] / total for s in order if s in open_sources}
        over = [s for s in part if part[s] > most * sizes[s]]
        if not over:
            return target | part
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_sources.discard(s)
    return target


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class _Network:
    """Successive shortest paths on a small graph with whole-number costs."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.arcs[a].append(_Arc(b, room, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def used(self, arc: tuple[int, int]) -> int:
        own = self.arcs[arc[0]][arc[1]]
        return self.arcs[own.to][own.back].room

    def run(self, source: int, sink: int) -> None:
        while True:
            far = {source: 0}
            via: dict[int, tuple[int, _Arc]] = {}
            queue, queued = [source], {source}
            for node in queue:
                queued.discard(node)
                for arc in self.arcs[node]:
                    if arc.room and (new := far[node] + arc.cost) < far.get(arc.to, 1 << 62):
                        far[arc.to] = new
                        via[arc.to] = node, arc
                        if arc.to not in queued:
                            queued.add(arc.to)
                            queue.append(arc.to)
            if sink not in far:
                return
            path, node = [], sink
            while node != source:
                node, arc = via[node]
                path.append(arc)
            amount = min(arc.room for arc in path)
            for arc in path:
                arc.room -= amount
                self.arcs[arc.to][arc.back].room += amount


def flow(patterns: Mapping[Pattern, int], quotas: Mapping[str | None, int], repeats: int = REPEATS) -> dict[Pattern, dict[str | None, int]]:
    """Tokens that each pattern sends to each of its sources; the cheapest way to fill most of the quotas.

    The r-th pass over a pattern's tokens costs ``(r - 1) ** 2`` a token.
    """
    names, members = list(patterns), list(quotas)
    at = {s: 1 + len(names) + i for i, s in enumerate(members)}
    sink = 1 + len(names) + len(members)
    net = _Network(sink + 1)
    routes = {}
    for i, pattern in enumerate(names):
        for r in range(repeats):
            net.add(0, 1 + i, patterns[pattern], r * r)
        for source in pattern:
            if source in at:
                routes[pattern, source] = net.add(1 + i, at[source], repeats * patterns[pattern], 0)
    for source, quota in quotas.items():
        net.add(at[source], sink, quota, 0)
    net.run(0, sink)
    out: dict[Pattern, dict[str | None, int]] = {p: {} for p in names}
    for (pattern, source), arc in routes.items():
        out[pattern][source] = net.used(arc)
    return out


def routed(patterns: Mapping[Pattern, int], quotas: Mapping[str | None, int], repeats: int = REPEATS) -> dict[Pattern, dict[str | None, int]]:
    """``flow``, in which a source that shares no document needs no network: it gets its quota, or all its text ``repeats`` times."""
    shared = {s for p in patterns if len(p) > 1 for s in p}
    alone = {p: {p[0]: min(quotas[p[0]], repeats * n)} for p, n in patterns.items() if len(p) == 1 and p[0] not in shared}
    others = {p: n for p, n in patterns.items() if p not in alone}
    return alone | flow(others, {s: q for s, q in quotas.items() if s in shared}, repeats)


def pick(docs: DataFrame, key: str, size: Column, members: Column, weights: Sequence[float] = (1, 2, 3),
         repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with ``mix_times``, ``mix_size``, ``mix_source_size`` and ``mix_target``.

    ``members`` is an array of source names. The last two are of the first
    source, and null without one. ``docs`` is read twice.
    """
    spark = docs.sparkSession
    marked = docs.withColumns({
        "mix_size": size,
        "mix_members": F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>")),
        "mix_order": F.xxhash64(F.lit(seed), F.col(key).cast("string")),
    }).withColumns({
        "mix_bucket": F.shiftrightunsigned("mix_order", 52),
        "mix_pattern": F.to_json(F.struct(F.col("mix_members").alias("m")), {"ignoreNullFields": "false"}),
    })
    buckets = stored(
        marked.groupBy("mix_pattern", "mix_members", "mix_bucket").agg(F.sum("mix_size").alias("held")), "mix-buckets")
    rows = (buckets.groupBy("mix_pattern", "mix_members").agg(F.sum("held").alias("held"))
            .limit(MAX_PATTERNS + 1).collect())
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows.sort(key=lambda r: r.mix_pattern)
    patterns = {tuple(r.mix_members): r.held for r in rows}
    sizes: dict[str | None, int] = {}
    for pattern, held in patterns.items():
        for source in pattern:
            sizes[source] = sizes.get(source, 0) + held
    target = shares(sizes, weights, repeats)
    sent = routed(patterns, {s: round(t) for s, t in target.items()}, repeats)
    plan = []
    for r in rows:
        total = sum(sent[tuple(r.mix_members)].values())
        whole, rest = divmod(total, r.held) if r.held else (0, 0)
        first = r.mix_members[0] if r.mix_members else None
        known = bool(r.mix_members)
        plan.append((r.mix_pattern, whole, rest, sizes[first] if known else None, target[first] if known else None))
    plan = spark.createDataFrame(
        plan, "mix_pattern string, __whole__ bigint, __rest__ bigint, mix_source_size bigint, mix_target double")
    so_far = Window.partitionBy("mix_pattern").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per pattern: the bucket of the seeded order in which its share ends.
    cuts = (
        buckets.withColumn("upto", F.sum("held").over(so_far)).join(F.broadcast(plan), "mix_pattern")
        .filter("upto >= __rest__").groupBy("mix_pattern")
        .agg(F.min_by(F.struct("mix_bucket", (F.col("upto") - F.col("held")).alias("before")), "mix_bucket").alias("found"))
        .select("mix_pattern", F.col("found.mix_bucket").alias("__cut__"), F.col("found.before").alias("__before__"))
    )
    # At most MAX_PATTERNS rows, counted above.
    plan = F.broadcast(plan.join(cuts, "mix_pattern", "left"))
    placed = marked.join(plan, "mix_pattern")
    inside = Window.partitionBy("mix_pattern").orderBy("mix_order", key, "mix_size", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).rowsBetween(Window.unboundedPreceding, -1)
    at_cut = placed.filter(F.col("mix_bucket") == F.col("__cut__")).withColumn(
        "__ahead__", F.col("__before__") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    # The document on the border is taken if that comes nearer to the share.
    at_cut = at_cut.withColumn("mix_times", F.col("__whole__") + F.when(
        (F.col("__rest__") > 0) & (F.col("mix_size") > 0) & (2 * (F.col("__rest__") - F.col("__ahead__")) >= F.col("mix_size")), 1).otherwise(0)).drop("__ahead__")
    others = placed.filter(F.coalesce(F.col("mix_bucket") != F.col("__cut__"), F.lit(True))).withColumn(
        "mix_times", F.col("__whole__") + F.when((F.col("__rest__") > 0) & (F.col("mix_bucket") < F.col("__cut__")), 1).otherwise(0))
    return at_cut.unionByName(others).select(
        *docs.columns, F.col("mix_times").cast("int").alias("mix_times"), "mix_size", "mix_source_size", "mix_target")


def mixture(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The mixed corpus: each document as often as it was picked, columns as before."""
    picked = pick(docs, key, word_count(F.col(text)), F.array(source))
    again = F.explode(F.array_repeat(F.lit(0), F.col("mix_times")))
    return picked.filter("mix_times > 0").select(*docs.columns, again.alias("mix_again")).drop("mix_again")


def report(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """What the mix takes of every document, in words."""
    sizes = stored(docs.select(key, source, word_count(F.col(text)).alias("size")), "mix-sizes")
    picked = pick(sizes, key, F.col("size"), F.array(source))
    return picked.select(key, "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                         (F.col("size") * F.col("mix_times")).alias("taken"))
