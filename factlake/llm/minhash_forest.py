"""Near-duplicates by a MinHash forest.

1. A text's set is its distinct word shingles. Texts with equal sets are one
   class; everything after works on classes.
2. A class's signature has ``TREES * DEPTH`` minima of hash functions. Each
   tree is a sorted order of the classes by its ``DEPTH`` minima. In a sorted
   order, the classes next to a class share the longest prefix with it: they are
   its candidates, however deep its region is, as long as they share ``LEAST`` minima.
   So a crowded region is compared at its deep prefixes and a sparse one at short ones.
3. Candidates whose signatures agree in at least ``LIKELY`` of the minima make
   clusters. The bound is far below the similarity asked for, so that a link is
   not lost to chance: what links is in one cluster.
4. In each cluster links are confirmed on full sets, made again from the whole
   texts. Two classes that are already connected need no test. A cluster of
   more than ``CHUNK`` classes is cut into chunks, each tested with the next, and
   what is then outside the cluster's largest component is tested against every chunk;
   so no pair of unconnected classes of a cluster goes untested, and no task holds a large group.

Defined cases: a text with fewer words than a shingle is one shingle as a
whole; a null text or one without words has an empty set and links with nothing;
a row without an id takes no part (its component is null); rows that share an id
are each judged by their own text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, sieved, stored, word_hashes
from .components import components

WORDS = 5
SIMILARITY = 75
TREES, DEPTH = 16, 6
LEAST = 2
NEAR = 2
LIKELY = 0.5
CHUNK = 256
SEED = 97
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _shingles(words: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, sorted by both, each once per row."""
    ends = np.cumsum(per_row)
    owner = np.repeat(np.arange(len(per_row)), per_row)
    left = ends[owner] - np.arange(len(words))
    short = per_row[owner] < size
    first = np.zeros(len(words), dtype=bool)
    first[(ends - per_row)[per_row > 0]] = True
    total = np.zeros(len(words), dtype=np.uint64)
    length = np.where(short, per_row[owner], size)
    with np.errstate(over="ignore"):
        for j in range(size):
            ahead = np.zeros_like(words)
            ahead[:max(0, len(words) - j)] = words[j:]
            inside = j < np.minimum(left, length)
            total += np.where(inside, mix(ahead + np.uint64(j + 1) * _SALT), np.uint64(0))
        total = mix(total + length.astype(np.uint64))
    whole = np.where(short, first, left >= size)
    total, owner = total[whole], owner[whole]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    fresh = np.ones(len(total), dtype=bool)
    fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[fresh], owner[fresh]


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields ``(first row, set size per row, sorted hashes row by row)``."""
    for first, per_row, words in word_hashes(texts):
        hashes, owner = _shingles(words, per_row, size)
        yield first, np.bincount(owner, minlength=len(per_row)), hashes


def class_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number per set, from all its hashes; 0 for the empty set."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    if len(starts):
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(hashes ^ _SALT), starts) + sizes[some].astype(np.uint64) * _SALT)
    return out.view(np.int64)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n).astype(np.uint64)


def signatures(hashes: np.ndarray, sizes: np.ndarray, n: int = TREES * DEPTH) -> np.ndarray:
    """``n`` 32-bit minima for each set that isn't empty, as rows."""
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    out = np.empty((n, len(starts)), dtype=np.uint32)
    if len(starts):
        with np.errstate(over="ignore"):
            for i, (a, b) in enumerate(zip(*_functions(n), strict=True)):
                out[i] = np.minimum.reduceat(((hashes * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return np.ascontiguousarray(out.T)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``id``, ``n``, ``class`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sizes, hashes in shingle_sets(batch.column(1), size):
                some = sizes > 0
                prints = signatures(hashes, sizes)
                keys, marks = np.full(len(sizes), None), np.full(len(sizes), None)
                keys[some] = [row.tobytes() for row in prints.astype(">u4")]
                marks[some] = [row.tobytes() for row in prints.astype("<u2")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(class_ids(hashes, sizes)),
                     pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], names=["id", "n", "class", "keys", "marks"])

    return docs.mapInArrow(run, "id bigint, n bigint, class bigint, keys binary, marks binary")


def _neighbours(classes: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes that stand next to each other in a tree and share ``LEAST`` minima."""
    width = 4 * DEPTH
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("keys", 1 + t * width, width).alias("key")) for t in range(TREES)]))
    rows = classes.select("class", trees.alias("t")).select("t.tree", "t.key", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = (np.asarray(batch.column(0)), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=f"S{4 * LEAST}").reshape(n, -1)[:, 0],
                   np.asarray(batch.column(2)))
            if kept is not None:
                own = tuple(np.concatenate([k, o]) for k, o in zip(kept, own, strict=True))
            tree, head, name = own
            for step in range(1, NEAR + 1):
                same = (tree[step:] == tree[:-step]) & (head[step:] == head[:-step])
                if kept is not None:
                    # Pairs within the rows carried over were given before.
                    same[:max(0, len(kept[0]) - step)] = False
                a, b = name[:-step][same], name[step:][same]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            kept = tuple(part[-NEAR:] for part in own)

    # The id of the class is part of the order, so that a run of equal keys can be cut anywhere.
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", "key", "class").sortWithinPartitions("tree", "key", "class")
    return ordered.mapInArrow(run, "a bigint, b bigint").filter("a != b").distinct()


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in at least ``LIKELY`` of the minima."""
    marks = classes.select(F.col("class").alias("name"), "marks")
    both = (pairs.join(marks, pairs["a"] == marks["name"]).select("a", "b", F.col("marks").alias("left"))
            .join(marks, F.col("b") == marks["name"]).select("a", "b", "left", F.col("marks").alias("right")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= LIKELY))

    return both.mapInArrow(run, "a bigint, b bigint")


def _link(names: np.ndarray, sets: list[np.ndarray], guests: np.ndarray, label: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links that connect what isn't connected yet; with guests, only pairs of a guest and another.

    ``label`` tells which are connected to begin with. For each set, the sizes of
    its intersections with all others are counted at once from the holders of its hashes.
    """
    n, links = len(names), []
    if not n:
        return links
    sizes = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(at, kind="stable")]
    held = np.bincount(at)
    first, ends = np.cumsum(held) - held, np.cumsum(sizes)
    joined = np.unique(label, return_inverse=True)[1]
    for i in np.flatnonzero(guests) if guests.any() else range(n):
        apart = joined != joined[i]
        if not apart.any():
            continue
        own = at[ends[i] - sizes[i]:ends[i]]
        many = held[own]
        places = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(holders[places], minlength=n)
        for j in np.flatnonzero(apart & (100 * shared >= similarity * (sizes[i] + sizes - shared))):
            if joined[j] != joined[i]:
                joined[joined == joined[j]] = joined[i]
                links.append((int(names[i]), int(names[j])))
    return links


def _confirm(rows: DataFrame, size: int, similarity: int) -> DataFrame:
    """Links within each (``cluster``, ``part``) of ``rows`` (with ``guest``, ``label``, ``class`` and ``text``)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        sets, found = [], []
        for _, sizes, hashes in shingle_sets(texts, size):
            ends = np.cumsum(sizes)
            sets += [hashes[e - n:e] for e, n in zip(ends, sizes, strict=True)]
            found.append(class_ids(hashes, sizes))
        names, guests = np.asarray(table["class"]), np.asarray(table["guest"])
        # A row that shares its id with another text is not the class that was looked up.
        right = np.flatnonzero(names == np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        # A class that is there as a guest and as a host is a guest.
        right = right[np.lexsort((~guests[right], names[right]))]
        right = right[np.unique(names[right], return_index=True)[1]]
        links = _link(names[right], [sets[i] for i in right], guests[right], np.asarray(table["label"])[right], similarity)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.select("cluster", "part", "guest", "label", "class", "text").groupBy("cluster", "part").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str, text: str, size: int = WORDS, similarity: int = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    sets = stored(_sets(docs, size), "minhash-sets")
    classes = stored(
        sets.filter("n > 0 AND id IS NOT NULL").groupBy("class")
        .agg(F.min("id").alias("first_id"), F.min_by("keys", "id").alias("keys"), F.min_by("marks", "id").alias("marks")), "minhash-classes")
    likely = _likely(_neighbours(classes), classes)
    clusters = stored(components(likely, "minhash-clusters"), "minhash-cluster-of")
    counted = clusters.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("held"))
    # About half a chunk in each part on average, so that two parts together stay near one chunk.
    spread = F.when(F.col("held") <= chunk, 1).otherwise(F.ceil(F.col("held") * 2 / chunk))
    members = (
        clusters.select(F.col("node").alias("class"), F.col("component").alias("cluster"))
        .join(counted, F.col("cluster") == F.col("of")).drop("of")
        .withColumn("chunks", spread.cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        .join(classes.select(F.col("class").alias("named"), F.col("first_id")), F.col("class") == F.col("named")).drop("named")
    )
    members = stored(members, "minhash-members")
    # Few texts are in a cluster; only those, and what the sieve lets through by chance, are shuffled.
    asked, _ = sieved(docs, "id", members.select("first_id"))
    texts = stored(members.join(asked, members["first_id"] == asked["id"]).drop("id", "first_id", "held"), "minhash-texts")
    fresh = texts.withColumns({"guest": F.lit(False), "label": F.col("class")})
    # Each chunk meets the next one; a cluster of one chunk is tested as it is.
    parts = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.array(F.col("chunk"), F.pmod(F.col("chunk") + F.col("chunks") - 1, F.col("chunks")))))
    joined = components(_confirm(fresh.withColumn("part", F.explode(parts)), size, similarity), "minhash-components")
    large = texts.filter("chunks > 1")
    if not large.isEmpty():
        more = stored(_rest(large, joined, size, similarity, chunk), "minhash-links")
        if not more.isEmpty():
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "minhash-components")
    owner = (
        classes.select("class", "first_id").join(joined, F.col("class") == F.col("node"), "left")
        .select("class", "first_id", F.coalesce("component", "class").alias("component"))
    )
    smallest = owner.groupBy(F.col("component").alias("of")).agg(F.min("first_id").alias("component_id"))
    named = owner.join(smallest, F.col("component") == F.col("of")).select(F.col("class").alias("named"), "component_id")
    out = sets.select("id", "n", "class").join(named, (F.col("class") == F.col("named")) & (F.col("n") > 0), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _rest(large: DataFrame, so_far: DataFrame, size: int, similarity: int, chunk: int) -> DataFrame:
    """Links of what is outside the largest component of a cut cluster, against all its chunks."""
    labelled = large.join(so_far, large["class"] == so_far["node"], "left").withColumn("label", F.coalesce("component", "class")).drop("node", "component")
    labelled = stored(labelled, "minhash-labelled")
    held = labelled.groupBy("cluster", "label").agg(F.count("*").alias("held"))
    most = held.groupBy(F.col("cluster").alias("of")).agg(F.max_by("label", F.struct("held", "label")).alias("most"))
    outside = labelled.join(most, F.col("cluster") == F.col("of")).filter("label != most").drop("of", "most")
    # Each outsider visits every chunk, in as many parts as keep a task near two chunks.
    n = outside.groupBy(F.col("cluster").alias("of")).agg(F.count("*").alias("out"))
    n = n.withColumn("rows", F.ceil(F.col("out") / chunk).cast("int"))
    guests = (
        outside.join(n, F.col("cluster") == F.col("of")).withColumns({
            "guest": F.lit(True), "row": F.pmod(F.xxhash64("class", F.lit(1)), F.col("rows")),
            "at": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    )
    hosts = (
        labelled.join(n, F.col("cluster") == F.col("of")).withColumns({
            "guest": F.lit(False), "row": F.explode(F.sequence(F.lit(0), F.col("rows") - 1)), "at": F.col("chunk")})
    )
    both = [d.withColumn("part", F.xxhash64(F.col("row").cast("int"), F.col("at").cast("int"))).select("cluster", "part", "guest", "label", "class", "text") for d in (guests, hosts)]
    return _confirm(both[0].unionByName(both[1]), size, similarity)
