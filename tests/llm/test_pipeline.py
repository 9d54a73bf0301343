import hashlib
import random
import string

import corpus_pipeline as cp
import tiktoken
from pyspark.sql import functions as F

from factlake.llm import bpe, language, mixing, toxicity

from .test_minhash_forest import brute

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {"": docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    before, spoken, clean, single, mix = (kept[k] for k in ("", "language", "toxicity", "near_dedup", "mixing"))
    assert {r.doc_id for r in before} - {r.doc_id for r in spoken} == {r.doc_id for r in before if not language.has_letter(r.text)}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in spoken} - {r.doc_id for r in clean}
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(labels)
    groups = brute([(r.doc_id, r.text) for r in clean])
    assert sorted(r.doc_id for r in single) == sorted(i for i, _, c in groups if i == c)
    sizes, taken = {}, {}
    for r in single:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    for r in mix:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").encode().split())
    longest = max(len((r.text or "").encode().split()) for r in single)
    for source, target in mixing.shares(sizes).items():
        assert abs(taken.get(source, 0) - target) <= longest / 2 + 1
    path, pattern = cp.public_tokenizers.path(cp.RANK_FILE), cp.public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    want = []
    for r in mix:
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, r.source, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                     hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(want)
    assert toxicity.CALM > 0


def test_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "the cat", "en", "b", 7), (3, "the cat", "en", "b", 7),
         (None, "der Hund", "de", None, 8), (4, "the cat", "en", "b", 7), (5, "le chat", "fr", "a", 7)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for one in (docs, docs.filter("false")):
        for name, stage in cp.STAGES:
            out = stage(spark, one, SF)
            ids = sorted((r.doc_id or 0) for r in out.collect())
            if name == "language" and one is docs:
                assert ids == [0, 3, 3, 4, 5]
            if name == "near_dedup" and one is docs:
                assert ids == [0, 1, 2, 3, 5]
            if one is not docs:
                assert not ids


CLASHES = ["score", "predicted", "lang_pred", "cut", "rest", "whole", "before", "ahead", "row_hash", "sieve_at", "mix_times", "mix_order", "kept",
           "component_id", "n_shingles", "picked", "mark", "size", "block", "known share"]


def test_columns_of_any_name_pass(spark):
    """The same documents with and without other columns, whose values stay with their documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.select("*", *[F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")).alias(name) for name in CLASHES])
    for name, stage in cp.STAGES[:-1]:
        plain, out = stage(spark, docs, "/root/testdata/sf0.001").collect(), stage(spark, more, "/root/testdata/sf0.001")
        assert out.columns == more.columns
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain) and rows, name
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES), name


def test_other_languages_are_dropped(spark):
    """Texts in no learned language go, held-out ones of the learned languages stay."""
    rng = random.Random(3)
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "for (int i = 0; i < n; ++i) { if (buf[i] != NULL && buf[i]->len > 0x7f) { memcpy(dst + off, buf[i]->p, sizeof(*q)); } }",
        *(" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(30)) for _ in range(5)),
        "".join(rng.choices(string.ascii_lowercase, k=200)),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    kept = {r.doc_id for r in cp.known_language(spark, docs.unionByName(more, allowMissingColumns=True), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if language.has_letter(r.text)}
