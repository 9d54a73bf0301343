import pyarrow as pa
import pytest

from factlake.llm import common
from factlake.llm.sampling import labelled_sample


def test_sieve_splits_rows(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id AS STRING) AS text").union(spark.createDataFrame([(None, "n"), (7, "again")], "id long, text string"))
    wanted = spark.range(0, 5000, 50).selectExpr("id AS key")
    maybe, no = common.sieved(df, "id", wanted)
    hits, rest = maybe.collect(), no.collect()
    assert len(hits) + len(rest) == 5002
    assert {i for i in range(0, 5000, 50)} <= {r.id for r in hits}
    assert len(hits) < 200, "few others pass"
    assert not {r.id for r in rest} & set(range(0, 5000, 50))
    maybe, no = common.sieved(df, "id", wanted.filter("false"))
    assert maybe.count() == 0 and no.count() == 5002


def test_values_of_texts(spark):
    df = spark.createDataFrame([(1, "ab", 5), (2, None, 6)], "id long, text string, size int")

    def of(texts):
        return [pa.array([len(t.as_py() or "") for t in texts], pa.int64())]

    assert [tuple(r) for r in common.with_values(df, ["id"], "text", "size bigint", of).collect()] == [(1, 2), (2, 0)]
    assert common.with_values(df, ["text", "id"], "text", "n bigint", of).columns == ["text", "id", "n"]
    with pytest.raises(ValueError):
        common.with_values(df, ["size"], "text", "size bigint", of)


def test_labelled_sample_is_bounded_and_repeatable(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'rare' WHEN id % 10 < 9 THEN 'common' END AS label")
    got = [labelled_sample(df.repartition(n), "id", "label", 100).collect() for n in (1, 7)]
    assert sorted(got[0]) == sorted(got[1])
    counts = {}
    for r in got[0]:
        counts[r.label] = counts.get(r.label, 0) + 1
    assert counts == {"rare": 100, "common": 100}
    assert labelled_sample(df.filter("false"), "id", "label", 5).count() == 0
    with pytest.raises(ValueError):
        labelled_sample(df, "id", "id", 5, 10)
