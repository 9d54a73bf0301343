"""Tables that are folders of files, as larger ones are, where smaller ones are single files."""

import os

import pytest

from factlake.plans import catalog  # noqa: F401
from factlake.plans.registry import BASE, QUERIES, StreamTables, Tables
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, folder):
    """The small tables, those of texts as folders of three files."""
    for name in BASE:
        source = f"{SMALL}/{name}.parquet"
        if name in ("documents", "conversations"):
            spark.read.parquet(source).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        else:
            os.symlink(source, f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_micro_batch", "stream_daily", "stream_unique", "stream_backfill", "stream_backlog"])
def test_streams_of_folders(spark, parts, name):
    rows, faults = compare(QUERIES[name], QUERIES[name].run(Tables(spark, parts)), connect(SMALL))
    assert rows > 0 and not faults, faults


def test_a_table_takes_no_other_table(spark, folder):
    """Names that begin alike, and files beside the tables."""
    for name, n in (("documents", 3), ("documents_old", 5), ("labels", 7)):
        spark.range(n).write.parquet(f"{folder}/{name}.parquet")
    seen = []
    StreamTables(spark, folder)("documents").writeStream.foreachBatch(lambda df, _: seen.append(df.count())).option(
        "checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    assert seen == [3]
