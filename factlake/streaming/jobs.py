"""Recurring jobs as streams.

Each job reads a stream of new rows and writes every micro-batch to folders
``<out>/<table>/batch_id=N``. A batch that is repeated after a failure replaces
its own folders, so each row is stored once. Without ``every`` a job takes what
is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, live, messages, metering, replies, requests, routing
from ..sources import chat
from . import backlog

MICRO_BATCH = "30 minutes"
BACKFILL = "2 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(
    rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
    every: str | None = None, mode: str = "append",
) -> StreamingQuery:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def write_batch(rows: DataFrame, out: str, table: str, batch_id: int) -> DataFrame:
    """Stores one batch of a table and returns it as stored, so later steps do not compute it again."""
    path = f"{out}/{table}/batch_id={batch_id}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_table(spark: SparkSession, out: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """All batches of a table with their ``batch_id``; empty before the first one, if a schema is given.

    Only a missing table is empty: any other fault of the store is raised.
    """
    try:
        reader = spark.read
        if schema is not None:
            reader = reader.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
        return reader.parquet(f"{out}/{table}")
    except AnalysisException as fault:
        if schema is None or fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("bigint"))


MESSAGE_KEYS = ["org_id", "channel_id", "ts"]
KEY_ROWS = T.StructType([*[T.StructField(c, T.StringType()) for c in MESSAGE_KEYS], T.StructField("batch_id", T.LongType()), T.StructField("day", T.DateType())])


def stored_keys(spark: SparkSession, out: str) -> DataFrame:
    """Keys of the stored messages, in folders by batch and day of the message; empty before the first batch."""
    try:
        return spark.read.schema(KEY_ROWS).parquet(f"{out}/keys")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEY_ROWS)


def new_messages(found: DataFrame, out: str, batch_id: int) -> DataFrame:
    """One copy of each message that no other batch has stored, however late it comes.

    A message can only have been stored under its own day, so only the days
    that the batch has are read: they are a dimension of the scan, with as many rows
    as there are days. The keys are stored by day at once, for later batches.
    """
    spark, day = found.sparkSession, F.to_date("timestamp").alias("day")
    once = found.dropDuplicates(MESSAGE_KEYS)
    # Spark prunes folders by a dimension only if that has a filter of its own.
    days = found.select(day).distinct().filter(F.col("day") > F.lit("0001-01-01").cast("date"))
    stored = stored_keys(spark, out).filter(F.col("batch_id") != batch_id).join(F.broadcast(days), "day", "left_semi")
    fresh = write_batch(once.join(stored.select(*MESSAGE_KEYS), MESSAGE_KEYS, "left_anti").select(*found.columns), out, "messages", batch_id)
    keys = fresh.select(*MESSAGE_KEYS, day).hint("rebalance", "day")
    keys.write.mode("overwrite").partitionBy("day").parquet(f"{out}/keys/batch_id={batch_id}")
    return fresh


def ingest_messages(
    raw: DataFrame, channels: DataFrame, profiles: DataFrame, out: str, checkpoint: str, *,
    hours_back: float | None = None, now: Callable[[], Column] = F.current_timestamp, every: str | None = None,
    source_type: str = "slack_daily", unique: bool = False, budgets: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """New chat messages of all organisations to ``sources`` and extraction ``requests``.

    The checkpoint knows what is new, so by default no message is too old;
    ``hours_back`` adds the look-back of a batch import. ``unique`` stores a
    message once that several batches deliver. ``budgets`` gives the current
    ``org_id, over_budget``; requests of organisations over theirs go to
    ``deferred``, where the next batch finds them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Stored first: cleaning reads it more than once, the stream and its state are read once.
        found = chat.import_messages(batch, channels, profiles, now(), hours_back)
        found = new_messages(found, out, batch_id) if unique else write_batch(found, out, "messages", batch_id)
        clean = messages.clean_messages(found, slice_width=3_600_000_000)
        stored = write_batch(chat.index_messages(clean, source_type, now()), out, "sources", batch_id)
        asked = requests.extraction_requests(stored)
        if budgets is None:
            write_batch(asked, out, "requests", batch_id)
            return
        # Each batch writes all that waits, so the batch before has everything that was put off.
        waiting = read_table(asked.sparkSession, out, "deferred", asked.schema).filter(F.col("batch_id") == batch_id - 1)
        asked = asked.unionByName(waiting.drop("batch_id"))
        write_batch(requests.within_budget(asked, budgets()), out, "requests", batch_id)
        write_batch(requests.over_budget(asked, budgets()), out, "deferred", batch_id)

    return start(raw, handle, checkpoint, every)


ENTITY_ROWS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("org_id", T.StringType()),
    T.StructField("entity_type", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("source_id", T.LongType()),
    T.StructField("approved_by", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("seq", T.LongType()),
])
BACKLOG_ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("org_id", T.StringType()), T.StructField("raw_content", T.StringType())])
DONE_ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("org_id", T.StringType())])
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain_backfill(
    sources: DataFrame, entities: DataFrame, out: str, checkpoint: str, *,
    extract: Callable[[DataFrame], DataFrame], criticise: Callable[[DataFrame], DataFrame], every: str | None = None,
    budgets: Callable[[], DataFrame] | None = None, tries: int = backlog.TRIES, backoff: float = backlog.BACKOFF_SECONDS,
) -> StreamingQuery:
    """Unprocessed history in batches through extraction, review and storing.

    ``extract`` turns batch requests into ``request_id, reply`` and ``criticise``
    turns candidates into the same with ``seq, reply`` (and ``org_id`` where organisations
    may share source ids); both stand for the model.
    Sources that got a reply are listed in ``processed`` and told to the state, see ``backlog``;
    the others are asked again after ``backoff`` seconds, doubled each time, and after
    ``tries`` are in ``dead_letters``. Sources of organisations over their
    budget wait without using up a try.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, other = batch.sparkSession, F.col("batch_id") != batch_id
        turn = write_batch(batch, out, "turns", batch_id)
        write_batch(turn.filter(F.col("what") == backlog.DEAD).drop("what"), out, "dead_letters", batch_id)
        rows = turn.filter(F.col("what") == backlog.ASK).select(*BACKLOG_ROWS.names)
        put_off = rows.limit(0)
        if budgets is not None:
            now = budgets()
            put_off, rows = requests.over_budget(rows, now), requests.within_budget(rows, now)
        packed = write_batch(requests.pack_batches(rows), out, "packed", batch_id)
        asked = write_batch(requests.batch_requests(packed), out, "requests", batch_id)
        answered = asked.select("request_id", "org_id", "batch_no", "n").join(extract(asked), "request_id")
        unpacked = replies.unpack_batches(answered.withColumn("batch_id", F.struct("org_id", "batch_no")))
        places = unpacked.select("batch_id.org_id", "batch_id.batch_no", "idx", "entities")
        found = replies.attach_sources(places, packed)
        proposed = replies.explode_entities(found.withColumnRenamed("id", "source_id"), "org_id", "source_id").select(
            "org_id", "source_id", live.item_number().alias("seq"), "pos", "entity_type", "name", "content",
        )
        stored = write_batch(proposed, out, "proposed", batch_id)
        scored = live.scored(stored, criticise(stored))
        # Own rows of an earlier attempt at this batch do not count as stored.
        earlier = read_table(spark, out, "entities", ENTITY_ROWS).filter(other)
        # Only names of this batch matter.
        names = stored.select(*routing.IDENTITY).distinct()
        known = entities.select("id", "org_id", "entity_type", "name", "status").unionByName(
            earlier.select("id", "org_id", "entity_type", "name", "status")).join(names, routing.IDENTITY, "left_semi")
        ingest.write(ingest.store_backfill(scored, known, id_base=0), out, batch_id)
        through = write_batch(found.select(*DONE_ROWS.names).distinct(), out, "processed", batch_id)
        write_batch(_outcomes(through, backlog.ANSWERED).unionByName(_outcomes(put_off, backlog.DEFERRED)), out, "outcomes", batch_id)

    spark = sources.sparkSession
    # A row for nobody: the run has a batch, in which timers that ran out are heard, also without new sources.
    spark.createDataFrame([(None, None, backlog.TICK)], backlog.OUTCOMES).write.mode("append").parquet(f"{out}/outcomes/batch_id=-1")
    outcomes = spark.readStream.schema(backlog.OUTCOMES).parquet(f"{out}/outcomes/batch_id=*")
    turns = backlog.waiting(requests.backlog(sources), outcomes, tries, backoff)
    # Timers keep asking for another batch; a run that is to end takes only batches with data.
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, before if every else "false")
    try:
        return start(turns, handle, checkpoint, every, mode="update")
    finally:
        spark.conf.set(EMPTY_BATCHES, before)


def _outcomes(rows: DataFrame, outcome: str) -> DataFrame:
    return rows.select("org_id", "id", F.lit(outcome).alias("outcome"))


def meter_tokens(
    events: DataFrame, out: str, checkpoint: str, every: str | None = None, limits: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Running totals per organisation and month; each batch writes the totals it changed.

    ``limits`` gives the stored ``org_id, month, budget_limit``; others have the default.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        over = F.col("tokens_used") >= F.col("budget_limit")
        write_batch(metering.with_budget(batch, limits and limits()).withColumn("over_budget", over), out, "usage", batch_id)

    return start(metering.usage(events), handle, checkpoint, every, mode="update")


def current_usage(spark: SparkSession, out: str) -> DataFrame:
    """Newest total of each organisation and month."""
    last = F.max_by(F.struct("tokens_used", "budget_limit", "over_budget"), "batch_id")
    return read_table(spark, out, "usage").groupBy("org_id", "month").agg(last.alias("u")).select("org_id", "month", "u.*")
