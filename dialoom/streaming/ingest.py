"""Incremental ingest of response files, and user generators over request partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dialoom.functions.text import truthy
from dialoom.plans.responses import extract_errors, parse_texts, process
from dialoom.session import small_batches
from dialoom.sources.exchange import parse_lines

PLACE = ("key", "file", "arrived")
NO_TEXT = "no text in the response"


def response_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Every parsed response line of every new file below ``folder``; the checkpoint keeps a file from being read twice.

    No line is dropped here: files may be old, and ids may come again. ``key`` is the record id, or the file and a
    hash of the whole line where there is none.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))
    return parse_lines(lines).withColumn("key", F.coalesce("record_id", F.concat_ws("\x1f", "file", "line_hash")))


def ingest(stream: DataFrame, sink: str, checkpoint: str, plan: DataFrame | None = None, model: str = "model",
           available_now: bool = True) -> StreamingQuery:
    """Appends repaired conversations to ``sink``/conversations and all failures to ``sink``/errors.

    Failures are error lines, broken lines, and good lines whose text holds no conversation. Both tables come from one pass over the
    micro-batch; the batch number names the folder, so a replayed batch overwrites its own output instead of adding to it.
    ``conversations`` and ``errors`` are the views that decide between several lines of one record.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            good = rows.filter(F.col("error").isNull()).drop("error", "raw_line", "line_hash")
            process(good, plan, model, keep=PLACE).write.mode("overwrite").parquet(f"{sink}/conversations/batch={number}")
            unread = extract_errors(good, PLACE).withColumnRenamed("text_preview", "raw_line")
            empty = good.filter(~truthy(F.col("generated_text"))).select(
                "record_id", F.lit(NO_TEXT).alias("error"), F.lit(None).cast("string").alias("raw_line"), *PLACE)
            failed = rows.filter(F.col("error").isNotNull()).select("record_id", "error", "raw_line", *PLACE)
            failed.unionByName(unread).unionByName(empty).write.mode("overwrite").parquet(f"{sink}/errors/batch={number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _newest(rows: DataFrame) -> DataFrame:
    """One row per key: the one that arrived last, by file name and content among equals."""
    order = F.struct("arrived", "file", F.xxhash64(*[c for c in rows.columns if not c.startswith("metadata")]))
    return rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def conversations(spark: SparkSession, sink: str) -> DataFrame:
    """The newest good answer of every record: an error never replaces one, whatever came first."""
    return _newest(spark.read.parquet(f"{sink}/conversations"))


def errors(spark: SparkSession, sink: str) -> DataFrame:
    """The newest failure of every record that has no good answer; every broken line without a record id."""
    answered = spark.read.parquet(f"{sink}/conversations").select("key").distinct()
    return _newest(spark.read.parquet(f"{sink}/errors").join(answered, "key", "left_anti"))


_LINE = ["record_id", "generated_text", "error", "raw_line", *PLACE[1:], "line_hash"]


def follow(stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the standing line of every record of a ``response_stream`` as the state of a keyed aggregation below ``checkpoint``.

    A good answer stands above every failure, the newer one above the older one. The state is a table of its own, kept in RocksDB
    and committed with the stream's offsets, so a restart goes on where it was and a replay changes nothing. Nothing else is written:
    ``standing`` reads the state, one row for each record however many lines came.
    """
    parsed = parse_texts(stream)
    good = F.col("record").isNotNull() & F.col("error").isNull()
    failure = F.coalesce("error", "failure", F.when(~good, F.lit(NO_TEXT)))
    preview = F.coalesce("raw_line", F.when(F.col("error").isNull() & F.col("failure").isNotNull(), F.substring("generated_text", 1, 200)))
    rows = parsed.withColumns({"error": failure, "raw_line": preview})
    line = F.struct(*[F.when(good, F.col(c)).alias(c) if c == "generated_text" else F.col(c) for c in _LINE])
    state = rows.groupBy("key").agg(F.max_by(line, F.struct(good.alias("good"), "arrived", "file", "line_hash")).alias("line"))
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")      # a query keeps the setting it starts with
    try:
        writer = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(name, before)


def standing(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, record_id, generated_text, error, raw_line, file, arrived, line_hash): the standing line of every record; ``error`` is null for a good answer."""
    state = spark.read.format("statestore").load(checkpoint)
    value = F.col("value")[state.schema["value"].dataType.fieldNames()[0]]
    return state.select(F.col("key")["key"].alias("key"), value.alias("line")).select("key", "line.*")


def standing_conversations(spark: SparkSession, checkpoint: str, plan: DataFrame | None = None, model: str = "model") -> DataFrame:
    """The conversations of the good standing lines, as ``ingest`` writes them."""
    return process(standing(spark, checkpoint).filter("error IS NULL"), plan, model, keep=PLACE)


def standing_errors(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(record_id, error, raw_line, key, file, arrived) of the records without a good answer."""
    return standing(spark, checkpoint).filter("error IS NOT NULL").select("record_id", "error", "raw_line", *PLACE)


def generate(requests: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Applies a user generator to the partitions of a request table.

    ``fn`` maps an iterator of pandas batches to an iterator of response batches with ``schema``. No
    network client is part of this package. A batch holds rows of a few megabytes, whatever the length of the prompts.
    """
    small_batches(requests.sparkSession)
    return requests.mapInPandas(fn, schema)
