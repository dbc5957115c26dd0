"""Incremental intake, fact load, topic windows and metric anomalies as streams.

Each job reuses the batch operators; its result on the same rows is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from signalbook.operators.series import merge_moments, moments, stats_of, zscore_anomalies
from signalbook.session import cut_lineage


def read_new_files(
    spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def read_new_table(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """The files of one table as they arrive: ``folder``/``table``.parquet is one file, or a folder of files."""
    name = f"{table}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return read_new_files(spark, f"{folder}/{name}", schema, "*")
    return read_new_files(spark, folder, schema, name)


def hashed(documents: DataFrame, content: str) -> DataFrame:
    """``documents`` with the SHA-256 of their content."""
    return documents.withColumn("content_hash", F.sha2(F.col(content), 256))


def distinct_content(documents: DataFrame, content: str, arrival: str, delay: str) -> DataFrame:
    """Thins out copies before they reach a target, for documents that come in order of arrival.

    State is dropped behind the watermark, and with it Spark drops every row that comes later than
    ``delay``, first copies too.  Where documents come out of order use :func:`intake`, or
    :func:`load_new` on :func:`hashed` documents: these lose none.
    """
    return (
        hashed(documents, content)
        .withColumn("_event_time", F.col(arrival).cast("timestamp"))
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark(["content_hash"])
        .drop("_event_time")
    )


# --- targets in buckets by key --------------------------------------------------------------
#
# bucket=K/batch_id=N holds what batch N added to bucket K.  A batch compares itself with earlier
# batches of the buckets its own keys fall into and reads nothing else.  Run again, it replaces its
# own folders.

BUCKETS = 256


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, target: str) -> list[str]:
    """Names of the folders in ``target``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(where) if s.isDirectory()] if store.exists(where) else []


def earlier(spark: SparkSession, target: str, schema: StructType, touched: Sequence[int], batch_id: int) -> DataFrame:
    """Rows that earlier batches have stored in the touched buckets; no other bucket is listed or read."""
    names = {f"bucket={bucket}" for bucket in touched} & set(_folders(spark, target))
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    if not names:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).option("basePath", target).parquet(*[f"{target}/{name}" for name in sorted(names)])
    return rows.where(F.col("batch_id") < batch_id).select(*full.fieldNames())


def add_batch(rows: DataFrame, target: str, key: Sequence[str], batch_id: int, buckets: int, new_only: bool) -> None:
    """Store the rows of a batch by bucket; with ``new_only`` those whose key no earlier batch has."""
    spark = rows.sparkSession
    rows = cut_lineage(rows.withColumn("bucket", _bucket(key, buckets)))
    if new_only:
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        schema = StructType([f for f in rows.schema.fields if f.name in key])
        rows = rows.join(earlier(spark, target, schema, touched, batch_id).select(*key), list(key), "left_anti")
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .repartition("bucket")
        .write.partitionBy("bucket", "batch_id")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(target)
    )


def _run_batches(stream: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_new(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    key: str,
    build: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Build facts from each micro-batch and store those whose key is not stored yet.

    ``build`` gives one row per key.  Only the key column of the buckets that the batch touches is
    read.  A batch writes its own folders and compares itself only with earlier batches, so running
    it again after a failure gives the same files.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        add_batch(build(batch), target, [key], batch_id, buckets, new_only=True)

    return _run_batches(stream, checkpoint, store)


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """What :func:`load_new` has stored."""
    return spark.read.option("basePath", target).parquet(target).drop("bucket", "batch_id")


def intake(
    documents: DataFrame, target: str, checkpoint: str, doc_id: str, arrival: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep, for every content hash, its first document and how many copies there are.

    Each micro-batch stores one row per hash it holds: the earliest document in it and their number.
    Such rows merge (smallest, sum), so nothing stored is read, and a document that arrives after its
    later copies, however late, becomes the first.  No watermark drops it and no state is held.
    ``documents`` has content_hash (null hashes are one content).
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        first = F.min(F.struct(F.col(arrival).alias("arrived_at"), F.col(doc_id).alias("document_id")))
        seen = batch.groupBy("content_hash").agg(first.alias("first"), F.count(F.lit(1)).alias("documents"))
        add_batch(seen, target, ["content_hash"], batch_id, buckets, new_only=False)

    return _run_batches(documents, checkpoint, store)


def intake_state(spark: SparkSession, target: str) -> DataFrame:
    """content_hash, document_id and arrived_at of its first document, and its number of copies."""
    stored = spark.read.option("basePath", target).parquet(target)
    return (
        stored.groupBy("bucket", "content_hash")
        .agg(F.min("first").alias("first"), F.sum("documents").alias("n"))
        .select("content_hash", "first.document_id", "first.arrived_at", (F.col("n") - 1).alias("copies"))
    )


def batch_intake(documents: DataFrame, doc_id: str, arrival: str) -> DataFrame:
    """The same as one batch job."""
    first = F.min(F.struct(F.col(arrival).alias("arrived_at"), F.col(doc_id).alias("document_id")))
    return (
        documents.groupBy("content_hash")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .select("content_hash", "first.document_id", "first.arrived_at", (F.col("n") - 1).alias("copies"))
    )


# --- windows and metrics ------------------------------------------------------------------------


def topic_windows(mentions: DataFrame, length: str = "30 days", step: str = "1 day") -> DataFrame:
    """Mentions of each topic in sliding windows; works on batch and stream alike.

    Mentions are counted per step first and the counts are put into the windows, so a mention is not
    copied once per window.  The length is a multiple of the step.
    """
    steps = mentions.groupBy(F.window("created_at", step).alias("s"), "topic").agg(F.count("*").alias("n"))
    return (
        steps.groupBy(F.window(F.window_time("s"), length, step).alias("w"), "topic")
        .agg(F.sum("n").alias("mentions"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "topic",
            "mentions",
        )
    )


def topic_window_stream(
    mentions: DataFrame, delay: str, length: str = "30 days", step: str = "1 day"
) -> DataFrame:
    """Closed windows only: a window is given out once the watermark has passed its end."""
    timed = mentions.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return topic_windows(timed.withWatermark("created_at", delay), length, step)


def hourly_metrics(events: DataFrame, delay: str) -> DataFrame:
    """Sum of values per event type and hour, given out when the hour is closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(
            F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"),
            F.count("*").alias("n_events"),
        )
        .select("event_type", F.col("w.start").cast("timestamp_ntz").alias("t"), "value", "n_events")
    )


def _batch_folder(target: str, batch_id: int) -> str:
    return f"{target}/batch_id={batch_id}"


def _state(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Moments that the latest batch before the given one has left."""
    done = [int(name.removeprefix("batch_id=")) for name in _folders(spark, path) if name.startswith("batch_id=")]
    last = max((n for n in done if n < before), default=None)
    return None if last is None else spark.read.parquet(_batch_folder(path, last))


def metric_anomalies(
    hours: DataFrame, history: DataFrame | None, target: str, checkpoint: str, keys: list[str], learn: bool = False
) -> StreamingQuery:
    """Compare each closed hour with the moments (count, mean, squares) of its series.

    The history is scanned once, when the job is first started: its moments are stored beside the
    target.  With ``learn`` every micro-batch merges its own moments into the stored ones first, so a
    series is judged by all hours closed so far; each batch starts from the moments that the batch
    before it left, so one that runs again gives the same.
    """
    state = f"{target}-moments"
    spark = hours.sparkSession
    if not _folders(spark, state) and history is not None:
        moments(history, keys).write.mode("overwrite").parquet(_batch_folder(state, -1))

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _state(spark, state, batch_id if learn else 0)
        if learn:
            batch = cut_lineage(batch)
            own = moments(batch, keys)
            (own if known is None else merge_moments(known, own, keys)).write.mode("overwrite").parquet(_batch_folder(state, batch_id))
            known = spark.read.parquet(_batch_folder(state, batch_id))
        found = zscore_anomalies(batch, keys, stats=stats_of(known))
        found.write.mode("overwrite").parquet(_batch_folder(target, batch_id))

    return _run_batches(hours, checkpoint, store)


def learnt_moments(spark: SparkSession, target: str) -> DataFrame:
    """The moments of every series after the last micro-batch."""
    return _state(spark, f"{target}-moments", 2**62)


def to_files(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files until all input there is has been read."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
