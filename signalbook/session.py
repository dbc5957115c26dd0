"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks join strategies from measured sizes, splits skewed
# join partitions and merges small shuffle partitions.  Nothing in the library
# forces a broadcast: a side is broadcast only below the size threshold.
DEFAULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Long texts: a batch is also limited by its bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def build_session(app: str = "signalbook", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings above; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine is set if the whole session runs in this process, as
    in tests.  On a cluster there is no such folder to choose, so the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} reach")
        named = tempfile.mkdtemp(prefix="signalbook-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths given out by :func:`scratch_path` and not yet released.
_given_out: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _given_out.append(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Remove everything this process wrote below the shared folder; results not yet read go with it."""
    while _given_out:
        where = spark._jvm.org.apache.hadoop.fs.Path(_given_out.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is exchanged by key, never broadcast, for sides that grow with the input.

    A broadcast is chosen by the size of a stored side's file.  Files are compressed and names made on
    the way are not in them, so a few MB of file can be hundreds of MB in the driver's memory.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder, so that later steps never recompute
    them, read only the columns they need and survive the loss of an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
