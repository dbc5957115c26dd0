"""A registry of entities that is kept from run to run.

The registry is a table in buckets by key hash.  A version is a list that names, for each bucket, the
folder that holds its rows.  A run merges its new entities and aliases by writing only the buckets
they fall into to a new folder; the new list names these and, for all other buckets, the folders of
the version before.  A version counts once its list is complete, so readers see the old version or
the new one, and a run that failed has changed nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.operators import resolve
from signalbook.session import cut_lineage

ROW = "entity_type string, canonical_id string, name string, aliases array<string>"
BUCKETS = 64


class VersionConflict(RuntimeError):
    """Another run has stored a version since this one read the registry."""


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("entity_type", "canonical_id"), F.lit(buckets)).cast("int")


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose list is complete."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    found = [status.getPath() for status in store.listStatus(where)]
    done = lambda folder: store.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))
    return sorted(int(folder.getName()) for folder in found if folder.getName().isdigit() and done(folder))


def current_version(spark: SparkSession, path: str) -> int:
    """The newest complete version, 0 before the first."""
    return max(_complete(spark, path), default=0)


def _list(spark: SparkSession, path: str, version: int) -> dict[int, str | None]:
    """Folder of each bucket: as many rows as the registry was given buckets."""
    return {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{path}/versions/{version}").collect()}


def _rows(spark: SparkSession, path: str, folders: dict[int, str | None]) -> DataFrame:
    places = [f"{path}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items()) if folder]
    return spark.read.schema(ROW).parquet(*places) if places else spark.createDataFrame([], ROW)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The registry (entity_type, canonical_id, name, aliases), as of a version if one is given."""
    version = current_version(spark, path) if version is None else version
    return _rows(spark, path, _list(spark, path, version)) if version else spark.createDataFrame([], ROW)


def _store(rows: DataFrame, path: str, parent: int, folders: dict[int, str | None], touched: list[int]) -> int:
    """Write the touched buckets and then the list of the next version."""
    spark, version = rows.sparkSession, parent + 1
    folder = f"v{version}"
    rows.withColumn("bucket", _bucket(len(folders))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/data/{folder}"
    )
    if current_version(spark, path) != parent:
        raise VersionConflict(f"version {version} of {path} is there already")
    listed = [(bucket, folder if bucket in touched else held) for bucket, held in sorted(folders.items())]
    spark.createDataFrame(listed, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{version}")
    return version


def _touched(rows: DataFrame, buckets: int) -> list[int]:
    return [r[0] for r in rows.select(_bucket(buckets)).distinct().collect()]


def merged(rows: DataFrame) -> DataFrame:
    """One row per entity: the first name it was given (``rank`` 0 before 1), all aliases but the name."""
    one = rows.groupBy("entity_type", "canonical_id").agg(
        F.min_by("name", F.struct("rank", "name")).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases")
    )
    return one.select("entity_type", "canonical_id", "name", F.filter("aliases", lambda a: a != F.col("name")).alias("aliases"))


def create(registry: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Store a registry as the first version; repeated rows are merged."""
    spark = registry.sparkSession
    if current_version(spark, path):
        raise VersionConflict(f"{path} holds a registry")
    aliases = F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")
    rows = cut_lineage(merged(registry.select("entity_type", "canonical_id", "name", aliases, F.lit(0).alias("rank"))))
    return _store(rows, path, 0, dict.fromkeys(range(buckets)), _touched(rows, buckets))


def merge(decisions: DataFrame, path: str) -> int:
    """Add what a run decided: new entities, and every form of a name as an alias.  Returns the version.

    A run without anything new stores no version.  Merging the same decisions again changes nothing.
    """
    spark = decisions.sparkSession
    parent = current_version(spark, path)
    folders = _list(spark, path, parent)
    none = F.array().cast("array<string>")
    news = resolve.new_entities(decisions).select("entity_type", "canonical_id", F.col("canonical_name").alias("name"), none.alias("aliases"))
    forms = decisions.where(F.col("raw_value") != F.col("canonical_name")).select(
        "entity_type", "canonical_id", F.col("canonical_name").alias("name"), F.array("raw_value").alias("aliases")
    )
    changes = cut_lineage(merged(news.unionByName(forms).withColumn("rank", F.lit(1))))
    touched = _touched(changes, len(folders))
    if not touched:
        return parent
    old = _rows(spark, path, {b: folders[b] for b in touched})
    rows = merged(old.withColumn("rank", F.lit(0)).unionByName(changes.withColumn("rank", F.lit(1))))
    return _store(rows, path, parent, folders, touched)
