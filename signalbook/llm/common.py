"""Column functions and distribution helpers shared by the corpus operators."""

from __future__ import annotations

import string
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalbook.session import scratch_path

#: White space that separates words: blank and the five ASCII control spaces.
WORD_GAP = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Send the functions of ``module`` to the workers whole, so that no worker has to import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(column: str | Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that is not null, in order, repeats kept."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else.  Pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_once(docs: DataFrame, kept: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of ``docs`` whose (id, key) is in ``kept`` (doc_id, key), one row for each of these.

    Ids may be null.  Join and row number share one partitioning, so a text moves once.
    """
    names = [free_name(docs, name) for name in ("_id", "_no_id", "_key", "_place")]
    parts = lambda id_, key_: (F.coalesce(id_.cast("string"), F.lit("")), id_.isNull(), key_)
    named = lambda id_, key_: [c.alias(n) for c, n in zip(parts(id_, key_), names)]
    marked = docs.select("*", *named(F.col(f"`{id_col}`"), key))
    wanted = kept.select(*named(F.col("doc_id"), F.col("key")))
    same = Window.partitionBy(*names[:3]).orderBy(F.lit(0))
    return (
        marked.join(wanted, names[:3], "left_semi")
        .withColumn(names[3], F.row_number().over(same))
        .where(F.col(names[3]) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    Cuts the lineage: what was computed once is neither computed again nor lost with an executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def running_total(
    df: DataFrame, group: Sequence[str], chunk: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come before this row.

    ``chunk`` columns cut each group into consecutive pieces of bounded size (a later piece has a
    greater chunk).  Pieces are summed first, so a task only ever orders one piece or the list of
    pieces.  Group and chunk columns hold no nulls.
    """
    keys = [*group, *chunk]
    back = (Window.unboundedPreceding, -1)
    pieces = Window.partitionBy(*group).orderBy(*chunk).rowsBetween(*back)
    starts = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_piece"))
        .select(*keys, F.coalesce(F.sum("_piece").over(pieces), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*back)
    return (
        df.join(starts, keys)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_start")
    )


by_value(__name__)
