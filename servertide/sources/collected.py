"""Reading and writing collected telemetry tables as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from servertide.functions.text import KEY_SUFFIX, name_key
from servertide.sources.schemas import schema

#: Partition column of batches; reports do not see it.
BATCH = "batch_id"


def append_batch(df: DataFrame, path: str, batch_id: str, *partitions: str) -> None:
    """Append rows under a batch id. Appending the batch again, also after a job that failed or was
    cut off, leaves one copy: the partitions of the batch are overwritten when the job commits, others stay."""
    (
        df.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, BATCH).parquet(path)
    )


def read_batches(spark: SparkSession, path: str, fields: StructType) -> DataFrame:
    """Rows of all batches, by a fixed schema."""
    return spark.read.schema(StructType([*fields, StructField(BATCH, StringType())])).parquet(path).drop(BATCH)


def replace_batches(df: DataFrame, path: str, batch_id: str) -> None:
    """The table's rows become those of ``df``: the batch is added, then all others go.

    The old rows are there until the new ones are; a call that was cut off is finished by repeating it.
    """
    append_batch(df, path, batch_id)
    drop_batches(df.sparkSession, path, keep=batch_id)


def drop_batches(spark: SparkSession, path: str, keep: str | None = None) -> None:
    """Drop a table, or its batches but one; what is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if keep is None:
        files.delete(folder, True)
    elif files.exists(folder):
        names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        kept = f"{BATCH}={names.escapePathName(keep)}"
        for entry in files.listStatus(folder):
            if entry.isDirectory() and entry.getPath().getName().startswith(f"{BATCH}=") and entry.getPath().getName() != kept:
                files.delete(entry.getPath(), True)


def read_collected(spark: SparkSession, root: str, table: str, *scope: str, name_keys: Sequence[str] = ()) -> DataFrame:
    """One telemetry table below ``root``, by its fixed schema, and the keys of the name columns that were collected.

    Columns that a collection lacked are NULL in its rows, columns that the schema does not have are not read.
    """
    fields = schema(table, *scope)
    for name in name_keys:
        fields = fields.add(f"{name}{KEY_SUFFIX}", "string")
    return read_batches(spark, f"{root}/{table}", fields)


def with_name_keys(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with the keys of name columns under the server's collation, by which reports then compare them."""
    return df.withColumns({f"{name}{KEY_SUFFIX}": name_key(F.col(name)) for name in names})


def append_collected(
    df: DataFrame, root: str, table: str, name_keys: Sequence[str] = (), batch_id: str | None = None, partitions: Sequence[str] = ()
) -> None:
    """Append newly collected rows, with the keys of the given name columns.

    A collection that may be repeated names its batch (such as server and time); without one each call adds its rows.
    ``partitions`` (such as the server), the same in all calls for a table, become folders, so that reports on some
    of them read no others. Columns may be missing, as servers of different versions collect different ones.
    """
    append_batch(with_name_keys(df, name_keys), f"{root}/{table}", batch_id or uuid.uuid4().hex, *partitions)


def append_snapshot(snapshot: DataFrame, root: str, batch_id: str | None = None) -> None:
    """Append to the snapshot table, which is partitioned by day of collection; see ``append_collected`` for the batch.

    Rows of a day are first brought together, so that each day gets a few files and not
    one from every task.
    """
    dated = snapshot.withColumn("collect_day", F.to_date("collect_date"))
    dealt = dated.repartition("collect_day", F.pmod(F.xxhash64("query_text"), F.lit(16)))
    append_batch(dealt, f"{root}/tempdb_snapshots", batch_id or uuid.uuid4().hex, "collect_day")


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot table; ``collect_day`` prunes partitions."""
    fields = schema("tempdb_snapshots").add("collect_day", "date")
    return read_batches(spark, f"{root}/tempdb_snapshots", fields)
