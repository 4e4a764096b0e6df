"""Space of databases, files, volumes, drives and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.functions.numbers import div, pages_to_mb, rounded_ratio, truncated_ratio
from servertide.functions.text import fold, name_key
from servertide.operators.ranking import top_k
from servertide.plans.sessions import database_names
from servertide.sources.collected import append_batch, read_batches
from servertide.sources.schemas import schema

# Databases of the server itself.
SYSTEM_DATABASES = ("master", "model", "msdb", "tempdb")
# Fixed value: name of the instance that has none of its own.
DEFAULT_INSTANCE = "MSSQLSERVER"
# Their ids are the first.
LAST_SYSTEM_DATABASE = 4

PAGES_PER_GB = 131_072


def without_databases(rows: DataFrame, excluded: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """``rows`` but for those of the excluded databases, by the name in the scope; the server's own ones also by their id."""
    if not excluded:
        return rows
    if "database_name" in scope:
        return rows.where(~name_key(F.col("database_name")).isin(*map(name_key, excluded)))
    if "database_id" in scope and set(excluded) == set(SYSTEM_DATABASES):
        return rows.where(F.col("database_id") > LAST_SYSTEM_DATABASE)
    raise ValueError("excluded databases need database_name in the scope (or database_id, for the server's own); else pass none")


def _index_sizes(
    indexes: DataFrame, objects: DataFrame, schemas: DataFrame, partitions: DataFrame, allocation_units: DataFrame,
    excluded_databases: Sequence[str], scope: Sequence[str],
) -> DataFrame:
    """One row per index of the given objects: rows and size, both summed before any join."""
    scope = list(scope)
    index = [*scope, "object_id", "index_id"]
    pages = allocation_units.groupBy(*scope, F.col("container_id").alias("partition_id")).agg(F.sum("total_pages").alias("pages"))
    sizes = (
        partitions.select(*index, "partition_id", "rows").join(pages, [*scope, "partition_id"], "left")
        .groupBy(*index).agg(F.sum("rows").alias("number_of_rows"), F.sum("pages").alias("pages"))
    )
    named = objects.join(
        schemas.where(fold(F.col("name")) != "sys").select(*scope, "schema_id", F.col("name").alias("schema_name")),
        [*scope, "schema_id"],
    ).select(*scope, "object_id", "schema_name", F.col("name").alias("table_name"))
    rows = indexes.select(*index).join(named, [*scope, "object_id"]).join(sizes, index, "left")
    rows = without_databases(rows, excluded_databases, scope)
    return rows.select(*scope, "schema_name", "table_name", "number_of_rows", pages_to_mb(F.col("pages")).alias("total_space_mb"))


def _table_sizes(sizes: DataFrame, distinct_first: bool, scope: Sequence[str]) -> DataFrame:
    table = [*scope, "schema_name", "table_name"]
    if distinct_first:
        sizes = sizes.distinct()
    name = F.concat(F.lit("["), F.col("schema_name"), F.lit("].["), F.col("table_name"), F.lit("]"))
    return (
        sizes.groupBy(*table)
        .agg(
            F.max("number_of_rows").alias("number_of_rows"),
            F.sum("total_space_mb").cast("decimal(38,2)").alias("total_space_mb"),
        )
        .withColumn("schema_and_table", name)
    )


def _by_rows():
    return [F.col("number_of_rows").desc(), F.col("schema_name"), F.col("table_name")]


def heap_tables(
    indexes: DataFrame, objects: DataFrame, schemas: DataFrame, partitions: DataFrame, allocation_units: DataFrame,
    min_rows: int = 10, k: int = 200, excluded_databases: Sequence[str] = SYSTEM_DATABASES, distinct_first: bool = True,
    scope: Sequence[str] = ("database_name",),
) -> DataFrame:
    """Largest user tables without a clustered index, per database.

    With ``distinct_first`` two indexes of a table with equal rows and size count once.
    """
    heaps = objects.where(F.col("is_user_table") & ~F.col("has_clustered_index"))
    sizes = _index_sizes(indexes, heaps, schemas, partitions, allocation_units, excluded_databases, scope)
    tables = _table_sizes(sizes.where(F.col("number_of_rows") > min_rows), distinct_first, scope)
    order = _by_rows()
    return top_k(tables, k, order, scope).orderBy(*scope, *order)


def table_sizes(
    indexes: DataFrame, objects: DataFrame, schemas: DataFrame, partitions: DataFrame, allocation_units: DataFrame,
    excluded_databases: Sequence[str] = SYSTEM_DATABASES, distinct_first: bool = True,
    scope: Sequence[str] = ("database_name",),
) -> DataFrame:
    """Rows and size of all user tables."""
    users = objects.where(F.col("is_user_table"))
    sizes = _index_sizes(indexes, users, schemas, partitions, allocation_units, excluded_databases, scope)
    return _table_sizes(sizes, distinct_first, scope).orderBy(*scope, *_by_rows())


def database_sizes(databases: DataFrame, master_files: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Data and log size of each database in GB."""
    pages = F.col("size").cast("long")
    files = master_files.groupBy(*scope, "database_id").agg(
        F.sum(F.when(F.col("type") == 0, pages)).alias("data_pages"),
        F.sum(F.when(F.col("type") == 1, pages)).alias("log_pages"),
    )
    return databases.select(*scope, "database_id", "name").join(files, [*scope, "database_id"], "left").select(
        *scope, "name",
        rounded_ratio(F.col("data_pages"), PAGES_PER_GB, 20, 6).alias("data_file_size_gb"),
        rounded_ratio(F.col("log_pages"), PAGES_PER_GB, 20, 6).alias("log_file_size_gb"),
    )


def volume_free_space(master_files: DataFrame, volumes: DataFrame, default_instance: str = DEFAULT_INSTANCE, scope: Sequence[str] = ()) -> DataFrame:
    """Capacity and free space of the volumes that hold database files, by machine and instance."""
    file = [*scope, "database_id", "file_id"]
    gb = 1024**3
    return volumes.join(master_files.select(*file), file, "left_semi").select(
        *scope, "machine_name", F.coalesce("instance_name", F.lit(default_instance)).alias("instance_name"),
        F.col("volume_mount_point").alias("volume_letter"), F.col("logical_volume_name").alias("volume_label"),
        div(F.col("total_bytes"), gb).alias("volume_capacity_gb"),
        div(F.col("available_bytes"), gb).alias("volume_free_space_gb"),
        rounded_ratio(F.col("available_bytes") * 100, F.col("total_bytes"), 5, 2).alias("percentage_free_space"),
    ).distinct()


def bytes_to_mb(drives: DataFrame, *columns: str) -> DataFrame:
    """Drive sizes as collected (bytes, text or number) in whole MB."""
    return drives.withColumns({c: div(F.col(c).cast("long"), 1024**2) for c in columns})


def drive_space(drives: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Used and free space per drive letter, sizes in MB."""
    free, total = F.col("free_space"), F.col("total_space")
    return drives.orderBy(*scope, "drive_letter", "label").select(
        *scope, "drive_letter", "label", free.alias("free_space_mb"), (total - free).alias("used_space_mb"),
        total.alias("total_space_mb"),
        (truncated_ratio(free, total, 19, 10) * 100).cast("decimal(22,10)").alias("percentage_free"),
    )


def file_space(
    master_files: DataFrame, file_io_stats: DataFrame, file_space_used: DataFrame, databases: DataFrame,
    path_like: str | None = None, largest_first: bool = False, scope: Sequence[str] = (),
) -> DataFrame:
    """Every file with its drive, size, free share, growth and I/O counters; those of a path, or the largest first."""
    file = [*scope, "database_id", "file_id"]
    if path_like is not None:
        # A backslash in a path is a letter, not the escape of a pattern.
        master_files = master_files.where(F.col("physical_name").ilike(path_like.replace("\\", "\\\\")))
    counters = [
        "num_of_reads", "num_of_bytes_read", "io_stall_read_ms", "num_of_writes", "num_of_bytes_written", "io_stall_write_ms",
    ]
    rows = (
        master_files.join(file_io_stats.select(*file, "size_on_disk_bytes", *counters), file, "left")
        .join(file_space_used.select(*file, "space_used_mb", "free_space_perc"), file, "left")
        .join(database_names(databases, scope), [*scope, "database_id"], "left")
    )
    growth = F.col("growth").cast("long")
    percent = F.col("is_percent_growth")
    growth_mb = div(growth * 8, 1024)
    if largest_first:
        rows = rows.orderBy(*scope, F.col("size_on_disk_bytes").desc_nulls_last(), "database_id", "file_id")
    return rows.select(
        *scope, "database_name", "database_id", "file_id", "type_desc",
        F.upper(F.left(F.col("physical_name"), F.lit(1))).alias("disk_drive"), "physical_name",
        rounded_ratio(F.col("size_on_disk_bytes"), 1024**2, 18, 2).alias("size_on_disk_mb"),
        "space_used_mb", "free_space_perc",
        F.when(~percent, F.concat(growth_mb.cast("string"), F.lit(" MB")))
        .when(percent, F.concat(growth.cast("string"), F.lit("%"))).alias("growth"),
        F.when(~percent, rounded_ratio(growth, 128, 18, 2))
        .when(percent, rounded_ratio(F.col("size").cast("long") * growth, 12_800, 18, 2)).alias("next_growth_mb"),
        *counters,
    )


def file_space_usage(files: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Used MB and free percent of each file from its pages and the pages in use."""
    size, used = F.col("size").cast("long"), F.col("space_used_pages").cast("long")
    used_mb = rounded_ratio(used, 128, 18, 2)
    # (size - used) * 100 / size with the used MB already rounded, in hundredths of a page.
    left = size * 100 - (used_mb * 100).cast("long") * 128
    free = rounded_ratio(left * 100, size * 100, 18, 2)
    return files.select(*scope, "database_id", "file_id", used_mb.alias("space_used_mb"), free.alias("free_space_perc"))


def read_table(spark, path: str) -> DataFrame:
    """A collected table read whole."""
    return spark.read.parquet(path)


def newest_rows(table: DataFrame, date: str, key: Sequence[str], k: int = 1000) -> DataFrame:
    """The k latest rows of a user table; ``key`` decides between equal dates."""
    return top_k(table, k, [F.col(date).desc(), *[F.col(c) for c in key]])


def job_names(jobs: DataFrame, job_id=None) -> DataFrame:
    """Names of scheduled jobs, or of one."""
    return (jobs if job_id is None else jobs.where(F.col("job_id") == job_id)).select("job_id", "name")


def append_permission(permissions: DataFrame, path: str, batch_id: str) -> None:
    """Append (table name, principal) rows to the permission table; a batch that is appended again is there once."""
    append_batch(permissions.select("table_name", "principal"), path, batch_id)


def permissions(spark, path: str) -> DataFrame:
    """The permission table."""
    return read_batches(spark, path, schema("truncate_permission"))
