"""Unused indexes and the text that would create or drop an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.functions.numbers import pages_to_mb
from servertide.functions.text import fold, quotename
from servertide.operators.ranking import top_k
from servertide.plans.storage import SYSTEM_DATABASES, without_databases


UNUSED = [
    "schema_name", "table_name", "index_name", "user_seeks", "user_scans", "user_lookups", "user_updates", "table_rows", "index_size_mb",
    "last_user_scan", "last_user_seek", "last_user_update",
]
SCRIPTS = ["key_columns", "included_columns", "create_statement", "drop_statement"]
_LONGEST_UNUSED = ("last_user_seek", "last_user_scan")


def unused_indexes(
    index_usage: DataFrame, indexes: DataFrame, partition_stats: DataFrame, partitions: DataFrame, objects: DataFrame,
    schemas: DataFrame, k: int = 100, excluded_databases: Sequence[str] = SYSTEM_DATABASES,
    scope: Sequence[str] = ("database_name",),
) -> DataFrame:
    """Plain nonclustered indexes, longest unused first, per database.

    An index with several partitions has a row for the size of each.
    """
    unused = _unused(index_usage, indexes, partition_stats, partitions, objects, schemas, k, excluded_databases, scope)
    return unused.orderBy(*scope, *_unused_order()).select(*scope, *UNUSED)


def _unused_order():
    return [*(F.col(c).asc_nulls_first() for c in _LONGEST_UNUSED), F.col("index_size_mb").desc(), F.col("object_id"), F.col("index_id")]


def _unused(index_usage, indexes, partition_stats, partitions, objects, schemas, k, excluded_databases, scope) -> DataFrame:
    """The columns of the report, and object_id and index_id."""
    scope = list(scope)
    index = [*scope, "object_id", "index_id"]
    plain = indexes.where(
        (fold(F.col("type_desc")) == "nonclustered") & ~F.col("is_primary_key") & ~F.col("is_unique_constraint") & ~F.col("is_unique")
    ).select(*index, F.col("name").alias("index_name"))
    table_rows = partitions.groupBy(*index).agg(F.sum("rows").alias("table_rows"))
    named = objects.where(F.col("is_user_table")).join(
        schemas.select(*scope, "schema_id", F.col("name").alias("schema_name")), [*scope, "schema_id"]
    ).select(*scope, "object_id", "schema_name", F.col("name").alias("table_name"))
    uses = index_usage.select(
        *index, "user_seeks", "user_scans", "user_lookups", "user_updates", "last_user_scan", "last_user_seek", "last_user_update"
    )
    rows = (
        plain.join(table_rows, index)
        .join(uses, index)
        .join(partition_stats.select(*index, "used_page_count"), index)
        .join(named, [*scope, "object_id"])
        .withColumn("index_size_mb", pages_to_mb(F.col("used_page_count"), 36, 3))
    )
    rows = without_databases(rows, excluded_databases, scope)
    return top_k(rows, k, _unused_order(), scope).select(*index, *UNUSED)


def index_scripts(
    indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, tables: DataFrame, schemas: DataFrame,
    scope: Sequence[str] = ("database_name",),
) -> DataFrame:
    """CREATE and DROP text of every index, as columns; nothing is executed.

    An index has a bounded number of columns, so its list fits one row. Included
    columns all have ordinal 0 and follow their column id.
    """
    scripts = _scripts(indexes, index_columns, columns, tables, schemas, scope)
    return scripts.select(*scope, "schema_name", "table_name", "index_name", "index_id", *SCRIPTS)


def _scripts(indexes, index_columns, columns, tables, schemas, scope) -> DataFrame:
    """The columns of the report, and object_id."""
    scope = list(scope)
    index = [*scope, "object_id", "index_id"]
    parts = (
        index_columns.select(*index, "column_id", "key_ordinal", "is_included_column")
        .join(columns.select(*scope, "object_id", "column_id", F.col("name").alias("column_name")), [*scope, "object_id", "column_id"])
    )

    def listed(included: str) -> str:
        return (
            f"listagg(CASE WHEN {included} THEN column_name END, ', ') WITHIN GROUP (ORDER BY key_ordinal, column_id)"
        )

    lists = parts.groupBy(*index).agg(
        F.expr(listed("NOT is_included_column")).alias("key_columns"), F.expr(listed("is_included_column")).alias("included_columns")
    )
    named = tables.select(*scope, "object_id", "schema_id", F.col("name").alias("table_name")).join(
        schemas.select(*scope, "schema_id", F.col("name").alias("schema_name")), [*scope, "schema_id"]
    )
    rows = (
        indexes.select(*index, F.col("name").alias("index_name")).join(named, [*scope, "object_id"]).join(lists, index, "left")
    )
    include = F.when(F.col("included_columns").isNotNull(), F.concat(F.lit(" INCLUDE ( "), F.col("included_columns"), F.lit(" )"))).otherwise("")
    create = F.concat(
        F.lit("CREATE INDEX "), F.col("index_name"), F.lit(" ON ["), F.col("schema_name"), F.lit("].["), F.col("table_name"),
        F.lit("] ( "), F.col("key_columns"), F.lit(" ) "), include,
    )
    drop = F.concat(
        F.lit("DROP INDEX "), quotename(F.col("index_name")), F.lit(" ON "),
        quotename(F.col("schema_name")), F.lit("."), quotename(F.col("table_name")),
    )
    return rows.select(
        *index, "schema_name", "table_name", "index_name", "key_columns", "included_columns",
        create.alias("create_statement"), drop.alias("drop_statement"),
    )


def unused_index_scripts(
    index_usage: DataFrame, indexes: DataFrame, partition_stats: DataFrame, partitions: DataFrame, objects: DataFrame,
    schemas: DataFrame, index_columns: DataFrame, all_columns: DataFrame, tables: DataFrame, k: int = 100,
    excluded_databases: Sequence[str] = SYSTEM_DATABASES, scope: Sequence[str] = ("database_name",),
) -> DataFrame:
    """The unused indexes, each with the texts that would create and drop it; they meet by the ids of object and index."""
    index = [*scope, "object_id", "index_id"]
    unused = _unused(index_usage, indexes, partition_stats, partitions, objects, schemas, k, excluded_databases, scope)
    scripts = _scripts(indexes, index_columns, all_columns, tables, schemas, scope)
    return unused.join(scripts.select(*index, *SCRIPTS), index, "left").select(*scope, *UNUSED, *SCRIPTS)
