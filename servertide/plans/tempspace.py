"""Use of temporary space: tables, sessions, files and the collected snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.functions.numbers import pages_to_kb
from servertide.functions.text import truncate, tsql_len, tsql_substring
from servertide.functions.times import instant
from servertide.operators.ranking import top_k

# Text of a query is compared by its first characters.
PREFIX_CHARS = 100


def temp_table_names(temp_tables: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return temp_tables.select(*scope, "name")


def temp_table_prefixes(temp_tables: DataFrame, min_length: int = 9, scope: Sequence[str] = ()) -> DataFrame:
    """Long-named tables by the part of the name before the padding."""
    prefix = tsql_substring(F.col("name"), F.lit(0), F.locate("__", F.col("name")))
    counts = (
        temp_tables.where(tsql_len(F.col("name")) > min_length)
        .groupBy(*scope, prefix.alias("table_name")).agg(F.count("*").alias("tables"))
    )
    return counts.orderBy(F.col("tables").desc(), *scope, "table_name")


def temp_table_count(temp_tables: DataFrame, min_length: int = 9, scope: Sequence[str] = ()) -> DataFrame:
    return temp_tables.where(tsql_len(F.col("name")) > min_length).groupBy(*scope).agg(F.count("*").alias("tables"))


def top_session_space(session_space: DataFrame, k: int = 5, scope: Sequence[str] = ()) -> DataFrame:
    """Sessions that allocated most pages."""
    order = [
        (F.col("user_objects_alloc_page_count") + F.col("internal_objects_alloc_page_count")).desc(), F.col("session_id")
    ]
    return top_k(session_space, k, order, scope).orderBy(*scope, *order)


def space_summary(file_space: DataFrame, database_id: int = 2, scope: Sequence[str] = ()) -> DataFrame:
    """Reserved, version store and free space of one database in KB."""

    def kb(pages: str, name: str):
        return pages_to_kb(F.sum(pages)).alias(name)

    return file_space.where(F.col("database_id") == database_id).groupBy(*scope).agg(
        kb("user_object_reserved_page_count", "user_objects_kb"),
        kb("internal_object_reserved_page_count", "internal_objects_kb"),
        kb("version_store_reserved_page_count", "version_store_kb"),
        kb("unallocated_extent_page_count", "freespace_kb"),
    )


def task_space_sample(task_space: DataFrame, k: int = 100, scope: Sequence[str] = ()) -> DataFrame:
    """Some k rows; ordered, so that they are the same each time."""
    return top_k(task_space, k, [F.col("session_id"), F.col("task_address")], scope)


def _snapshot(snapshots: DataFrame, at) -> DataFrame:
    """Rows of one collection time; of a table partitioned by day, only that day is read."""
    rows = snapshots.where(F.col("collect_date") == instant(at))
    if "collect_day" in snapshots.columns:
        rows = rows.where(F.col("collect_day") == F.to_date(instant(at))).drop("collect_day")
    return rows


def _pages():
    return F.col("internal_pages") + F.col("user_pages")


def _begin(chars: int | None):
    text = F.col("query_text")
    return text if chars is None else truncate(text, chars)


def snapshot_query_counts(snapshots: DataFrame, at, chars: int | None = PREFIX_CHARS, scope: Sequence[str] = ()) -> DataFrame:
    """Rows per query text in one snapshot; texts count as equal if their first ``chars`` are (None: all)."""
    return (
        _snapshot(snapshots, at).groupBy(*scope, _begin(chars).alias("query_text"))
        .agg(F.count("*").alias("row_count"))
    )


def snapshot_query_pages(snapshots: DataFrame, at, scope: Sequence[str] = ()) -> DataFrame:
    """Queries of one snapshot by pages held."""
    rows = _snapshot(snapshots, at).select(*scope, "query_text", _pages().alias("pages"))
    return rows.orderBy(F.col("pages").desc(), *scope, "query_text")


def snapshot_top_offenders(snapshots: DataFrame, at, k: int = 10, chars: int | None = PREFIX_CHARS, scope: Sequence[str] = ()) -> DataFrame:
    """Detail rows of the k queries that hold most pages in one snapshot.

    Every such query has detail rows, except the NULL text, which equals nothing and
    keeps a row of its own. So the k queries are joined to the details without moving
    those, and the NULL text is added.
    """
    scope = list(scope)
    key = [*scope, "query_prefix"]
    rows = _snapshot(snapshots, at).withColumn("query_prefix", _begin(chars))
    sums = rows.groupBy(*key).agg(F.sum(_pages()).alias("page_count"))
    order = [F.col("page_count").desc(), F.col("query_prefix")]
    top = top_k(sums, k, order, scope)
    known = rows.join(top, key)
    unknown = top.where(F.col("query_prefix").isNull())
    for field in rows.schema:
        if field.name not in key:
            unknown = unknown.withColumn(field.name, F.lit(None).cast(field.dataType))
    return known.unionByName(unknown).select(
        *scope, "collect_date", "query_text", "internal_pages", "user_pages", "query_prefix", "page_count"
    )


def snapshot_timeline(snapshots: DataFrame, as_of, hours: int = 24, scope: Sequence[str] = ()) -> DataFrame:
    """Rows per collection time in the last hours."""
    since = instant(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    rows = snapshots.where(F.col("collect_date") > since)
    if "collect_day" in snapshots.columns:
        rows = rows.where(F.col("collect_day") >= F.to_date(since))
    counts = rows.groupBy(*scope, "collect_date").agg(F.count("*").alias("row_count"))
    return counts.orderBy(*scope, "collect_date")
