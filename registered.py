"""The registered queries: every report over the derived telemetry views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servertide.operators.scratch import scratch_path
from servertide.plans import backups, blocking, indexes, queries, sessions, storage, tempspace, waits
from servertide.sources.derived import view, views
from servertide.sources.lookups import KEYS, Lookup
from servertide.sources.textsearch import TextIndex

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-02 00:00:00"
SNAPSHOT = "2024-01-10 00:00:00"
PATTERN = "%The th%"
SINCE = "1996-01-01 00:00:00"
NO_LOAD_WAITS = ("WAIT_3", "WAIT_7", "WAIT_19", "WAIT_28")


class over:
    """A report over the named views."""

    def __init__(self, report: Callable[..., DataFrame], *names: str, **parameters):
        self.report, self.names, self.parameters = report, names, parameters

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.report(*views(spark, sf_dir, self.names), **self.parameters)


class stored(over):
    """The same, with texts and plans added to lookup tables first, in two overlapping parts, and read from there."""

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_path(spark, "lookups")
        tables = dict(zip(self.names, views(spark, sf_dir, self.names)))
        for name in KEYS.keys() & tables.keys():
            rows = tables[name]
            lookup = Lookup(spark, root, name, buckets=32, fields=rows.schema)
            lookup.add(rows.where(F.pmod(lookup.key[0], F.lit(2)) == 0))
            lookup.add(rows)
            tables[name] = lookup.read()
        return self.report(*tables.values(), **self.parameters)


def _table(name: str) -> Query:
    return lambda spark, sf_dir: storage.read_table(spark, f"{sf_dir}/{name}.parquet")


def _newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.newest_rows(_table("orders")(spark, sf_dir), "o_orderdate", ["o_orderkey"])


def _append_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append two parts of the permission rows, each twice, as a retried job would, and read the table back."""
    rows = view(spark, sf_dir, "truncate_permission")
    path = scratch_path(spark, "permission")
    first = F.coalesce(F.col("table_name") < "db.dbo.table_5", F.lit(False))
    for batch_id, part in [("first", first), ("second", ~first)] * 2:
        storage.append_permission(rows.where(part), path, batch_id)
    return storage.permissions(spark, path)


def _statements_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with the texts in an index, to which they are added in two overlapping batches."""
    texts = view(spark, sf_dir, "sql_text")
    index = TextIndex(spark, scratch_path(spark, "search"), ["sql_handle"], texts.schema, parts=8, slots=32)
    index.add(texts.where(F.pmod("sql_handle", F.lit(2)) == 0), "even")
    index.add(texts, "all")
    return queries.statements_matching(view(spark, sf_dir, "query_stats"), index.texts_like(PATTERN), PATTERN)


def _drives_from_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive sizes as collected, text in bytes."""
    drives = view(spark, sf_dir, "drives")
    as_text = drives.withColumns({c: (F.col(c) * 1048576).cast("string") for c in ("total_space", "free_space")})
    return storage.drive_space(storage.bytes_to_mb(as_text, "total_space", "free_space"), scope=["server_name"])


QUERIES: dict[str, Query] = {
    # connections, sessions, requests, locks, counters
    "connections_by_login": over(sessions.connections_by_login, "processes", "databases"),
    "connections_staged": over(sessions.connections_staged, "processes", "databases", login="LOGIN_3"),
    "active_sessions": over(sessions.active_sessions, "who", login="login_7"),
    "counter_values": over(sessions.counter_values, "perf_counters", counter="Error"),
    "session_inventory": over(
        sessions.session_inventory, "sessions", "connections", "sql_text", "databases", "object_names", login="login_4", self_id=5
    ),
    "session_inventory_of_database": over(
        sessions.session_inventory, "sessions", "connections", "sql_text", "databases", "object_names", database="db_7"
    ),
    "session_inventory_all": over(
        sessions.session_inventory, "sessions", "connections", "sql_text", "databases", "object_names"
    ),
    "top_waiting_requests": over(
        sessions.top_waiting_requests, "requests", "sql_text", "query_plan", "statement_plan", "databases", "object_names", self_id=101
    ),
    "top_waiting_requests_blocked": over(
        sessions.top_waiting_requests, "requests", "sql_text", "query_plan", "statement_plan", "databases", "object_names",
        blocked_only=True, request_database_id=7,
    ),
    "top_waiting_requests_of_text_database": over(
        sessions.top_waiting_requests, "requests", "sql_text", "query_plan", "statement_plan", "databases", "object_names",
        text_database="DB_7",
    ),
    "activity_monitor": over(
        sessions.activity_monitor, "sessions", "connections", "requests", "tasks", "waiting_tasks", "workload_groups", "processes", "databases"
    ),
    "activity_monitor_head_blockers": over(
        sessions.activity_monitor, "sessions", "connections", "requests", "tasks", "waiting_tasks", "workload_groups", "processes",
        "databases", sort="cpu", head_blockers_only=True,
    ),
    "activity_monitor_of_program": over(
        sessions.activity_monitor, "sessions", "connections", "requests", "tasks", "waiting_tasks", "workload_groups", "processes",
        "databases", sort="cpu", started_before="2024-01-01 00:20:00", program_like="BUILD%",
    ),
    "activity_monitor_of_database": over(
        sessions.activity_monitor, "sessions", "connections", "requests", "tasks", "waiting_tasks", "workload_groups", "processes",
        "databases", database="DB_7",
    ),
    "activity_monitor_waiting": over(
        sessions.activity_monitor, "sessions", "connections", "requests", "tasks", "waiting_tasks", "workload_groups", "processes",
        "databases", sort="wait", waiting_only=True, resource_like="%1%",
    ),
    "workload_group_sessions": over(sessions.workload_group_sessions, "sessions", "workload_groups"),
    "workload_group_counts": over(sessions.workload_group_counts, "sessions", "workload_groups"),
    "top_cpu_requests": over(sessions.top_cpu_requests, "requests", "sql_text"),
    "running_statement": over(sessions.running_statement, "requests", "sql_text", session_id=118),
    "running_statements": over(sessions.running_statement, "requests", "sql_text"),
    "running_statements_stored": stored(sessions.running_statement, "requests", "sql_text"),
    "requests_with_plan_stored": stored(sessions.requests_with_plan, "requests", "query_plan", "sql_text"),
    "request_progress": over(sessions.request_progress, "requests", as_of=AS_OF),
    "lock_counts": over(sessions.lock_counts, "tran_locks"),
    "locked_objects": over(sessions.locked_objects, "lock_info", "processes", "objects"),
    "replica_undo_backlog": over(sessions.replica_undo_backlog, "perf_counters", counter="error"),
    "busy_requests": over(sessions.busy_requests, "sessions", "requests", "sql_text", "query_plan", "databases"),
    "requests_with_plan": over(sessions.requests_with_plan, "requests", "query_plan", "sql_text"),
    "connections_by_handle": over(sessions.connections_by_handle, "connections"),
    "connection_total": over(sessions.connection_total, "connections"),
    "blocker_of": over(sessions.blocker_of, "requests", session_id=118),
    "text_by_handle": over(sessions.text_by_handle, "sql_text", handle=42),
    # blocking
    "blocking_tree": over(blocking.blocking_tree, "processes", "sql_text"),
    "blocking_tree_narrow": over(blocking.blocking_tree, "processes", "sql_text", indent_style="narrow", dedup=True),
    "root_blockers": over(blocking.root_blockers, "processes"),
    "blocking_tree_chains": over(blocking.blocking_tree, "chained_processes", "sql_text", indent_style="narrow"),
    "root_blockers_chains": over(blocking.root_blockers, "chained_processes"),
    "blocking_episodes": over(blocking.blocking_episodes, "polled_requests", slice_seconds=3600),
    # waits
    "top_waits": over(waits.top_waits, "wait_stats", excluded=NO_LOAD_WAITS),
    "wait_pareto": over(waits.wait_pareto, "wait_stats", excluded=NO_LOAD_WAITS),
    "wait_pareto_by_server": over(waits.wait_pareto, "server_wait_stats", excluded=NO_LOAD_WAITS, threshold=80, scope=["server_name"]),
    "top_waits_by_server": over(waits.top_waits, "server_wait_stats", excluded=NO_LOAD_WAITS, scope=["server_name"]),
    "ranked_waits": over(waits.ranked_waits, "wait_stats", excluded=NO_LOAD_WAITS),
    "ranked_waits_by_server": over(waits.ranked_waits, "server_wait_stats", excluded=NO_LOAD_WAITS, scope=["server_name"]),
    "wait_type_names": over(waits.wait_type_names, "requests", "wait_map"),
    # cached statements
    "statements_matching": over(queries.statements_matching, "query_stats", "sql_text", pattern=PATTERN),
    "statements_matching_indexed": _statements_indexed,
    "cached_statements_with_plan": over(queries.cached_statements_with_plan, "query_stats", "sql_text", "statement_plan"),
    "cached_statements_stored": stored(queries.cached_statements_with_plan, "query_stats", "sql_text", "statement_plan"),
    "procedure_plans": over(queries.procedure_plans, "procedure_stats", "query_stats", "query_plan", "object_names"),
    "procedure_plans_of_database": over(
        queries.procedure_plans, "procedure_stats", "query_stats", "query_plan", "object_names", database_id=12
    ),
    "query_averages": over(queries.query_averages, "query_stats", "sql_text"),
    "ranked_statements": over(queries.ranked_statements, "query_stats", since=SINCE, min_executions=5),
    "top_queries": over(
        queries.top_queries, "query_stats", "sql_text", "query_plan", "databases", "object_names",
        since=SINCE, min_executions=25, excluded_databases=["DB_3"],
    ),
    # storage
    "heap_tables": over(storage.heap_tables, "indexes", "objects", "schemas", "partitions", "allocation_units"),
    "table_sizes": over(storage.table_sizes, "indexes", "objects", "schemas", "partitions", "allocation_units"),
    "database_sizes": over(storage.database_sizes, "databases", "master_files"),
    "volume_free_space": over(storage.volume_free_space, "master_files", "volumes"),
    "drive_space": over(storage.drive_space, "drives", scope=["server_name"]),
    "drive_space_from_bytes": _drives_from_bytes,
    "file_space": over(storage.file_space, "master_files", "file_io_stats", "file_space_used", "databases"),
    "file_space_of_path": over(
        storage.file_space, "master_files", "file_io_stats", "file_space_used", "databases", path_like="D:/%", largest_first=True
    ),
    "file_space_usage": over(storage.file_space_usage, "database_files"),
    "read_table": _table("orders"),
    "newest_rows": _newest_rows,
    "job_names": over(storage.job_names, "jobs"),
    "append_permission": _append_permission,
    # indexes
    "unused_indexes": over(
        indexes.unused_indexes, "index_usage", "indexes", "partition_stats", "partitions", "objects", "schemas"
    ),
    "index_scripts": over(indexes.index_scripts, "indexes", "index_columns", "all_columns", "tables", "schemas"),
    "unused_index_scripts": over(
        indexes.unused_index_scripts, "index_usage", "indexes", "partition_stats", "partitions", "objects", "schemas",
        "index_columns", "all_columns", "tables",
    ),
    # backups
    "last_backup_history": over(backups.last_backup_history, "backupset"),
    "database_overview": over(backups.database_overview, "databases", "master_files", "backupset", as_of=AS_OF),
    # temporary space
    "temp_table_names": over(tempspace.temp_table_names, "temp_tables"),
    "temp_table_prefixes": over(tempspace.temp_table_prefixes, "temp_tables"),
    "temp_table_count": over(tempspace.temp_table_count, "temp_tables"),
    "top_session_space": over(tempspace.top_session_space, "session_space"),
    "space_summary": over(tempspace.space_summary, "file_space"),
    "task_space_sample": over(tempspace.task_space_sample, "task_space"),
    "snapshot_query_counts": over(tempspace.snapshot_query_counts, "tempdb_snapshots", at=SNAPSHOT),
    "snapshot_text_counts": over(tempspace.snapshot_query_counts, "tempdb_snapshots", at=SNAPSHOT, chars=None),
    "snapshot_query_pages": over(tempspace.snapshot_query_pages, "tempdb_snapshots", at=SNAPSHOT),
    "snapshot_top_offenders": over(tempspace.snapshot_top_offenders, "tempdb_snapshots", at=SNAPSHOT),
    "snapshot_timeline": over(tempspace.snapshot_timeline, "tempdb_snapshots", as_of="2024-01-20 12:00:00", hours=168),
}
