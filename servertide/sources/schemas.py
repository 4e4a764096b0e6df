"""Schemas of collected telemetry tables.

Every table may also have ``server_name``, ``database_name`` and ``snapshot_ts``; reports
keep servers, databases and snapshots apart through their ``scope`` columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "sessions": """session_id INT, login_time TIMESTAMP_NTZ, last_request_start_time TIMESTAMP_NTZ,
        last_request_end_time TIMESTAMP_NTZ, is_user_process BOOLEAN, host_name STRING, program_name STRING,
        login_name STRING, status STRING, reads BIGINT, logical_reads BIGINT, writes BIGINT,
        client_interface_name STRING, nt_domain STRING, nt_user_name STRING, cpu_time INT, memory_usage INT,
        group_id INT""",
    "connections": """session_id INT, num_reads INT, num_writes INT, last_read TIMESTAMP_NTZ,
        last_write TIMESTAMP_NTZ, client_net_address STRING, local_net_address STRING, most_recent_sql_handle BINARY""",
    "requests": """session_id INT, request_id INT, blocking_session_id INT, status STRING, command STRING,
        wait_time INT, wait_type STRING, last_wait_type STRING, wait_resource STRING, percent_complete FLOAT,
        start_time TIMESTAMP_NTZ, estimated_completion_time BIGINT, open_transaction_count INT, cpu_time INT,
        logical_reads BIGINT, database_id INT, statement_start_offset INT, statement_end_offset INT,
        sql_handle BINARY, plan_handle BINARY""",
    "processes": "spid INT, blocked INT, dbid INT, loginame STRING, sql_handle BINARY",
    "sql_text": "sql_handle BINARY, dbid INT, objectid INT, text STRING",
    "query_plan": "plan_handle BINARY, query_plan STRING",
    "statement_plan": """plan_handle BINARY, statement_start_offset INT, statement_end_offset INT, query_plan STRING""",
    "query_stats": """sql_handle BINARY, statement_start_offset INT, statement_end_offset INT, plan_handle BINARY,
        creation_time TIMESTAMP_NTZ, last_execution_time TIMESTAMP_NTZ, execution_count BIGINT,
        total_worker_time BIGINT, last_worker_time BIGINT, total_logical_reads BIGINT, last_logical_reads BIGINT,
        total_elapsed_time BIGINT, last_elapsed_time BIGINT, total_rows BIGINT, last_rows BIGINT,
        total_grant_kb BIGINT, last_grant_kb BIGINT, total_used_grant_kb BIGINT, last_used_grant_kb BIGINT,
        total_ideal_grant_kb BIGINT, last_ideal_grant_kb BIGINT, plan_generation_num BIGINT""",
    "procedure_stats": "object_id INT, database_id INT, execution_count BIGINT, plan_handle BINARY",
    "wait_stats": """wait_type STRING, waiting_tasks_count BIGINT, wait_time_ms BIGINT, max_wait_time_ms BIGINT,
        signal_wait_time_ms BIGINT""",
    "waiting_tasks": """waiting_task_address BINARY, wait_duration_ms BIGINT, wait_type STRING,
        resource_description STRING, blocking_session_id INT, waiting_task_id BIGINT""",
    "tasks": "session_id INT, request_id INT, task_address BINARY, task_state STRING, exec_context_id INT",
    "workload_groups": "group_id INT, name STRING",
    "wait_map": "name STRING, map_key INT, map_value STRING",
    "tran_locks": "request_session_id INT",
    "lock_info": "rsc_objid INT, req_spid INT",
    "perf_counters": "object_name STRING, counter_name STRING, instance_name STRING, cntr_value BIGINT",
    "databases": """database_id INT, name STRING, status STRING, state_desc STRING, user_access_desc STRING,
        recovery_model_desc STRING, page_verify_option_desc STRING, compatibility_level INT,
        create_date TIMESTAMP_NTZ, is_fulltext_enabled BOOLEAN, is_auto_close_on BOOLEAN, is_read_only BOOLEAN,
        is_auto_shrink_on BOOLEAN, is_auto_create_stats_on BOOLEAN, is_auto_update_stats_on BOOLEAN,
        is_in_standby BOOLEAN, is_cleanly_shutdown BOOLEAN""",
    "master_files": """database_id INT, file_id INT, name STRING, type INT, type_desc STRING, physical_name STRING,
        size INT, growth INT, is_percent_growth BOOLEAN""",
    "file_io_stats": """database_id INT, file_id INT, size_on_disk_bytes BIGINT, num_of_reads BIGINT,
        num_of_bytes_read BIGINT, io_stall_read_ms BIGINT, num_of_writes BIGINT, num_of_bytes_written BIGINT,
        io_stall_write_ms BIGINT""",
    "file_space_used": "database_id INT, file_id INT, space_used_mb DECIMAL(18,2), free_space_perc DECIMAL(18,2)",
    "database_files": "database_id INT, file_id INT, size INT, space_used_pages INT",
    "volumes": """database_id INT, file_id INT, volume_mount_point STRING, logical_volume_name STRING,
        total_bytes BIGINT, available_bytes BIGINT, machine_name STRING, instance_name STRING""",
    "drives": "drive_letter STRING, label STRING, total_space BIGINT, free_space BIGINT",
    "backupset": """backup_set_id INT, database_name STRING, type STRING, backup_start_date TIMESTAMP_NTZ,
        backup_finish_date TIMESTAMP_NTZ""",
    "indexes": """object_id INT, index_id INT, name STRING, type_desc STRING, is_primary_key BOOLEAN,
        is_unique BOOLEAN, is_unique_constraint BOOLEAN""",
    "objects": """object_id INT, schema_id INT, name STRING, is_user_table BOOLEAN, has_clustered_index BOOLEAN""",
    "object_names": "database_id INT, object_id INT, name STRING",
    "schemas": "schema_id INT, name STRING",
    "tables": "object_id INT, schema_id INT, name STRING",
    "partitions": "partition_id BIGINT, object_id INT, index_id INT, rows BIGINT",
    "allocation_units": "container_id BIGINT, total_pages BIGINT",
    "partition_stats": "object_id INT, index_id INT, used_page_count BIGINT",
    "index_usage": """object_id INT, index_id INT, user_seeks BIGINT, user_scans BIGINT, user_lookups BIGINT,
        user_updates BIGINT, last_user_seek TIMESTAMP_NTZ, last_user_scan TIMESTAMP_NTZ,
        last_user_update TIMESTAMP_NTZ""",
    "index_columns": "object_id INT, index_id INT, column_id INT, key_ordinal INT, is_included_column BOOLEAN",
    "all_columns": "object_id INT, column_id INT, name STRING",
    "session_space": "session_id INT, user_objects_alloc_page_count BIGINT, internal_objects_alloc_page_count BIGINT",
    "task_space": """session_id INT, task_address BINARY, user_objects_alloc_page_count BIGINT,
        internal_objects_alloc_page_count BIGINT""",
    "file_space": """database_id INT, user_object_reserved_page_count BIGINT,
        internal_object_reserved_page_count BIGINT, version_store_reserved_page_count BIGINT,
        unallocated_extent_page_count BIGINT""",
    "temp_tables": "name STRING",
    "jobs": "job_id STRING, name STRING",
    "tempdb_snapshots": "collect_date TIMESTAMP_NTZ, query_text STRING, internal_pages BIGINT, user_pages BIGINT",
    "truncate_permission": "table_name STRING, principal STRING",
}

# The captured list of active sessions is text throughout.
_WHO = (
    "spid", "status", "login", "host_name", "blk_by", "db_name", "command", "cpu_time", "disk_io", "last_batch",
    "program_name", "spid2", "request",
)

_SCOPE_TYPES = {"server_name": T.StringType(), "database_name": T.StringType(), "snapshot_ts": T.TimestampNTZType()}


def schema(table: str, *scope: str) -> T.StructType:
    """Schema of a telemetry table, with the given scope columns in front."""
    fields = [T.StructField(name, _SCOPE_TYPES[name]) for name in scope]
    if table == "who":
        return T.StructType(fields + [T.StructField(name, T.StringType()) for name in _WHO])
    return T.StructType(fields + list(T.StructType.fromDDL(_DDL[table]).fields))


def tables() -> list[str]:
    return sorted([*_DDL, "who"])
