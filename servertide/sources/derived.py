"""Telemetry-shaped views over the supplied test tables.

The same text runs in Spark and as a CTE in the checking SQL, so both sides see equal
rows. Every view reads its whole tables; keys map onto the full range of the table they
refer to, so groups stay small as the data grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOCS = "(SELECT count(*) FROM documents)"


def _whole(expression: str) -> str:
    return f"CAST(floor({expression}) AS BIGINT)"


def _text(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR(20))"


def _database_of(object_id: str) -> str:
    """Name of the database that holds a table: four of users, one of the server."""
    return f"CASE {object_id} % 5 WHEN 0 THEN 'master' ELSE concat('DB_', {_text(object_id + ' % 5')}) END"


# Who blocks session c_custkey + 1: sessions 51 to 56 are heads of trees with seven sessions below each.
_BLOCKER = f"CASE WHEN c_custkey < 56 THEN 0 ELSE 50 + {_whole('(c_custkey - 49) / 7')} END"

# Logins in three spellings, which are one under the server's collation.
_LOGIN = f"concat(CASE c_custkey % 3 WHEN 0 THEN 'Login_' WHEN 1 THEN 'login_' ELSE 'LOGIN_' END, {_text('c_custkey % 20')}, CASE c_custkey % 7 WHEN 0 THEN ' ' ELSE '' END)"

_START = "TIMESTAMP '2024-01-01 00:00:00'"

# Columns of the supplied tables that the views read.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
        l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
        l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}

# view: (tables it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "processes": (("customer", "documents"), f"""
        SELECT c_custkey + 1 AS spid,
               CASE WHEN (c_custkey + 1) % 101 = 0 THEN c_custkey + 1 ELSE {_BLOCKER} END AS blocked,
               CAST(c_nationkey AS BIGINT) AS dbid, {_LOGIN} AS loginame,
               c_custkey % {_DOCS} AS sql_handle
        FROM customer"""),
    # Chains of 150 sessions, of which every tenth is a cycle; some sessions have two equal rows.
    "chained_processes": (("orders", "documents"), f"""
        SELECT o_orderkey + 1 AS spid,
               CASE WHEN o_orderkey % 150 <> 0 THEN o_orderkey WHEN o_orderkey % 1500 = 1350 THEN o_orderkey + 150 ELSE 0 END AS blocked,
               o_custkey % 5 AS dbid, concat('login_', {_text('o_custkey % 20')}) AS loginame, o_custkey % {_DOCS} AS sql_handle
        FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL
              SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 40 = 0) AS listed"""),
    "who": (("customer",), f"""
        SELECT {_text('c_custkey + 1')} AS spid,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'SUSPENDED' ELSE 'RUNNABLE' END AS status,
               {_LOGIN} AS login, c_mktsegment AS host_name,
               {_text(_whole('(c_custkey + 1) / 7'))} AS blk_by, concat('DB_', {_text('c_nationkey')}) AS db_name,
               'SELECT' AS command, {_text(_whole('c_acctbal + 1000'))} AS cpu_time, {_text('c_custkey * 5')} AS disk_io,
               '01/01 00:00:00' AS last_batch, c_name AS program_name, {_text('c_custkey + 1')} AS spid2, '0' AS request
        FROM customer"""),
    "sessions": (("customer",), f"""
        SELECT c_custkey + 1 AS session_id, {_START} - INTERVAL '1' SECOND * (c_custkey * 7) AS login_time,
               {_START} + INTERVAL '1' SECOND * c_custkey AS last_request_start_time,
               {_START} + INTERVAL '1' SECOND * (c_custkey + c_nationkey) AS last_request_end_time,
               c_custkey % 50 <> 0 AS is_user_process,
               CASE WHEN c_nationkey = 3 THEN NULL ELSE concat('host_', {_text('c_nationkey')}) END AS host_name,
               c_mktsegment AS program_name, {_LOGIN} AS login_name,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'sleeping' WHEN 'FURNITURE' THEN 'suspended' ELSE 'running' END AS status,
               c_custkey * 3 AS reads, {_whole('c_acctbal + 1000')} AS logical_reads, c_custkey * 2 AS writes,
               'ODBC' AS client_interface_name, 'CORP' AS nt_domain, c_name AS nt_user_name,
               {_whole('c_acctbal + 1000')} AS cpu_time, c_custkey % 1000 AS memory_usage, c_custkey % 5 AS group_id
        FROM customer"""),
    "connections": (("orders", "documents"), f"""
        SELECT o_custkey + 1 AS session_id, count(*) AS num_reads, count(DISTINCT o_orderstatus) AS num_writes,
               max(o_orderdate) AS last_read, min(o_orderdate) AS last_write,
               concat('10.0.0.', {_text('o_custkey % 250')}) AS client_net_address, '10.0.0.1' AS local_net_address,
               o_custkey % ({_DOCS} + 7) AS most_recent_sql_handle
        FROM orders GROUP BY o_custkey"""),
    "requests": (("customer", "documents"), f"""
        SELECT c_custkey + 1 AS session_id, CAST(0 AS BIGINT) AS request_id,
               {_BLOCKER} AS blocking_session_id,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'Suspended' WHEN 'MACHINERY' THEN 'Background' ELSE 'running' END AS status,
               CASE c_nationkey WHEN 0 THEN 'TASK MANAGER' ELSE 'SELECT' END AS command,
               (c_custkey * 7919) % 100003 AS wait_time, {_text('c_nationkey')} AS wait_type,
               concat('NATION_', {_text('c_custkey % 7')}) AS last_wait_type, concat('page ', {_text('c_custkey')}) AS wait_resource,
               CAST(c_nationkey AS DOUBLE) AS percent_complete, {_START} + INTERVAL '1' SECOND * (c_custkey * 13) AS start_time,
               ((c_custkey * 7919) % 100003) * 100 AS estimated_completion_time, c_custkey % 3 AS open_transaction_count,
               {_whole('c_acctbal + 1000')} AS cpu_time, {_whole('c_acctbal * 3 + 4000')} AS logical_reads,
               CAST(c_nationkey AS BIGINT) AS database_id, 2 * (c_custkey % 10) AS statement_start_offset,
               CASE c_custkey % 4 WHEN 0 THEN -1 ELSE 2 * (c_custkey % 10) + 40 END AS statement_end_offset,
               c_custkey AS sql_handle, c_custkey % {_DOCS} AS plan_handle
        FROM customer"""),
    # Polls a minute apart, some left out, of twenty sessions each. Who blocks whom changes every seven polls;
    # session 59 blocks others without a request of its own.
    "polled_requests": (("orders",), f"""
        SELECT {_START} + INTERVAL '1' SECOND * (60 * poll) AS snapshot_ts, 51 + place AS session_id,
               CASE WHEN (place + turn) % 4 IN (1, 2) AND place >= 1 THEN 50 + place
                    WHEN (place + turn) % 4 = 3 AND place >= 3 THEN 48 + place ELSE 0 END AS blocking_session_id
        FROM (SELECT {_whole('o_orderkey / 20')} AS poll, o_orderkey % 20 AS place, {_whole('o_orderkey / 140')} AS turn FROM orders) AS polls
        WHERE place <> 8 AND NOT (turn % 3 = 2 AND poll % 7 = 3)"""),
    "tasks": (("customer",), """
        SELECT c_custkey + 1 AS session_id, CAST(0 AS BIGINT) AS request_id, c_custkey AS task_address,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'RUNNABLE' WHEN 'BUILDING' THEN 'RUNNING'
                    WHEN 'FURNITURE' THEN 'Suspended' ELSE 'DONE' END AS task_state, c_custkey % 4 AS exec_context_id
        FROM customer"""),
    "waiting_tasks": (("events", "customer"), f"""
        SELECT user_id AS waiting_task_address, {_whole('value * 100')} AS wait_duration_ms, event_type AS wait_type,
               props AS resource_description, user_id % 7 AS blocking_session_id, event_id AS waiting_task_id
        FROM events
        UNION ALL
        SELECT c_custkey, c_custkey % 977 * 10, concat('LCK_M_', {_text('c_custkey % 3')}), concat('page ', {_text('c_custkey')}),
               51 + c_custkey % 9, -c_custkey
        FROM customer WHERE c_mktsegment = 'FURNITURE'"""),
    "workload_groups": (("region",), """
        SELECT CAST(r_regionkey AS BIGINT) AS group_id, CASE r_regionkey WHEN 0 THEN 'internal' ELSE r_name END AS name
        FROM region"""),
    "wait_map": (("nation",), f"""
        SELECT {_text('n_nationkey')} AS map_key, CASE WHEN n_regionkey = 2 THEN 'lock_mode' ELSE 'wait_types' END AS name,
               CASE WHEN n_regionkey = 1 THEN 'UNKNOWN' ELSE n_name END AS map_value
        FROM nation"""),
    "sql_text": (("documents",), f"""
        SELECT doc_id AS sql_handle, {_whole('doc_id / 8')} AS dbid, doc_id % 7 AS objectid, text FROM documents"""),
    "query_plan": (("documents",), f"""
        SELECT doc_id AS plan_handle,
               concat('<plan source="', source, '" lang="', lang, '"><cost>', {_text('n_chars')}, '</cost></plan>') AS query_plan
        FROM documents"""),
    "statement_plan": (("part",), f"""
        SELECT {_whole('p_partkey / 2')} AS plan_handle, 2 * (p_partkey % 10) AS statement_start_offset,
               CASE p_partkey % 4 WHEN 0 THEN -1 ELSE 2 * (p_partkey % 10) + 40 END AS statement_end_offset,
               concat('<plan type="', p_type, '"><size>', {_text('p_size')}, CASE p_size % 7 WHEN 0 THEN '<size>' ELSE '</size></plan>' END) AS query_plan
        FROM part"""),
    "query_stats": (("lineitem", "documents"), f"""
        SELECT l_partkey % {_DOCS} AS sql_handle, {_whole('l_partkey / 2')} AS plan_handle,
               2 * (l_partkey % 10) AS statement_start_offset,
               CASE l_partkey % 4 WHEN 0 THEN -1 ELSE 2 * (l_partkey % 10) + 40 END AS statement_end_offset, creation_time,
               last_execution_time, execution_count, total_worker_time, last_worker_time, total_logical_reads,
               last_logical_reads, total_worker_time * 2 AS total_elapsed_time, last_worker_time * 2 AS last_elapsed_time,
               total_rows, last_rows, total_rows * 8 AS total_grant_kb, last_rows * 8 AS last_grant_kb,
               total_rows * 4 AS total_used_grant_kb, last_rows * 4 AS last_used_grant_kb,
               total_rows * 16 AS total_ideal_grant_kb, last_rows * 16 AS last_ideal_grant_kb,
               last_rows AS plan_generation_num
        FROM (SELECT l_partkey, min(l_shipdate) AS creation_time, max(l_shipdate) AS last_execution_time,
                     count(*) AS execution_count, CAST(sum({_whole('l_extendedprice')}) AS BIGINT) AS total_worker_time,
                     max({_whole('l_extendedprice')}) AS last_worker_time,
                     CAST(sum({_whole('l_quantity')}) AS BIGINT) AS total_logical_reads,
                     max({_whole('l_quantity')}) AS last_logical_reads, CAST(sum(l_linenumber) AS BIGINT) AS total_rows,
                     CAST(max(l_linenumber) AS BIGINT) AS last_rows
              FROM lineitem GROUP BY l_partkey) AS statements"""),
    "procedure_stats": (("part",), f"""
        SELECT plan_handle, {_whole('first_part / 10')} AS database_id, first_part % 10 AS object_id, execution_count
        FROM (SELECT {_whole('p_partkey / 2')} AS plan_handle, min(p_partkey) AS first_part, CAST(sum(p_size) AS BIGINT) AS execution_count
              FROM part GROUP BY {_whole('p_partkey / 2')}) AS procedures"""),
    "wait_stats": (("lineitem",), f"""
        SELECT concat('WAIT_', {_text('l_suppkey')}) AS wait_type, count(*) AS waiting_tasks_count,
               CAST(sum({_whole('l_quantity')} * (1 + (l_suppkey % 10) * (l_suppkey % 10) * (l_suppkey % 10))) AS BIGINT) AS wait_time_ms,
               max({_whole('l_quantity')} * (1 + (l_suppkey % 10) * (l_suppkey % 10) * (l_suppkey % 10))) AS max_wait_time_ms,
               CAST(sum(l_linenumber) AS BIGINT) AS signal_wait_time_ms
        FROM lineitem GROUP BY l_suppkey"""),
    "server_wait_stats": (("lineitem",), f"""
        SELECT concat('server_', l_returnflag, l_linestatus) AS server_name, concat('WAIT_', {_text('l_suppkey')}) AS wait_type,
               count(*) AS waiting_tasks_count,
               CAST(sum({_whole('l_quantity')} * (1 + (l_suppkey % 10) * (l_suppkey % 10))) AS BIGINT) AS wait_time_ms,
               max({_whole('l_quantity')} * (1 + (l_suppkey % 10) * (l_suppkey % 10))) AS max_wait_time_ms,
               CAST(sum(l_linenumber) AS BIGINT) AS signal_wait_time_ms
        FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey"""),
    "tran_locks": (("lineitem",), "SELECT l_suppkey + 1 AS request_session_id FROM lineitem"),
    "lock_info": (("lineitem",), "SELECT l_partkey AS rsc_objid, l_suppkey + 1 AS req_spid FROM lineitem"),
    "perf_counters": (("events",), f"""
        SELECT concat('Srv:Database Replica ', {_text('user_id % 3')}) AS object_name, CASE user_id % 2 WHEN 0 THEN upper(event_type) ELSE event_type END AS counter_name,
               {_text('user_id')} AS instance_name, CAST(sum({_whole('value / 100')}) AS BIGINT) AS cntr_value
        FROM events GROUP BY user_id, event_type"""),
    "databases": (("orders",), f"""
        SELECT database_id, concat('DB_', {_text('database_id')}) AS name,
               CASE database_id % 9 WHEN 0 THEN 'RECOVERY_PENDING' ELSE 'ONLINE' END AS status, 'ONLINE' AS state_desc,
               CASE database_id % 4 WHEN 0 THEN 'SINGLE_USER' ELSE 'MULTI_USER' END AS user_access_desc,
               CASE database_id % 3 WHEN 0 THEN 'SIMPLE' ELSE 'FULL' END AS recovery_model_desc,
               CASE database_id % 2 WHEN 0 THEN 'CHECKSUM' ELSE 'NONE' END AS page_verify_option_desc,
               CASE database_id % 5 WHEN 0 THEN 90 WHEN 1 THEN 100 WHEN 2 THEN 150 ELSE 80 END AS compatibility_level,
               create_date, database_id % 2 = 0 AS is_fulltext_enabled, database_id % 3 = 0 AS is_auto_close_on,
               database_id % 5 = 0 AS is_read_only, database_id % 7 = 0 AS is_auto_shrink_on,
               database_id % 2 = 1 AS is_auto_create_stats_on, database_id % 3 = 1 AS is_auto_update_stats_on,
               database_id % 11 = 0 AS is_in_standby, database_id % 13 = 0 AS is_cleanly_shutdown
        FROM (SELECT {_whole('o_custkey / 8')} AS database_id, min(o_orderdate) AS create_date
              FROM orders GROUP BY {_whole('o_custkey / 8')}) AS d"""),
    "master_files": (("part",), f"""
        SELECT {_whole('p_partkey / 10')} AS database_id, p_partkey AS file_id, p_name AS name,
               CASE WHEN p_size <= 12 THEN 1 ELSE 0 END AS type, CASE WHEN p_size <= 12 THEN 'LOG' ELSE 'ROWS' END AS type_desc,
               concat(CASE p_size % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 't' END, ':/', p_name) AS physical_name,
               {_whole('p_retailprice * 10')} AS size, p_size AS growth, p_partkey % 2 = 1 AS is_percent_growth
        FROM part"""),
    "file_io_stats": (("lineitem",), f"""
        SELECT {_whole('l_partkey / 10')} AS database_id, l_partkey AS file_id,
               CAST(sum({_whole('l_extendedprice * 100')}) AS BIGINT) AS size_on_disk_bytes, count(*) AS num_of_reads,
               CAST(sum({_whole('l_quantity')}) AS BIGINT) AS num_of_bytes_read, CAST(sum(l_linenumber) AS BIGINT) AS io_stall_read_ms,
               count(DISTINCT l_suppkey) AS num_of_writes, CAST(max({_whole('l_quantity')}) AS BIGINT) AS num_of_bytes_written,
               CAST(min(l_linenumber) AS BIGINT) AS io_stall_write_ms
        FROM lineitem GROUP BY l_partkey"""),
    "file_space_used": (("part",), f"""
        SELECT {_whole('p_partkey / 10')} AS database_id, p_partkey AS file_id,
               CAST({_whole('p_retailprice')} AS DECIMAL(18,2)) AS space_used_mb, CAST(p_size AS DECIMAL(18,2)) AS free_space_perc
        FROM part"""),
    "database_files": (("part",), f"""
        SELECT {_whole('p_partkey / 10')} AS database_id, p_partkey AS file_id, {_whole('p_retailprice * 10')} AS size,
               {_whole('p_retailprice * 10 * p_size / 50')} AS space_used_pages
        FROM part"""),
    "volumes": (("part",), f"""
        SELECT {_whole('p_partkey / 10')} AS database_id, p_partkey AS file_id, concat('V', {_text('p_size')}, ':/') AS volume_mount_point,
               concat('vol ', {_text('p_size')}) AS logical_volume_name, CAST(1000000007 AS BIGINT) * (p_size + 100) AS total_bytes,
               CAST(791900003 AS BIGINT) * (p_size + 1) AS available_bytes, concat('machine_', {_text('p_size % 4')}) AS machine_name,
               CASE WHEN p_size % 4 <> 1 THEN concat('instance_', {_text('p_size % 2')}) END AS instance_name
        FROM part"""),
    "drives": (("supplier",), """
        SELECT s_name AS server_name, CASE s_nationkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'D' ELSE 'T' END AS drive_letter,
               concat('disk ', s_name) AS label, 100003 + s_suppkey * 37 AS total_space, 7919 + s_suppkey * 11 AS free_space
        FROM supplier"""),
    "backupset": (("orders",), f"""
        SELECT o_orderkey AS backup_set_id,
               concat(CASE o_orderkey % 3 WHEN 0 THEN 'db_' ELSE 'DB_' END, {_text(_whole('o_custkey / 8') + ' + 5')}) AS database_name,
               CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'I' ELSE 'L' END AS type,
               o_orderdate AS backup_start_date, o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 120000) AS backup_finish_date
        FROM orders"""),
    "objects": (("customer",), f"""
        SELECT {_database_of('c_custkey')} AS database_name, c_custkey AS object_id, c_name AS name, c_nationkey AS schema_id,
               c_mktsegment <> 'HOUSEHOLD' AS is_user_table, c_mktsegment = 'BUILDING' AS has_clustered_index
        FROM customer"""),
    "object_names": (("part",), f"""
        SELECT {_whole('p_partkey / 10')} AS database_id, p_partkey % 10 AS object_id, concat(p_name, ' ', {_text('p_partkey')}) AS name
        FROM part"""),
    "schemas": (("customer", "nation"), f"""
        SELECT DISTINCT {_database_of('c_custkey')} AS database_name, n_nationkey AS schema_id,
               CASE n_nationkey WHEN 0 THEN 'sys' ELSE n_name END AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "tables": (("customer",), f"""
        SELECT {_database_of('c_custkey')} AS database_name, c_custkey AS object_id, c_nationkey AS schema_id, c_name AS name
        FROM customer"""),
    "indexes": (("orders",), f"""
        SELECT {_database_of('object_id')} AS database_name, object_id, index_id,
               CASE index_id WHEN 0 THEN NULL ELSE concat('ix_', {_text('object_id % 900')}, CASE index_id WHEN 3 THEN ']_' ELSE '_' END, {_text('index_id')}) END AS name,
               CASE index_id WHEN 0 THEN 'HEAP' WHEN 1 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END AS type_desc,
               index_id = 1 AS is_primary_key, object_id % 6 = 0 AS is_unique, object_id % 7 = 0 AS is_unique_constraint
        FROM (SELECT DISTINCT o_custkey AS object_id, o_orderkey % 5 AS index_id FROM orders) AS i"""),
    "partitions": (("orders",), f"""
        SELECT {_database_of('o_custkey')} AS database_name, o_orderkey AS partition_id, o_custkey AS object_id,
               o_orderkey % 5 AS index_id, {_whole('o_totalprice / 1000')} AS rows
        FROM orders"""),
    "allocation_units": (("lineitem", "orders"), f"""
        SELECT {_database_of('o_custkey')} AS database_name, l_orderkey AS container_id, {_whole('l_quantity')} AS total_pages
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "partition_stats": (("orders",), f"""
        SELECT {_database_of('o_custkey')} AS database_name, o_custkey AS object_id, o_orderkey % 5 AS index_id,
               {_whole('o_totalprice / 100')} AS used_page_count
        FROM orders"""),
    "index_usage": (("lineitem", "orders"), f"""
        SELECT {_database_of('o_custkey')} AS database_name, o_custkey AS object_id, CAST(l_linenumber % 5 AS BIGINT) AS index_id,
               count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS user_seeks, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS user_scans,
               count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS user_lookups, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS user_updates,
               max(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN l_shipdate END) AS last_user_seek,
               max(CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN l_shipdate END) AS last_user_scan,
               max(CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS last_user_update
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_linenumber % 5"""),
    "index_columns": (("orders",), f"""
        SELECT DISTINCT {_database_of('o_custkey')} AS database_name, o_custkey AS object_id, o_orderkey % 5 AS index_id,
               1 + o_orderkey % 9 AS column_id, CASE WHEN o_orderkey % 9 > 6 THEN 0 ELSE 1 + o_orderkey % 9 END AS key_ordinal,
               o_orderkey % 9 > 6 AS is_included_column
        FROM orders"""),
    "all_columns": (("orders",), f"""
        SELECT DISTINCT {_database_of('o_custkey')} AS database_name, o_custkey AS object_id, 1 + o_orderkey % 9 AS column_id,
               concat('col_', {_text('o_custkey')}, '_', {_text('1 + o_orderkey % 9')}) AS name
        FROM orders"""),
    "session_space": (("events",), f"""
        SELECT user_id AS session_id, count(*) AS user_objects_alloc_page_count,
               CAST(sum({_whole('value')}) AS BIGINT) AS internal_objects_alloc_page_count
        FROM events GROUP BY user_id"""),
    "task_space": (("events",), f"""
        SELECT user_id AS session_id, event_id AS task_address, {_whole('value')} AS user_objects_alloc_page_count,
               {_whole('value * 3')} AS internal_objects_alloc_page_count
        FROM events"""),
    "file_space": (("customer",), f"""
        SELECT c_nationkey AS database_id, {_whole('c_acctbal + 1000')} AS user_object_reserved_page_count,
               c_custkey % 1000 AS internal_object_reserved_page_count, c_custkey * 3 AS version_store_reserved_page_count,
               c_custkey * 5 AS unallocated_extent_page_count
        FROM customer"""),
    "temp_tables": (("part",), f"""
        SELECT CASE WHEN p_size < 9 THEN p_name ELSE concat('#', p_type, '_', p_brand, '____', {_text('p_partkey')}) END AS name
        FROM part"""),
    "tempdb_snapshots": (("events", "documents"), f"""
        SELECT date_trunc('day', ts) AS collect_date, text AS query_text, {_whole('value')} AS internal_pages, user_id AS user_pages
        FROM (SELECT ts, value, user_id, event_id % {_DOCS} AS doc FROM events) AS e JOIN documents ON doc = doc_id"""),
    "jobs": (("part",), f"""
        SELECT concat('job-', {_text('p_partkey')}) AS job_id, concat(p_name, ' of ', p_brand) AS name FROM part"""),
    "truncate_permission": (("customer",), f"""
        SELECT concat('db.dbo.table_', {_text('c_custkey % 97')}) AS table_name, c_name AS principal FROM customer"""),
}


def views(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> list[DataFrame]:
    """Telemetry-shaped DataFrames over the tables in ``sf_dir``."""
    for table in sorted({table for name in names for table in VIEWS[name][0]}):
        spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return [_without_zones(spark.sql(VIEWS[name][1])) for name in names]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return views(spark, sf_dir, [name])[0]


def _without_zones(df: DataFrame) -> DataFrame:
    """Collected timestamps have no zone; literals in the texts have one in Spark."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def with_views(names: Sequence[str], query: str, recursive: bool = False) -> str:
    """Checking SQL: the texts of the views as CTEs, then the query (which may go on with CTEs)."""
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in names)
    rest = query.strip()
    glue = ",\n" if rest.startswith("AND ") else "\n"
    rest = rest[4:] if rest.startswith("AND ") else rest
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{glue}{rest}"
