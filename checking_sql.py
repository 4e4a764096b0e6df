"""Checking SQL for each registered query. It shares only the texts of the views and works
differently where the library does something of its own: forests are climbed session by
session, running sums are plain windows, rankings are window numbers.
"""

from __future__ import annotations

from registered import AS_OF, NO_LOAD_WAITS, SINCE, SNAPSHOT
from servertide.plans.backups import FLAG_TEXTS
from servertide.plans.storage import DEFAULT_INSTANCE, SYSTEM_DATABASES
from servertide.plans.waits import WAIT_HELP_PREFIX
from servertide.sources.derived import with_views

_SYSTEM = ", ".join(f"'{name}'" for name in SYSTEM_DATABASES)
_WAITS = ", ".join(f"'{w}'" for w in NO_LOAD_WAITS)


def half_up(n: str, d: str, precision: int, scale: int) -> str:
    """n / d of integers (d > 0), rounded half away from zero."""
    top = f"abs(CAST({n} AS HUGEINT))"
    bottom = f"CAST({d} AS HUGEINT)"
    unit = f"CAST({'0.' + '0' * (scale - 1) + '1'} AS DECIMAL({scale + 1},{scale}))"
    return f"CAST(sign({n}) * CAST((2 * {top} * {10**scale} + {bottom}) // (2 * {bottom}) AS DECIMAL(24,0)) * {unit} AS DECIMAL({precision},{scale}))"


def cut_statement(variant: str, text: str = "t.text", start: str = "r.statement_start_offset", end: str = "r.statement_end_offset") -> str:
    until = {
        "inclusive": f"CASE WHEN {end} = -1 THEN length(rtrim({text}, ' ')) * 2 ELSE {end} END",
        "exclusive": f"CASE WHEN {end} = -1 THEN length(rtrim({text}, ' ')) * 2 ELSE {end} END",
        "zero_based": f"CASE WHEN {end} < 0 THEN (length({text}) + 1) * 2 ELSE {end} END",
        "zero_based_bytes": f"CASE WHEN {end} = -1 THEN length({text}) * 2 ELSE {end} END",
    }[variant]
    chars = f"(({until}) - {start}) // 2"
    if variant == "inclusive":
        return f"substring({text}, 1 + {start} // 2, 1 + {chars})"
    if variant == "exclusive":
        return f"substring({text}, 1 + {start} // 2, {chars})"
    return f"CASE WHEN {start} // 2 = 0 THEN substring({text}, 1, {chars} - 1) ELSE substring({text}, {start} // 2, {chars}) END"


def _session_inventory(condition: str) -> str:
    return with_views(["sessions", "connections", "sql_text", "databases", "object_names"], f"""AND batches AS (
            SELECT t.sql_handle AS most_recent_sql_handle, d.name AS database_name, o.name AS object_name, coalesce(t.text, '') AS query
            FROM sql_text t LEFT JOIN databases d ON d.database_id = t.dbid
                 LEFT JOIN object_names o ON o.database_id = t.dbid AND o.object_id = t.objectid)
        SELECT * EXCLUDE (most_recent_sql_handle, cpu_time, memory_usage, group_id), concat('Kill ', session_id) AS kill_command
        FROM connections JOIN sessions USING (session_id) JOIN batches USING (most_recent_sql_handle)
        WHERE {condition}""")


_REQUEST = """r.session_id, r.request_id, r.status, r.command, r.wait_time, r.wait_type, r.last_wait_type, r.wait_resource,
    r.blocking_session_id, r.cpu_time, r.logical_reads, r.database_id, r.percent_complete, r.start_time, r.estimated_completion_time,
    r.open_transaction_count, r.statement_start_offset, r.statement_end_offset, r.sql_handle, r.plan_handle"""


def _top_waiting(condition: str) -> str:
    return with_views(["requests", "sql_text", "query_plan", "statement_plan", "databases", "object_names"], f"""AND r AS (
            SELECT * FROM requests WHERE lower(status) <> 'background' AND lower(command) <> 'task manager' AND {condition}
            ORDER BY wait_time DESC, session_id, request_id LIMIT 20),
        named AS (
            SELECT t.sql_handle, t.text, d.name AS database_name, o.name AS object_name
            FROM sql_text t LEFT JOIN databases d ON d.database_id = t.dbid
                 LEFT JOIN object_names o ON o.database_id = t.dbid AND o.object_id = t.objectid),
        statements AS (SELECT * RENAME (query_plan AS statement_plan) FROM statement_plan)
        SELECT {_REQUEST}, database_name, object_name, t.text AS sql_text, {cut_statement('inclusive')} AS sql_statement,
               query_plan, statement_plan,
               CASE WHEN statement_plan LIKE '%</size></plan>' THEN statement_plan END AS statement_plan_xml
        FROM r LEFT JOIN named t USING (sql_handle) LEFT JOIN query_plan USING (plan_handle)
             LEFT JOIN statements USING (plan_handle, statement_start_offset, statement_end_offset)""")


def _activity(condition: str) -> str:
    names = ["sessions", "connections", "requests", "tasks", "waiting_tasks", "workload_groups", "processes", "databases"]
    return with_views(names, f"""AND longest AS (
            SELECT waiting_task_address AS task_address, wait_duration_ms, wait_type, resource_description, blocking_session_id
            FROM waiting_tasks
            QUALIFY row_number() OVER (PARTITION BY waiting_task_address ORDER BY wait_duration_ms DESC, waiting_task_id) = 1),
        waiters AS (SELECT blocking_session_id AS session_id, session_id AS waiter FROM requests),
        active AS (
            SELECT session_id, request_id, task_address, task_state, exec_context_id, command, open_transaction_count, blocking_session_id AS waits_for
            FROM tasks JOIN requests USING (session_id, request_id) WHERE lower(task_state) IN ('runnable', 'running', 'suspended')),
        placed AS (SELECT p.spid AS session_id, d.name FROM processes p LEFT JOIN databases d ON d.database_id = p.dbid)
        SELECT concat('Kill ', session_id) AS kill_command, session_id, CAST(CAST(is_user_process AS INTEGER) AS VARCHAR) AS user_process,
               login_name AS login, coalesce(placed.name, '') AS database, task_state, command, program_name AS application,
               coalesce(wait_duration_ms, 0) AS wait_time_ms, coalesce(wait_type, '') AS wait_type,
               coalesce(resource_description, '') AS wait_resource, coalesce(CAST(longest.blocking_session_id AS VARCHAR), '') AS blocked_by,
               CASE WHEN waiter IS NOT NULL AND waits_for = 0 THEN '1' ELSE '' END AS head_blocker, cpu_time AS total_cpu_ms,
               (reads + writes) * 8 // 1024 AS total_physical_io_mb, memory_usage * 8192 // 1024 AS memory_use_kb,
               open_transaction_count AS open_transactions,
               login_time, last_request_start_time, coalesce(host_name, '') AS host_name, coalesce(client_net_address, '') AS net_address,
               exec_context_id AS execution_context_id, active.request_id, workload_groups.name AS workload_group
        FROM active JOIN sessions USING (session_id) JOIN workload_groups USING (group_id)
             LEFT JOIN connections USING (session_id) LEFT JOIN placed USING (session_id) LEFT JOIN waiters USING (session_id)
             LEFT JOIN longest USING (task_address)
        WHERE workload_groups.name <> 'internal' AND session_id > 50 AND {condition}""")


def _blocking_tree(margin: str, indent: str, head: str, blocked: str, view: str = "processes") -> str:
    """Each session climbs to its head; those that arrive at one that blocks somebody are the forest. UNION ends cycles."""
    return with_views([view, "sql_text"], f"""AND known AS (
            SELECT DISTINCT spid, blocked, CASE WHEN blocked NOT IN (0, spid) THEN blocked END AS blocker,
                   replace(replace(text, chr(10), ' '), chr(13), ' ') AS batch
            FROM {view} JOIN sql_text USING (sql_handle)),
        climb AS (
            SELECT spid, spid AS reached, blocker AS next FROM known
            UNION
            SELECT c.spid, k.spid, k.blocker FROM climb c JOIN known k ON k.spid = c.next),
        steps AS (SELECT spid, CAST(count(*) - 1 AS INTEGER) AS depth FROM climb GROUP BY spid),
        arrived AS (
            SELECT spid, reached AS root_spid, depth FROM climb JOIN steps USING (spid)
            WHERE next IS NULL AND reached IN (SELECT blocker FROM known WHERE blocker IS NOT NULL))
        SELECT spid, blocked, root_spid, depth,
               concat('{margin}', repeat('{indent}', depth), CASE depth WHEN 0 THEN '{head}' ELSE '{blocked}' END, spid, ' ', batch) AS blocking_tree
        FROM arrived JOIN known USING (spid)""", recursive=True)


def _root_blockers(view: str) -> str:
    return with_views([view], f"""AND links AS (
            SELECT spid, max(CASE WHEN blocked NOT IN (0, spid) THEN blocked END) AS direct_blocker FROM {view} GROUP BY spid),
        climb AS (
            SELECT spid, spid AS reached, direct_blocker AS next FROM links
            UNION
            SELECT c.spid, l.spid, l.direct_blocker FROM climb c JOIN links l ON l.spid = c.next),
        steps AS (SELECT spid, count(*) - 1 AS chain_length FROM climb GROUP BY spid),
        heads AS (SELECT spid, reached AS root_blocker, chain_length FROM climb JOIN steps USING (spid) WHERE next IS NULL),
        behind AS (SELECT reached AS spid, count(*) - 1 AS passed FROM climb GROUP BY reached)
        SELECT spid, direct_blocker, root_blocker, chain_length, CASE WHEN root_blocker IS NOT NULL THEN passed END AS blocked_descendants
        FROM links LEFT JOIN heads USING (spid) JOIN behind USING (spid)""", recursive=True)


def _file_space(condition: str) -> str:
    return with_views(["master_files", "file_io_stats", "file_space_used", "databases"], f"""
        SELECT d.name AS database_name, database_id, file_id, type_desc, upper(physical_name[1]) AS disk_drive, physical_name,
               {half_up('size_on_disk_bytes', '1048576', 18, 2)} AS size_on_disk_mb, space_used_mb, free_space_perc,
               CASE WHEN is_percent_growth THEN concat(growth, '%') ELSE concat(growth * 8 // 1024, ' MB') END AS growth,
               {half_up('CASE WHEN is_percent_growth THEN size * growth ELSE growth * 100 END', '12800', 18, 2)} AS next_growth_mb,
               num_of_reads, num_of_bytes_read, io_stall_read_ms, num_of_writes, num_of_bytes_written, io_stall_write_ms
        FROM master_files LEFT JOIN file_io_stats USING (database_id, file_id) LEFT JOIN file_space_used USING (database_id, file_id)
             LEFT JOIN databases d USING (database_id) WHERE {condition}""")


def _blocking_episodes() -> str:
    """Every blocked session climbs to its head, poll by poll."""
    return with_views(["polled_requests"], """AND links AS (
            SELECT DISTINCT snapshot_ts, session_id, blocking_session_id AS blocker
            FROM polled_requests WHERE blocking_session_id NOT IN (0, session_id)),
        climb AS (
            SELECT snapshot_ts, session_id, blocker AS reached, 1 AS steps FROM links
            UNION ALL
            SELECT c.snapshot_ts, c.session_id, l.blocker, c.steps + 1
            FROM climb c JOIN links l ON l.snapshot_ts = c.snapshot_ts AND l.session_id = c.reached),
        heads AS (
            SELECT c.snapshot_ts, reached AS head, count(*) AS blocked, max(steps) AS longest
            FROM climb c ANTI JOIN links l ON l.snapshot_ts = c.snapshot_ts AND l.session_id = c.reached GROUP BY ALL),
        marked AS (
            SELECT *, CASE WHEN snapshot_ts - lag(snapshot_ts) OVER (PARTITION BY head ORDER BY snapshot_ts) <= INTERVAL '60' SECOND
                           THEN 0 ELSE 1 END AS fresh
            FROM heads),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY head ORDER BY snapshot_ts) AS episode FROM marked)
        SELECT head, min(snapshot_ts) AS episode_start, max(snapshot_ts) AS episode_end, count(*) AS polls,
               max(blocked) AS most_blocked, CAST(max(longest) AS BIGINT) AS longest_chain
        FROM numbered GROUP BY head, episode""", recursive=True)


def _wait_pareto(view: str, threshold: int, server: bool) -> str:
    scope = "server_name" if server else "1"
    column = "server_name, " if server else ""
    return with_views([view], f"""AND loads AS (
            SELECT *, wait_time_ms - signal_wait_time_ms AS resource_ms, {scope} AS of
            FROM {view} WHERE wait_type NOT IN ({_WAITS}) AND waiting_tasks_count > 0),
        totals AS (SELECT of, sum(wait_time_ms) AS total FROM loads GROUP BY of),
        heavier AS (
            SELECT a.of, a.wait_type, sum(b.wait_time_ms) AS before
            FROM loads a JOIN loads b ON a.of = b.of
                 AND (b.wait_time_ms > a.wait_time_ms OR (b.wait_time_ms = a.wait_time_ms AND b.wait_type < a.wait_type))
            GROUP BY a.of, a.wait_type)
        SELECT {column}wait_type, {half_up('wait_time_ms', '1000', 16, 2)} AS wait_s,
               {half_up('resource_ms', '1000', 16, 2)} AS resource_s, {half_up('signal_wait_time_ms', '1000', 16, 2)} AS signal_s,
               waiting_tasks_count AS wait_count, {half_up('wait_time_ms * 100', 'total', 5, 2)} AS percentage,
               {half_up('wait_time_ms', 'waiting_tasks_count * 1000', 16, 4)} AS avg_wait_s,
               {half_up('resource_ms', 'waiting_tasks_count * 1000', 16, 4)} AS avg_res_s,
               {half_up('signal_wait_time_ms', 'waiting_tasks_count * 1000', 16, 4)} AS avg_sig_s,
               concat('{WAIT_HELP_PREFIX}', wait_type) AS help_url
        FROM loads JOIN totals USING (of) LEFT JOIN heavier USING (of, wait_type)
        WHERE coalesce(before, 0) * 100 < total * {threshold}""")


_MEASURES = """creation_time, r.last_execution_time, r.execution_count, r.total_worker_time, r.last_worker_time, r.total_logical_reads,
    r.last_logical_reads, r.total_elapsed_time, r.last_elapsed_time, r.total_rows, r.last_rows, r.total_grant_kb, r.last_grant_kb,
    r.total_used_grant_kb, r.last_used_grant_kb, r.total_ideal_grant_kb, r.last_ideal_grant_kb"""


def _procedures(condition: str) -> str:
    return with_views(["procedure_stats", "query_stats", "query_plan", "object_names"], f"""AND called AS (
            SELECT plan_handle, execution_count AS procedure_executes, database_id, name AS procedure_name
            FROM procedure_stats LEFT JOIN object_names USING (database_id, object_id))
        SELECT procedure_name, procedure_executes, plan_generation_num AS version_of_plan, execution_count AS executions_of_current_plan, query_plan
        FROM query_stats JOIN called USING (plan_handle) JOIN query_plan USING (plan_handle) WHERE {condition}""")


def _top_queries() -> str:
    keys = "sql_handle, plan_handle, statement_start_offset, statement_end_offset"
    measures = {
        "TotalCPU": "total_worker_time", "AvgCPU": "total_worker_time // execution_count",
        "TotalIO": "total_logical_reads", "AVGIO": "total_logical_reads // execution_count",
    }
    numbers = ", ".join(f"row_number() OVER (ORDER BY {m} DESC, {keys}) AS {name}" for name, m in measures.items())
    return with_views(["query_stats", "sql_text", "query_plan", "databases", "object_names"], f"""AND numbered AS (
            SELECT *, {numbers} FROM query_stats WHERE last_execution_time > TIMESTAMP '{SINCE}' AND execution_count > 25),
        r AS (
            SELECT * REPLACE (CAST(row_no AS INTEGER) AS row_no)
            FROM (UNPIVOT numbered ON {", ".join(measures)} INTO NAME report_name VALUE row_no) WHERE row_no <= 20)
        SELECT row_no, report_name, creation_time, last_execution_time, execution_count, total_worker_time,
               total_worker_time // execution_count AS avg_worker_time, last_worker_time, total_logical_reads,
               total_logical_reads // execution_count AS avg_logical_reads,
               last_logical_reads // execution_count AS last_reads_per_execution, last_logical_reads,
               total_elapsed_time, last_elapsed_time, total_rows, last_rows, total_grant_kb, last_grant_kb,
               total_used_grant_kb, last_used_grant_kb, total_ideal_grant_kb, last_ideal_grant_kb,
               d.database_id, d.name AS database_name, t.objectid, coalesce(o.name, '') AS object_name,
               {cut_statement('exclusive')} AS sql_statement, query_plan
        FROM r JOIN query_plan USING (plan_handle) JOIN sql_text t USING (sql_handle)
             JOIN databases d ON d.database_id = t.dbid AND d.name <> 'DB_3'
             LEFT JOIN object_names o ON o.database_id = t.dbid AND o.object_id = t.objectid""")


_TABLE_VIEWS = ["indexes", "objects", "schemas", "partitions", "allocation_units"]


def _index_sizes(condition: str) -> str:
    return f"""part_pages AS (SELECT database_name, container_id AS partition_id, sum(total_pages) AS pages FROM allocation_units GROUP BY ALL),
        index_totals AS (
            SELECT database_name, object_id, index_id, CAST(sum(rows) AS BIGINT) AS number_of_rows, {half_up('sum(pages)', '128', 36, 2)} AS total_space_mb
            FROM partitions LEFT JOIN part_pages USING (database_name, partition_id) GROUP BY database_name, object_id, index_id),
        tables_of_users AS (
            SELECT o.database_name, object_id, s.name AS schema_name, o.name AS table_name
            FROM objects o JOIN schemas s USING (database_name, schema_id)
            WHERE s.name <> 'sys' AND database_name NOT IN ({_SYSTEM}) AND {condition}),
        sized AS (
            SELECT DISTINCT database_name, schema_name, table_name, number_of_rows, total_space_mb
            FROM indexes JOIN tables_of_users USING (database_name, object_id) LEFT JOIN index_totals USING (database_name, object_id, index_id))"""


def _database_overview() -> str:
    flags = ", ".join(f"CASE WHEN {flag} THEN '{text}' ELSE '' END AS {name}" for flag, name, text in FLAG_TEXTS)
    day = "'%d/%m/%Y %H:%M:%S'"
    return with_views(["databases", "master_files", "backupset"], f"""AND files AS (
            SELECT database_id, count(*) FILTER (type_desc = 'ROWS') AS data_files, count(*) FILTER (type_desc = 'LOG') AS log_files,
                   CAST(sum(size * 8 // 1024) FILTER (type_desc = 'ROWS') AS BIGINT) AS data_mb,
                   CAST(sum(size * 8 // 1024) FILTER (type_desc = 'LOG') AS BIGINT) AS log_mb
            FROM master_files GROUP BY database_id),
        latest AS (
            SELECT upper(database_name) AS name, type, backup_start_date AS begun, backup_finish_date AS done
            FROM backupset QUALIFY row_number() OVER (PARTITION BY upper(database_name) ORDER BY backup_set_id DESC) = 1),
        told AS (
            SELECT * RENAME (name AS backed_up), concat_ws(' – ', MAP {{'D': 'Full', 'I': 'Differential', 'L': 'Transaction log'}}[type],
                                concat(abs(CAST(done AS DATE) - DATE '{AS_OF[:10]}'), ' days ago'), strftime(begun, {day}),
                                concat(strftime(done, {day}), ' (', CAST(epoch(done) - epoch(begun) AS BIGINT), ' seconds)')) AS last_backup
            FROM latest)
        SELECT database_id, name[:25] AS database_name, status[:10] AS status, state_desc, coalesce(data_files, 0) AS data_files, data_mb,
               coalesce(log_files, 0) AS log_files, log_mb, user_access_desc AS user_access, recovery_model_desc AS recovery_model,
               MAP {{80: '80 (SQL Server 2000)', 90: '90 (SQL Server 2005)', 100: '100 (SQL Server 2008)'}}[compatibility_level] AS compatibility_level,
               strftime(create_date, {day}) AS creation_date, coalesce(last_backup, '-') AS last_backup, type AS last_backup_type,
               begun AS last_backup_start, done AS last_backup_finish, page_verify_option_desc AS page_verify_option, {flags},
               name AS full_name, status AS full_status
        FROM databases LEFT JOIN files USING (database_id) LEFT JOIN told ON backed_up = upper(name)""")


_AT = f"collect_date = TIMESTAMP '{SNAPSHOT}'"


def _snapshots(query: str) -> str:
    return with_views(["tempdb_snapshots"], query)


_USAGE_VIEWS = ["index_usage", "indexes", "partition_stats", "partitions", "objects", "schemas"]
_SCRIPT_VIEWS = ["indexes", "index_columns", "all_columns", "tables", "schemas"]

_UNUSED_PARTS = f"""plain AS (
            SELECT database_name, object_id, index_id, name AS index_name FROM indexes
            WHERE type_desc = 'NONCLUSTERED' AND NOT is_primary_key AND NOT is_unique_constraint AND NOT is_unique
                  AND database_name NOT IN ({_SYSTEM})),
        named AS (
            SELECT o.database_name, object_id, s.name AS schema_name, o.name AS table_name
            FROM objects o JOIN schemas s USING (database_name, schema_id) WHERE is_user_table),
        counted AS (SELECT database_name, object_id, index_id, CAST(sum(rows) AS BIGINT) AS table_rows FROM partitions GROUP BY ALL)"""

_UNUSED = f"""SELECT database_name, schema_name, table_name, index_name, user_seeks, user_scans, user_lookups, user_updates, table_rows,
               {half_up('used_page_count', '128', 36, 3)} AS index_size_mb, last_user_scan, last_user_seek, last_user_update
        FROM plain JOIN named USING (database_name, object_id) JOIN counted USING (database_name, object_id, index_id)
             JOIN partition_stats USING (database_name, object_id, index_id) JOIN index_usage USING (database_name, object_id, index_id)
        QUALIFY row_number() OVER (PARTITION BY database_name ORDER BY last_user_seek NULLS FIRST, last_user_scan NULLS FIRST,
                                   used_page_count DESC, object_id, index_id) <= 100"""

_SCRIPT_PARTS = """lists AS (
            SELECT database_name, object_id, index_id,
                   string_agg(name, ', ' ORDER BY key_ordinal, column_id) FILTER (NOT is_included_column) AS key_columns,
                   string_agg(name, ', ' ORDER BY key_ordinal, column_id) FILTER (is_included_column) AS included_columns
            FROM index_columns JOIN all_columns USING (database_name, object_id, column_id) GROUP BY database_name, object_id, index_id),
        places AS (
            SELECT t.database_name, object_id, s.name AS schema_name, t.name AS table_name, format('[{}].[{}]', s.name, t.name) AS place
            FROM tables t JOIN schemas s USING (database_name, schema_id))"""

_SCRIPTS = """SELECT database_name, schema_name, table_name, indexes.name AS index_name, index_id, key_columns, included_columns,
               'CREATE INDEX ' || indexes.name || ' ON ' || place || ' ( ' || key_columns || ' ) '
               || coalesce(' INCLUDE ( ' || included_columns || ' )', '') AS create_statement,
               'DROP INDEX [' || replace(indexes.name, ']', ']]') || '] ON ' || place AS drop_statement
        FROM indexes JOIN places USING (database_name, object_id) LEFT JOIN lists USING (database_name, object_id, index_id)"""


ORACLES: dict[str, str] = {
    "connections_by_login": with_views(["processes", "databases"], """
        SELECT p.dbid, (SELECT d.name FROM databases d WHERE d.database_id = p.dbid) AS database_name, p.loginame, p.connections
        FROM (SELECT dbid, min(loginame) AS loginame, count(dbid) AS connections FROM processes GROUP BY dbid, lower(rtrim(loginame, ' '))) p"""),
    "connections_staged": with_views(["processes", "databases"], """
        SELECT d.name AS database_name, count(p.dbid) AS connections, min(p.loginame) AS loginame
        FROM processes p LEFT JOIN databases d ON d.database_id = p.dbid
        WHERE p.dbid > 0 AND trim(upper(p.loginame)) = 'LOGIN_3' GROUP BY p.dbid, d.name"""),
    "active_sessions": with_views(["who"], "SELECT * FROM who WHERE trim(upper(login)) = 'LOGIN_7'"),
    "counter_values": with_views(["perf_counters"], "SELECT * FROM perf_counters WHERE upper(counter_name) = 'ERROR'"),
    "session_inventory": _session_inventory("session_id <> 5 AND trim(upper(login_name)) = 'LOGIN_4'"),
    "session_inventory_of_database": _session_inventory("database_name = 'DB_7'"),
    "session_inventory_all": _session_inventory("true"),
    "top_waiting_requests": _top_waiting("session_id <> 101"),
    "top_waiting_requests_of_text_database": _top_waiting(
        "sql_handle IN (SELECT s.sql_handle FROM sql_text s JOIN databases b ON b.database_id = s.dbid WHERE b.name = 'DB_7')"
    ),
    "top_waiting_requests_blocked": _top_waiting("blocking_session_id <> 0 AND database_id = 7"),
    "activity_monitor": _activity("true"),
    "activity_monitor_head_blockers": _activity("waiter IS NOT NULL AND waits_for = 0"),
    "activity_monitor_of_database": _activity("placed.name = 'DB_7'"),
    "activity_monitor_waiting": _activity("longest.wait_type IS NOT NULL AND resource_description ILIKE '%1%'"),
    "activity_monitor_of_program": _activity(
        "last_request_start_time < TIMESTAMP '2024-01-01 00:20:00' AND program_name ILIKE 'BUILD%'"
    ),
    "workload_group_sessions": with_views(["sessions", "workload_groups"], """
        SELECT concat('Kill ', session_id) AS kill_command, session_id, login_name, host_name, group_id, name AS group_name
        FROM workload_groups JOIN sessions USING (group_id) WHERE session_id > 50 AND group_id NOT IN (1, 2)"""),
    "workload_group_counts": with_views(["sessions", "workload_groups"], """
        SELECT group_id, any_value(name) AS group_name, count(*) AS sessions
        FROM workload_groups JOIN sessions USING (group_id) WHERE session_id > 50 GROUP BY group_id"""),
    "top_cpu_requests": with_views(["requests", "sql_text"], f"""
        SELECT {_REQUEST}, {cut_statement('zero_based_bytes')} AS sql_statement
        FROM requests r JOIN sql_text t ON t.sql_handle = r.sql_handle WHERE r.session_id > 50 AND lower(r.status) = 'running'"""),
    "running_statement": with_views(["requests", "sql_text"], f"""
        SELECT r.session_id, r.request_id, r.percent_complete, r.estimated_completion_time,
               (SELECT {cut_statement('zero_based')} FROM sql_text t WHERE t.sql_handle = r.sql_handle) AS statement
        FROM requests r WHERE r.session_id = 118"""),
    "running_statements": with_views(["requests", "sql_text"], f"""
        SELECT r.session_id, r.request_id, r.percent_complete, r.estimated_completion_time, {cut_statement('zero_based')} AS statement
        FROM requests r LEFT JOIN sql_text t ON t.sql_handle = r.sql_handle"""),
    "request_progress": with_views(["requests"], f"""AND told AS (
            SELECT session_id, request_id, percent_complete, date_diff('second', start_time, TIMESTAMP '{AS_OF}') AS run,
                   estimated_completion_time // 1000 AS remaining
            FROM requests)
        SELECT session_id, request_id, percent_complete,
               format('{{}} hour(s), {{}}min, {{}} sec', run // 3600, run // 60 % 60, run % 60) AS running_time,
               format('{{}} hour(s), {{}}min, {{}} sec', remaining // 3600, remaining // 60 % 60, remaining % 60) AS est_time_to_go,
               TIMESTAMP '{AS_OF}' + to_seconds(remaining) AS est_completion_time
        FROM told"""),
    "lock_counts": with_views(["tran_locks"], "SELECT request_session_id, count(1) AS locks FROM tran_locks GROUP BY request_session_id"),
    "locked_objects": with_views(["lock_info", "processes", "objects"], """
        SELECT DISTINCT o.name AS object_name, l.req_spid, p.loginame
        FROM lock_info l JOIN processes p ON l.req_spid = p.spid JOIN objects o ON o.object_id = l.rsc_objid WHERE o.name IS NOT NULL"""),
    "replica_undo_backlog": with_views(["perf_counters"], """
        SELECT object_name, counter_name, instance_name, cntr_value FROM perf_counters
        WHERE object_name ILIKE '%Database Replica%' AND upper(counter_name) = 'ERROR' AND cntr_value <> 0"""),
    "busy_requests": with_views(["sessions", "requests", "sql_text", "query_plan", "databases"], f"""
        SELECT {_REQUEST}, p.query_plan, d.name AS database_name, t.text, s.login_name, s.host_name, s.program_name
        FROM requests r JOIN sessions s ON s.session_id = r.session_id JOIN query_plan p ON p.plan_handle = r.plan_handle
             JOIN sql_text t ON t.sql_handle = r.sql_handle LEFT JOIN databases d ON d.database_id = r.database_id
        WHERE lower(r.status) IN ('running', 'suspended') ORDER BY r.logical_reads DESC, r.session_id, r.request_id LIMIT 20"""),
    "requests_with_plan": with_views(["requests", "query_plan", "sql_text"], f"""
        SELECT {_REQUEST}, t.text, p.query_plan
        FROM requests r JOIN query_plan p ON p.plan_handle = r.plan_handle JOIN sql_text t ON t.sql_handle = r.plan_handle"""),
    "connections_by_handle": with_views(["connections"], """
        SELECT most_recent_sql_handle, count(*) AS connections FROM connections GROUP BY most_recent_sql_handle"""),
    "connection_total": with_views(["connections"], "SELECT count(*) AS connections FROM connections"),
    "blocker_of": with_views(["requests"], """
        SELECT blocking_session_id, 'Kill ' || CAST(blocking_session_id AS VARCHAR) AS kill_command
        FROM requests WHERE session_id = 118 AND blocking_session_id <> 118"""),
    "text_by_handle": with_views(["sql_text"], "SELECT * FROM sql_text WHERE sql_handle = 42"),
    "blocking_tree": _blocking_tree("    ", "|         ", "HEAD -  ", "|------  "),
    "blocking_tree_narrow": _blocking_tree(" ", "| ", "HEAD - ", "|------ "),
    "root_blockers": _root_blockers("processes"),
    "root_blockers_chains": _root_blockers("chained_processes"),
    "blocking_episodes": _blocking_episodes(),
    "blocking_tree_chains": _blocking_tree(" ", "| ", "HEAD - ", "|------ ", "chained_processes"),
    "top_waits": with_views(["wait_stats"], f"""
        SELECT * FROM wait_stats WHERE wait_type NOT IN ({_WAITS}) ORDER BY wait_time_ms DESC, wait_type LIMIT 10"""),
    "wait_pareto": _wait_pareto("wait_stats", 95, False),
    "wait_pareto_by_server": _wait_pareto("server_wait_stats", 80, True),
    "top_waits_by_server": with_views(["server_wait_stats"], f"""
        SELECT server_name, wait_type, waiting_tasks_count, wait_time_ms, max_wait_time_ms, signal_wait_time_ms
        FROM (SELECT *, row_number() OVER (PARTITION BY server_name ORDER BY wait_time_ms DESC, wait_type) AS n
              FROM server_wait_stats WHERE wait_type NOT IN ({_WAITS})) w WHERE n <= 10"""),
    "ranked_waits": with_views(["wait_stats"], f"""
        SELECT *, row_number() OVER (ORDER BY wait_time_ms DESC, wait_type) AS row_num
        FROM wait_stats WHERE wait_type NOT IN ({_WAITS}) AND waiting_tasks_count > 0"""),
    "ranked_waits_by_server": with_views(["server_wait_stats"], f"""
        SELECT *, row_number() OVER (PARTITION BY server_name ORDER BY wait_time_ms DESC, wait_type) AS row_num
        FROM server_wait_stats WHERE wait_type NOT IN ({_WAITS}) AND waiting_tasks_count > 0"""),
    "wait_type_names": with_views(["requests", "wait_map"], """AND names AS (
            SELECT map_key AS wait_type, map_value FROM wait_map WHERE name = 'wait_types')
        SELECT session_id, request_id, wait_type, last_wait_type, wait_time, map_value,
               if(map_value IN ('UNKNOWN', last_wait_type), last_wait_type, map_value) AS wait_type_name
        FROM requests LEFT JOIN names USING (wait_type)"""),
    "statements_matching": with_views(["query_stats", "sql_text"], f"""
        SELECT {cut_statement('zero_based')} AS statement, r.sql_handle, r.plan_handle, r.statement_start_offset, r.statement_end_offset,
               r.{_MEASURES}, t.dbid, t.objectid, t.text
        FROM query_stats r JOIN sql_text t ON t.sql_handle = r.sql_handle WHERE t.text ILIKE '%The th%'"""),
    "cached_statements_with_plan": with_views(["query_stats", "sql_text", "statement_plan"], f"""
        SELECT r.sql_handle, r.plan_handle, r.statement_start_offset, r.statement_end_offset, {cut_statement('inclusive')} AS statement, p.query_plan
        FROM query_stats r JOIN sql_text t ON t.sql_handle = r.sql_handle
             JOIN statement_plan p ON p.plan_handle = r.plan_handle AND p.statement_start_offset = r.statement_start_offset
                  AND p.statement_end_offset = r.statement_end_offset"""),
    "procedure_plans": _procedures("true"),
    "procedure_plans_of_database": _procedures("database_id = 12"),
    "query_averages": with_views(["query_stats", "sql_text"], """
        SELECT r.sql_handle, r.plan_handle, r.statement_start_offset, r.statement_end_offset, r.total_logical_reads, r.total_worker_time,
               r.execution_count, r.total_logical_reads // r.execution_count AS avg_reads,
               r.total_worker_time // r.execution_count AS avg_cpu
        FROM query_stats r WHERE r.sql_handle IN (SELECT t.sql_handle FROM sql_text t)"""),
    "ranked_statements": with_views(["query_stats"], f"""
        SELECT sql_handle, plan_handle, statement_start_offset, statement_end_offset, execution_count, total_worker_time,
               row_number() OVER (ORDER BY total_worker_time DESC, sql_handle, plan_handle, statement_start_offset, statement_end_offset) AS row_no
        FROM query_stats WHERE last_execution_time > TIMESTAMP '{SINCE}' AND execution_count > 5"""),
    "top_queries": _top_queries(),
    "heap_tables": with_views(_TABLE_VIEWS, f"""AND {_index_sizes('o.is_user_table AND NOT o.has_clustered_index')}
        SELECT * EXCLUDE (n) FROM (
            SELECT *, row_number() OVER (PARTITION BY database_name ORDER BY number_of_rows DESC, schema_name, table_name) AS n FROM (
                SELECT database_name, schema_name, table_name, max(number_of_rows) AS number_of_rows, sum(total_space_mb) AS total_space_mb,
                       '[' || schema_name || '].[' || table_name || ']' AS schema_and_table
                FROM sized WHERE number_of_rows > 10 GROUP BY database_name, schema_name, table_name)) WHERE n <= 200"""),
    "table_sizes": with_views(_TABLE_VIEWS, f"""AND {_index_sizes('o.is_user_table')}
        SELECT database_name, schema_name, table_name, max(number_of_rows) AS number_of_rows, sum(total_space_mb) AS total_space_mb,
               '[' || schema_name || '].[' || table_name || ']' AS schema_and_table
        FROM sized GROUP BY database_name, schema_name, table_name"""),
    "database_sizes": with_views(["databases", "master_files"], f"""
        SELECT d.name, {half_up('sum(size) FILTER (type = 0)', '131072', 20, 6)} AS data_file_size_gb,
               {half_up('sum(size) FILTER (type = 1)', '131072', 20, 6)} AS log_file_size_gb
        FROM databases d LEFT JOIN master_files USING (database_id) GROUP BY database_id, d.name"""),
    "volume_free_space": with_views(["master_files", "volumes"], f"""
        SELECT machine_name, coalesce(instance_name, '{DEFAULT_INSTANCE}') AS instance_name, volume_mount_point AS volume_letter, logical_volume_name AS volume_label, total_bytes // 1073741824 AS volume_capacity_gb,
               available_bytes // 1073741824 AS volume_free_space_gb, {half_up('available_bytes * 100', 'total_bytes', 5, 2)} AS percentage_free_space
        FROM volumes SEMI JOIN master_files USING (database_id, file_id) GROUP BY ALL"""),
    "drive_space": with_views(["drives"], """
        SELECT server_name, drive_letter, label, free_space AS free_space_mb, total_space - free_space AS used_space_mb,
               total_space AS total_space_mb,
               CAST(CAST(CAST(free_space AS HUGEINT) * 10000000000 // total_space AS DECIMAL(20,0)) * 0.00000001 AS DECIMAL(22,10)) AS percentage_free
        FROM drives"""),
    "file_space": _file_space("true"),
    "file_space_of_path": _file_space("upper(physical_name) LIKE 'D:/%'"),
    "file_space_usage": with_views(["database_files"], f"""
        SELECT database_id, file_id, {half_up('space_used_pages', '128', 18, 2)} AS space_used_mb,
               {half_up('(10000 * size - 12800 * ((200 * space_used_pages + 128) // 256))', '100 * size', 18, 2)} AS free_space_perc
        FROM database_files"""),
    "read_table": "SELECT * FROM orders",
    "newest_rows": "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000",
    "job_names": with_views(["jobs"], "SELECT * FROM jobs"),
    "append_permission": with_views(["truncate_permission"], "SELECT * FROM truncate_permission"),
    "unused_indexes": with_views(_USAGE_VIEWS, f"AND {_UNUSED_PARTS} {_UNUSED}"),
    "index_scripts": with_views(_SCRIPT_VIEWS, f"AND {_SCRIPT_PARTS} {_SCRIPTS}"),
    "unused_index_scripts": with_views(
        [*_USAGE_VIEWS, *(v for v in _SCRIPT_VIEWS if v not in _USAGE_VIEWS)],
        f"""AND {_UNUSED_PARTS}, {_SCRIPT_PARTS}, unused AS ({_UNUSED}), scripts AS ({_SCRIPTS})
        SELECT u.*, s.key_columns, s.included_columns, s.create_statement, s.drop_statement
        FROM unused u LEFT JOIN scripts s USING (database_name, schema_name, table_name, index_name)""",
    ),
    "last_backup_history": with_views(["backupset"], """
        SELECT min(database_name) AS database_name, max(backup_finish_date) FILTER (type = 'D') AS last_full_backup,
               max(backup_finish_date) FILTER (type = 'I') AS last_differential, max(backup_finish_date) FILTER (type = 'L') AS last_log
        FROM backupset GROUP BY upper(database_name)"""),
    "database_overview": _database_overview(),
    "temp_table_names": with_views(["temp_tables"], "SELECT name FROM temp_tables"),
    "temp_table_prefixes": with_views(["temp_tables"], """
        SELECT left(name, greatest(strpos(name, '__') - 1, 0)) AS table_name, count(1) AS tables
        FROM temp_tables WHERE length(rtrim(name, ' ')) > 9 GROUP BY 1"""),
    "temp_table_count": with_views(["temp_tables"], "SELECT count(1) AS tables FROM temp_tables WHERE length(rtrim(name, ' ')) > 9"),
    "top_session_space": with_views(["session_space"], """
        SELECT * FROM session_space
        ORDER BY user_objects_alloc_page_count + internal_objects_alloc_page_count DESC, session_id LIMIT 5"""),
    "space_summary": with_views(["file_space"], """
        SELECT CAST(sum(user_object_reserved_page_count) * 8 AS BIGINT) AS user_objects_kb,
               CAST(sum(internal_object_reserved_page_count) * 8 AS BIGINT) AS internal_objects_kb,
               CAST(sum(version_store_reserved_page_count) * 8 AS BIGINT) AS version_store_kb,
               CAST(sum(unallocated_extent_page_count) * 8 AS BIGINT) AS freespace_kb
        FROM file_space WHERE database_id = 2"""),
    "task_space_sample": with_views(["task_space"], "SELECT * FROM task_space ORDER BY session_id, task_address LIMIT 100"),
    "snapshot_query_counts": _snapshots(f"""
        SELECT left(query_text, 100) AS query_text, count(1) AS row_count FROM tempdb_snapshots WHERE {_AT} GROUP BY 1"""),
    "snapshot_text_counts": _snapshots(f"""
        SELECT query_text, count(1) AS row_count FROM tempdb_snapshots WHERE {_AT} GROUP BY query_text"""),
    "snapshot_query_pages": _snapshots(f"SELECT query_text, internal_pages + user_pages AS pages FROM tempdb_snapshots WHERE {_AT}"),
    "snapshot_top_offenders": _snapshots(f"""AND heavy AS (
            SELECT left(query_text, 100) AS query_prefix, CAST(sum(internal_pages + user_pages) AS BIGINT) AS page_count
            FROM tempdb_snapshots WHERE {_AT} GROUP BY ALL ORDER BY page_count DESC, query_prefix LIMIT 10),
        detail AS (SELECT *, left(query_text, 100) AS query_prefix FROM tempdb_snapshots WHERE {_AT})
        SELECT collect_date, query_text, internal_pages, user_pages, query_prefix, page_count
        FROM heavy LEFT JOIN detail USING (query_prefix)"""),
    "snapshot_timeline": _snapshots("""
        SELECT collect_date, count(1) AS row_count FROM tempdb_snapshots
        WHERE collect_date > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '168' HOUR GROUP BY collect_date"""),
}
ORACLES["drive_space_from_bytes"] = ORACLES["drive_space"]
ORACLES["running_statements_stored"] = ORACLES["running_statements"]
ORACLES["requests_with_plan_stored"] = ORACLES["requests_with_plan"]
ORACLES["cached_statements_stored"] = ORACLES["cached_statements_with_plan"]
ORACLES["statements_matching_indexed"] = ORACLES["statements_matching"]
