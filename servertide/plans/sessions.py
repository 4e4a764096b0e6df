"""Connections, sessions, requests, locks and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servertide.functions.numbers import div
from servertide.functions.text import fold, key_of, kill_text, name_key, statement_slice
from servertide.functions.times import duration_text, instant, plus_seconds, seconds_between
from servertide.functions.xml_type import well_formed_xml
from servertide.operators.lookup import attach, found_for, lookup_join
from servertide.operators.ranking import top_k
from servertide.operators.repeat import repeat_rows
from servertide.operators.scratch import written

# Ids up to this one belong to the server itself.
LAST_SYSTEM_SESSION = 50


def database_names(databases: DataFrame, scope: Sequence[str] = (), key: str = "database_id", name: str = "database_name") -> DataFrame:
    return databases.select(*scope, F.col("database_id").alias(key), F.col("name").alias(name))


def _databases_named(databases: DataFrame, database: str, scope: Sequence[str], key: str) -> DataFrame:
    """Ids of the databases of a name."""
    return databases.where(key_of(databases, "name") == name_key(database)).select(*scope, F.col("database_id").alias(key))


def object_names(objects: DataFrame, scope: Sequence[str] = (), database: str = "dbid", key: str = "objectid") -> DataFrame:
    return objects.select(
        *scope, F.col("database_id").alias(database), F.col("object_id").alias(key), F.col("name").alias("object_name")
    )


def _login_counts(processes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Connections of each database and login; spellings of one login count together, under the first of them."""
    keyed = processes.withColumn("login_key", key_of(processes, "loginame"))
    return keyed.groupBy(*scope, "dbid", "login_key").agg(F.count("dbid").alias("connections"), F.min("loginame").alias("loginame"))


def connections_by_login(processes: DataFrame, databases: DataFrame, login: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Connections per database and login; processes without a database count as 0."""
    rows = processes if login is None else processes.where(key_of(processes, "loginame") == name_key(login))
    named = _login_counts(rows, scope).join(database_names(databases, scope, "dbid"), [*scope, "dbid"], "left")
    return named.orderBy(*scope, name_key(F.col("database_name")), "dbid", "login_key").select(
        *scope, "dbid", "database_name", "loginame", "connections"
    )


def connections_staged(processes: DataFrame, databases: DataFrame, login: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Connections per real database and login, narrowed to one login afterwards."""
    counts = _login_counts(processes.where(F.col("dbid") > 0), scope).join(database_names(databases, scope, "dbid"), [*scope, "dbid"], "left")
    if login is not None:
        counts = counts.where(F.col("login_key") == name_key(login))
    return counts.select(*scope, "database_name", "connections", "loginame")


def active_sessions(who: DataFrame, login: str | None = None, database: str | None = None) -> DataFrame:
    """The captured list of active sessions, all columns text."""
    rows = who
    if login is not None:
        rows = rows.where(key_of(who, "login") == name_key(login))
    if database is not None:
        rows = rows.where(key_of(who, "db_name") == name_key(database))
    return rows


def counter_values(perf_counters: DataFrame, counter: str) -> DataFrame:
    return perf_counters.where(key_of(perf_counters, "counter_name") == name_key(counter))


def replica_undo_backlog(perf_counters: DataFrame, counter: str = "Log remaining for undo", object_like: str = "%Database Replica%") -> DataFrame:
    """Replicas that still have log to undo."""
    return perf_counters.where(
        F.col("object_name").ilike(object_like) & (key_of(perf_counters, "counter_name") == name_key(counter)) & (F.col("cntr_value") != 0)
    ).select("object_name", "counter_name", "instance_name", "cntr_value")


def session_inventory(
    sessions: DataFrame, connections: DataFrame, sql_text: DataFrame, databases: DataFrame, objects: DataFrame,
    login: str | None = None, self_id: int | None = None, database: str | None = None, scope: Sequence[str] = (),
) -> DataFrame:
    """Sessions with their connection and the batch it ran last, latest request first."""
    scope = list(scope)
    mine = sessions
    if login is not None:
        mine = mine.where(key_of(sessions, "login_name") == name_key(login))
    if self_id is not None:
        mine = mine.where(F.col("session_id") != self_id)
    of_session = [
        "session_id", "login_time", "last_request_start_time", "last_request_end_time", "is_user_process", "host_name",
        "program_name", "login_name", "status", "reads", "logical_reads", "writes", "client_interface_name",
        "nt_domain", "nt_user_name",
    ]
    of_connection = ["num_reads", "num_writes", "last_read", "last_write", "client_net_address", "local_net_address"]
    linked = connections.select(*scope, "session_id", F.col("most_recent_sql_handle").alias("sql_handle"), *of_connection)
    batch = lookup_join(
        linked.join(mine.select(*scope, *of_session), [*scope, "session_id"]),
        sql_text.select(*scope, "sql_handle", "dbid", "objectid", "text"), [*scope, "sql_handle"],
    )
    named = (
        batch.join(database_names(databases, scope, "dbid"), [*scope, "dbid"], "left")
        .join(object_names(objects, scope), [*scope, "dbid", "objectid"], "left")
    )
    if database is not None:
        named = named.where(name_key(F.col("database_name")) == name_key(database))
    return (
        named.orderBy(F.col("last_request_start_time").desc(), *scope, "session_id")
        .select(
            *scope, *of_session, *of_connection, "database_name", "object_name",
            F.coalesce("text", F.lit("")).alias("query"), kill_text(F.col("session_id")).alias("kill_command"),
        )
    )


def top_waiting_requests(
    requests: DataFrame, sql_text: DataFrame, query_plan: DataFrame, statement_plan: DataFrame, databases: DataFrame,
    objects: DataFrame, k: int = 20, self_id: int | None = None, session_ids: Sequence[int] | None = None,
    blocked_only: bool = False, blocking_session_id: int | None = None, request_database_id: int | None = None,
    text_database: str | None = None, sessions: DataFrame | None = None, program_like: str | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Requests that wait longest, with batch, running statement and both forms of the plan.

    Texts and plans are looked up for the k rows only. ``program_like`` needs
    ``sessions``.
    """
    scope = list(scope)
    handle, plan = [*scope, "sql_handle"], [*scope, "plan_handle"]
    offsets = ["statement_start_offset", "statement_end_offset"]
    rows = requests.select(*scope, *_REQUEST).where((fold(F.col("status")) != "background") & (fold(F.col("command")) != "task manager"))
    if self_id is not None:
        rows = rows.where(F.col("session_id") != self_id)
    if session_ids is not None:
        rows = rows.where(F.col("session_id").isin(*session_ids))
    if blocked_only:
        rows = rows.where(F.col("blocking_session_id") != 0)
    if blocking_session_id is not None:
        rows = rows.where(F.col("blocking_session_id") == blocking_session_id)
    if request_database_id is not None:
        rows = rows.where(F.col("database_id") == request_database_id)
    if program_like is not None:
        of_program = sessions.where(F.col("program_name").ilike(program_like)).select(*scope, "session_id")
        rows = rows.join(of_program, [*scope, "session_id"], "left_semi")
    if text_database is not None:
        ids = _databases_named(databases, text_database, scope, "dbid")
        of_database = sql_text.select(*handle, "dbid").join(ids, [*scope, "dbid"], "left_semi").select(*handle)
        rows = lookup_join(rows, of_database, handle, "left_semi")

    order = [F.col("wait_time").desc(), F.col("session_id"), F.col("request_id")]
    # Written, because three outer lookups start from it.
    top = written(top_k(rows, k, order, scope), "top")
    texts = sql_text.select(*handle, "dbid", "objectid", "text")
    statement_plans = statement_plan.select(*plan, *offsets, F.col("query_plan").alias("statement_plan"))
    full = top
    for lookup, key in [
        (texts, handle), (query_plan.select(*plan, "query_plan"), plan), (statement_plans, [*plan, *offsets]),
    ]:
        full = full.join(found_for(top, lookup, key), key, "left")
    named = (
        full.join(database_names(databases, scope, "dbid"), [*scope, "dbid"], "left")
        .join(object_names(objects, scope), [*scope, "dbid", "objectid"], "left")
    )
    return named.orderBy(*scope, *order).select(
        *scope, "database_name", "object_name", *_REQUEST, F.col("text").alias("sql_text"),
        statement_slice(F.col("text"), *[F.col(c) for c in offsets], "inclusive").alias("sql_statement"),
        "query_plan", "statement_plan", well_formed_xml(F.col("statement_plan")).alias("statement_plan_xml"),
    )


# Sort key and whether it descends.
ACTIVITY_ORDERS = {
    "oldest": ("last_request_start_time", False),
    "cpu": ("total_cpu_ms", True),
    "wait": ("wait_time_ms", True),
}


def activity_monitor(
    sessions: DataFrame, connections: DataFrame, requests: DataFrame, tasks: DataFrame, waiting_tasks: DataFrame,
    workload_groups: DataFrame, processes: DataFrame, databases: DataFrame, started_before=None,
    host_like: str | None = None, login: str | None = None, program_like: str | None = None,
    session_id: int | None = None, database_id: int | None = None, database: str | None = None, wait_type: str | None = None,
    waiting_only: bool = False, resource_like: str | None = None, head_blockers_only: bool = False,
    sort: str = "oldest", wait_key: str = "waiting_task_id", scope: Sequence[str] = (),
) -> DataFrame:
    """Sessions with a live task: what they run, wait for, and whether they head a chain of blocking.

    A session that blocks n requests appears n times for each of its tasks, like in the
    join this report stands for; the blocked requests are counted first, so a session
    that blocks very many does not have to meet them in one task. ``wait_key`` decides
    between equally long waits of a task.
    """
    scope = list(scope)
    session = [*scope, "session_id"]
    users = sessions.where(F.col("session_id") > LAST_SYSTEM_SESSION)
    if started_before is not None:
        users = users.where(F.col("last_request_start_time") < instant(started_before))
    if host_like is not None:
        users = users.where(F.col("host_name").ilike(host_like))
    if login is not None:
        users = users.where(key_of(sessions, "login_name") == name_key(login))
    if program_like is not None:
        users = users.where(F.col("program_name").ilike(program_like))
    if session_id is not None:
        users = users.where(F.col("session_id") == session_id)
    groups = workload_groups.where(fold(F.col("name")) != "internal").select(
        *scope, "group_id", F.col("name").alias("workload_group")
    )
    live = tasks.where(fold(F.col("task_state")).isin("runnable", "running", "suspended")).select(
        *session, "request_id", "task_state", "task_address", "exec_context_id"
    )
    running = requests.select(
        *session, "request_id", "command", F.col("blocking_session_id").alias("request_blocked_by"), "open_transaction_count"
    )
    longest = top_k(
        waiting_tasks.where(F.col("waiting_task_address").isNotNull()).select(
            *scope, F.col("waiting_task_address").alias("task_address"), "wait_duration_ms", "wait_type",
            "resource_description", "blocking_session_id", F.col(wait_key).alias("wait_key"),
        ),
        1, [F.col("wait_duration_ms").desc(), F.col("wait_key")], [*scope, "task_address"],
    ).drop("wait_key")
    blocked = (
        requests.where(F.col("blocking_session_id").isNotNull())
        .groupBy(*scope, F.col("blocking_session_id").alias("session_id")).agg(F.count("*").alias("blocked_requests"))
    )
    of_process = processes.select(*scope, F.col("spid").alias("session_id"), F.col("dbid").alias("database_id"))

    rows = (
        users.join(connections.select(*session, "client_net_address"), session, "left")
        .join(of_process, session, "left")
        .join(blocked, session, "left")
        .join(running, session)
        .join(live, [*session, "request_id"])
        .join(groups, [*scope, "group_id"])
        .join(longest, [*scope, "task_address"], "left")
        .join(database_names(databases, scope), [*scope, "database_id"], "left")
    )
    head = F.col("blocked_requests").isNotNull() & (F.col("request_blocked_by") == 0)
    if database_id is not None:
        rows = rows.where(F.col("database_id") == database_id)
    if database is not None:
        rows = rows.where(name_key(F.col("database_name")) == name_key(database))
    if wait_type is not None:
        rows = rows.where(F.col("wait_type") == wait_type)
    if waiting_only:
        rows = rows.where(F.col("wait_type").isNotNull())
    if resource_like is not None:
        rows = rows.where(F.col("resource_description").ilike(resource_like))
    if head_blockers_only:
        rows = rows.where(head)

    def or_empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    by, descending = ACTIVITY_ORDERS[sort]
    first = F.col(by).desc() if descending else F.col(by).asc()
    shown = rows.select(
        *scope, kill_text(F.col("session_id")).alias("kill_command"), "session_id",
        F.col("is_user_process").cast("int").cast("string").alias("user_process"),
        F.col("login_name").alias("login"), or_empty("database_name").alias("database"),
        or_empty("task_state").alias("task_state"), or_empty("command").alias("command"),
        or_empty("program_name").alias("application"),
        F.coalesce("wait_duration_ms", F.lit(0)).cast("long").alias("wait_time_ms"), or_empty("wait_type").alias("wait_type"),
        or_empty("resource_description").alias("wait_resource"),
        F.coalesce(F.col("blocking_session_id").cast("string"), F.lit("")).alias("blocked_by"),
        F.when(head, "1").otherwise("").alias("head_blocker"),
        F.col("cpu_time").alias("total_cpu_ms"),
        div((F.col("reads") + F.col("writes")).cast("long") * 8, 1024).alias("total_physical_io_mb"),
        div(F.col("memory_usage").cast("long") * 8192, 1024).alias("memory_use_kb"),
        F.coalesce("open_transaction_count", F.lit(0)).cast("long").alias("open_transactions"),
        "login_time", "last_request_start_time", or_empty("host_name").alias("host_name"),
        or_empty("client_net_address").alias("net_address"), F.coalesce("exec_context_id", F.lit(0)).cast("long").alias("execution_context_id"),
        F.col("request_id").cast("long").alias("request_id"), "workload_group",
        "task_address", "blocked_requests",
    )
    return (
        repeat_rows(shown, F.coalesce(F.col("blocked_requests"), F.lit(1)), [*session, "task_address"])
        .orderBy(first, *session, "task_address", "__copy")
        .drop("task_address", "blocked_requests", "__copy")
    )


def workload_group_sessions(sessions: DataFrame, workload_groups: DataFrame, exclude: Sequence[int] = (1, 2), scope: Sequence[str] = ()) -> DataFrame:
    """User sessions outside the built-in workload groups."""
    users = sessions.where((F.col("session_id") > LAST_SYSTEM_SESSION) & ~F.col("group_id").isin(*exclude))
    return users.select(*scope, "session_id", "login_name", "host_name", "group_id").join(
        workload_groups.select(*scope, "group_id", F.col("name").alias("group_name")), [*scope, "group_id"]
    ).select(
        *scope, kill_text(F.col("session_id")).alias("kill_command"), "session_id", "login_name", "host_name", "group_id", "group_name"
    )


def workload_group_counts(sessions: DataFrame, workload_groups: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """User sessions per workload group; sessions are counted before names are joined."""
    counts = (
        sessions.where(F.col("session_id") > LAST_SYSTEM_SESSION)
        .groupBy(*scope, "group_id").agg(F.count("group_id").alias("sessions"))
    )
    return counts.join(
        workload_groups.select(*scope, "group_id", F.col("name").alias("group_name")), [*scope, "group_id"]
    ).select(*scope, "group_id", "group_name", "sessions")


# Every column of a request.
_REQUEST = [
    "session_id", "request_id", "status", "command", "wait_time", "wait_type", "last_wait_type", "wait_resource", "blocking_session_id",
    "cpu_time", "logical_reads", "database_id", "percent_complete", "start_time", "estimated_completion_time",
    "open_transaction_count", "statement_start_offset", "statement_end_offset", "sql_handle", "plan_handle",
]


def top_cpu_requests(requests: DataFrame, sql_text: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Running requests of user sessions with their statement, by CPU time."""
    scope = list(scope)
    running = requests.where((F.col("session_id") > LAST_SYSTEM_SESSION) & (fold(F.col("status")) == "running")).select(
        *scope, *_REQUEST
    )
    batch = lookup_join(running, sql_text.select(*scope, "sql_handle", "text"), [*scope, "sql_handle"])
    statement = statement_slice(F.col("text"), F.col("statement_start_offset"), F.col("statement_end_offset"), "zero_based_bytes")
    # Cut first, so that statements are sorted and not whole batches.
    return batch.select(*scope, *_REQUEST, statement.alias("sql_statement")).orderBy(
        F.col("cpu_time").desc(), *scope, "session_id", "request_id"
    )


def running_statement(requests: DataFrame, sql_text: DataFrame, session_id: int | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Progress and current statement of one session (or of all)."""
    scope = list(scope)
    rows = requests if session_id is None else requests.where(F.col("session_id") == session_id)
    rows = rows.select(
        *scope, "session_id", "request_id", "percent_complete", "estimated_completion_time", "sql_handle",
        "statement_start_offset", "statement_end_offset",
    )
    batch = lookup_join(rows, sql_text.select(*scope, "sql_handle", "text"), [*scope, "sql_handle"], "left")
    statement = statement_slice(F.col("text"), F.col("statement_start_offset"), F.col("statement_end_offset"), "zero_based")
    return batch.select(
        *scope, "session_id", "request_id", "percent_complete", "estimated_completion_time", statement.alias("statement")
    )


def request_progress(requests: DataFrame, as_of, scope: Sequence[str] = ()) -> DataFrame:
    """How long requests have run, how long they still need, and when they should end."""
    now = instant(as_of)
    left_s = div(F.col("estimated_completion_time"), 1000)
    return requests.select(
        *scope, "session_id", "request_id", "percent_complete",
        duration_text(seconds_between(F.col("start_time"), now)).alias("running_time"),
        duration_text(left_s).alias("est_time_to_go"),
        plus_seconds(now, left_s).alias("est_completion_time"),
    )


def lock_counts(tran_locks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Locks per session, most first."""
    counts = tran_locks.groupBy(*scope, "request_session_id").agg(F.count("*").alias("locks"))
    return counts.orderBy(F.col("locks").desc(), *scope, "request_session_id")


def locked_objects(lock_info: DataFrame, processes: DataFrame, objects: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Objects on which sessions hold locks; equal locks are merged before any join."""
    scope = list(scope)
    locks = lock_info.select(*scope, "rsc_objid", F.col("req_spid").alias("spid"))
    names = objects.where(F.col("name").isNotNull()).select(
        *scope, F.col("object_id").alias("rsc_objid"), F.col("name").alias("object_name")
    ).distinct()
    logins = processes.select(*scope, "spid", "loginame").distinct()
    named = lookup_join(locks.distinct(), names, [*scope, "rsc_objid"])
    return (
        lookup_join(named, logins, [*scope, "spid"])
        .select(*scope, "object_name", F.col("spid").alias("req_spid"), "loginame").distinct()
    )


def busy_requests(
    sessions: DataFrame, requests: DataFrame, sql_text: DataFrame, query_plan: DataFrame, databases: DataFrame,
    k: int = 20, scope: Sequence[str] = (),
) -> DataFrame:
    """Running or suspended requests with the most logical reads, with batch and plan.

    Only requests whose batch and plan are known count; that is checked on the handles
    alone, and the texts are fetched for the k rows.
    """
    scope = list(scope)
    handle, plan = [*scope, "sql_handle"], [*scope, "plan_handle"]
    rows = requests.where(fold(F.col("status")).isin("running", "suspended")).select(*scope, *_REQUEST)
    known = lookup_join(rows, sql_text.select(*handle), handle, "left_semi")
    known = lookup_join(known, query_plan.select(*plan), plan, "left_semi")
    order = [F.col("logical_reads").desc(), F.col("session_id"), F.col("request_id")]
    of_session = sessions.select(*scope, "session_id", "login_name", "host_name", "program_name")
    top = top_k(known.join(of_session, [*scope, "session_id"]), k, order, scope)
    full = attach(top, sql_text.select(*handle, "text"), handle)
    full = attach(full, query_plan.select(*plan, "query_plan"), plan)
    return (
        full.join(database_names(databases, scope), [*scope, "database_id"], "left")
        .orderBy(*scope, *order)
        .select(
            *scope, "query_plan", "database_name", "text", *_REQUEST, "login_name", "host_name", "program_name",
        )
    )


def requests_with_plan(
    requests: DataFrame, query_plan: DataFrame, sql_text: DataFrame, text_key: str = "plan_handle", scope: Sequence[str] = (),
) -> DataFrame:
    """Requests with plan and batch; ``text_key`` is the request's handle that names the batch."""
    scope = list(scope)
    rows = requests.select(*scope, *_REQUEST)
    texts = sql_text.select(*scope, F.col("sql_handle").alias(text_key), "text")
    planned = lookup_join(rows, query_plan.select(*scope, "plan_handle", "query_plan"), [*scope, "plan_handle"])
    return lookup_join(planned, texts, [*scope, text_key]).select(*scope, *_REQUEST, "text", "query_plan")


def connections_by_handle(connections: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Connections per batch they ran last, most first."""
    counts = connections.groupBy(*scope, "most_recent_sql_handle").agg(F.count("*").alias("connections"))
    return counts.orderBy(F.col("connections").desc(), *scope, "most_recent_sql_handle")


def connection_total(connections: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """All connections, as the sum over the batches they ran last."""
    per_handle = connections.groupBy(*scope, "most_recent_sql_handle").agg(F.count("*").alias("connections"))
    return per_handle.groupBy(*scope).agg(F.sum("connections").alias("connections"))


def blocker_of(requests: DataFrame, session_id: int, scope: Sequence[str] = ()) -> DataFrame:
    """The session that another one waits for right now, with the text that would end it."""
    blocker = F.col("blocking_session_id")
    return requests.where((F.col("session_id") == session_id) & (blocker != F.col("session_id"))).select(
        *scope, "blocking_session_id", kill_text(blocker).alias("kill_command")
    )


def text_by_handle(sql_text: DataFrame, handle: int | str | bytes) -> DataFrame:
    """The batch of one handle; a binary handle may be given as ``'0x…'``."""
    if isinstance(handle, str) and handle.startswith("0x"):
        handle = bytes.fromhex(handle[2:])
    return sql_text.where(F.col("sql_handle") == F.lit(handle))
