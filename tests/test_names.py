"""Names under the server's collation: compared, grouped, joined and ordered in any case, shown as they are stored."""

import pytest

from servertide.operators.scratch import scratch_path
from servertide.plans import backups, queries, sessions, storage
from servertide.sources.collected import append_collected, read_collected

SPELLINGS = ["SA", "sa", "Sa ", "other"]


@pytest.fixture()
def databases(rows):
    return rows("databases", [{"database_id": 1, "name": "Main"}, {"database_id": 2, "name": "side"}])


@pytest.fixture()
def processes(rows):
    return rows("processes", [{"spid": 60 + k, "blocked": 0, "dbid": 1, "loginame": n} for k, n in enumerate(SPELLINGS)])


def test_spellings_are_one_login(processes, databases):
    got = [(r.database_name, r.loginame, r.connections) for r in sessions.connections_by_login(processes, databases).collect()]
    assert got == [("Main", "other", 1), ("Main", "SA", 3)]
    for login in ("sA", "SA  "):
        assert [r.connections for r in sessions.connections_by_login(processes, databases, login).collect()] == [3]
        assert [tuple(r) for r in sessions.connections_staged(processes, databases, login).collect()] == [("Main", 3, "SA")]


def test_inventory_and_monitor_filter_by_any_spelling(rows, databases):
    mine = rows("sessions", [
        {"session_id": 60 + k, "login_name": n, "is_user_process": True, "group_id": 1, "reads": 0, "writes": 0, "memory_usage": 0}
        for k, n in enumerate(SPELLINGS)
    ])
    connections = rows("connections", [{"session_id": 60 + k, "most_recent_sql_handle": b"h"} for k in range(4)])
    texts = rows("sql_text", [{"sql_handle": b"h", "dbid": 1, "text": "x"}])
    shown = sessions.session_inventory(mine, connections, texts, databases, rows("object_names", []), login="sa", database="MAIN")
    assert sorted(r.login_name for r in shown.collect()) == ["SA", "Sa ", "sa"]
    monitor = sessions.activity_monitor(
        mine, connections,
        rows("requests", [{"session_id": 60 + k, "request_id": 0, "command": "SELECT", "blocking_session_id": 0} for k in range(4)]),
        rows("tasks", [{"session_id": 60 + k, "request_id": 0, "task_address": bytes([k]), "task_state": "RUNNING"} for k in range(4)]),
        rows("waiting_tasks", []), rows("workload_groups", [{"group_id": 1, "name": "default"}]),
        rows("processes", [{"spid": 60 + k, "dbid": 1} for k in range(4)]), databases, login="SA", database="main",
    )
    assert sorted(r.login for r in monitor.collect()) == ["SA", "Sa ", "sa"]


def test_databases_and_counters(rows, databases):
    sets = rows("backupset", [
        {"backup_set_id": k, "database_name": n, "type": "D", "backup_start_date": t, "backup_finish_date": t}
        for k, (n, t) in enumerate(zip(("MAIN", "main", "Side"), _times()))
    ])
    history = backups.last_backup_history(sets).collect()
    assert [(r.database_name, r.last_full_backup.day) for r in history] == [("Side", 3), ("MAIN", 2)]
    overview = backups.database_overview(databases, rows("master_files", []), sets, as_of="2024-01-05 00:00:00").collect()
    assert {r.full_name: r.last_backup_finish.day for r in overview} == {"Main": 2, "side": 3}
    counters = rows("perf_counters", [
        {"object_name": "x:Database Replica", "counter_name": n, "cntr_value": 1} for n in ("Log remaining for undo", "LOG REMAINING FOR UNDO", "Other")
    ])
    assert sessions.replica_undo_backlog(counters).count() == 2
    assert sessions.counter_values(counters, "log Remaining for undo").count() == 2


def _times():
    from datetime import datetime

    return [datetime(2024, 1, d) for d in (1, 2, 3)]


def test_filters_on_collected_keys_reach_the_scan(spark, rows, processes, databases):
    root = scratch_path(spark, "names")
    append_collected(processes, root, "processes", name_keys=["loginame"])
    table = read_collected(spark, root, "processes", name_keys=["loginame"])
    report = sessions.connections_by_login(table, databases, "Sa")
    assert [(r.loginame, r.connections) for r in report.collect()] == [("SA", 3)]
    assert "EqualTo(loginame_key,sa)" in report._jdf.queryExecution().executedPlan().toString()


def test_excluded_databases(rows):
    empty = [rows(t, []) for t in ("indexes", "objects", "schemas", "partitions", "allocation_units")]
    with pytest.raises(ValueError, match="database_name"):
        storage.table_sizes(*empty, scope=())
    assert storage.table_sizes(*empty, excluded_databases=(), scope=()).collect() == []
    table = rows("objects", [{"database_name": n} for n in ("Master ", "user", "MSDB")], "database_name")
    assert [r.database_name for r in storage.without_databases(table, storage.SYSTEM_DATABASES, ["database_name"]).collect()] == ["user"]
    ids = table.selectExpr("CASE database_name WHEN 'user' THEN 5 ELSE 1 END AS database_id")
    assert storage.without_databases(ids, storage.SYSTEM_DATABASES, ["database_id"]).count() == 1


def test_top_queries_exclude_any_spelling(rows, databases):
    stats = rows("query_stats", [{
        "sql_handle": bytes([d]), "plan_handle": b"p", "statement_start_offset": 0, "statement_end_offset": -1, "execution_count": 200,
        "last_execution_time": _times()[0], "total_worker_time": 5, "total_logical_reads": 5,
    } for d in (1, 2)])
    texts = rows("sql_text", [{"sql_handle": bytes([d]), "dbid": d, "objectid": 1, "text": "x"} for d in (1, 2)])
    plans = rows("query_plan", [{"plan_handle": b"p", "query_plan": "<p/>"}])
    found = queries.top_queries(stats, texts, plans, databases, rows("object_names", []), since="2023-01-01 00:00:00", excluded_databases=["MAIN"])
    assert {r.database_name for r in found.collect()} == {"side"}
