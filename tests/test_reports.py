"""Reports on hand-written edge rows, with the types of collected telemetry."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from servertide.operators.repeat import repeat_rows
from servertide.plans import backups, indexes, queries, sessions, storage, tempspace, waits

T0 = datetime(2024, 1, 1)


def listed(df):
    return [tuple(r) for r in df.collect()]


def bag(df):
    return sorted(listed(df), key=repr)


# waits


def wait_rows(rows, data, *scope):
    return rows("wait_stats", [
        {"wait_type": d[-3], "waiting_tasks_count": d[-1], "wait_time_ms": d[-2], "signal_wait_time_ms": d[-2] // 4, **dict(zip(scope, d))}
        for d in data
    ], *scope)


def kept(df):
    return [r.wait_type for r in df.collect()]


def test_pareto_stops_exactly_at_the_threshold(rows):
    data = [("A", 50, 1), ("B", 45, 1), ("C", 5, 1)]
    assert kept(waits.wait_pareto(wait_rows(rows, data))) == ["A", "B"]
    assert kept(waits.wait_pareto(wait_rows(rows, [("A", 50, 1), ("B", 44, 1), ("C", 6, 1)]))) == ["A", "B", "C"]


def test_pareto_edges(rows):
    assert kept(waits.wait_pareto(wait_rows(rows, [("A", 99, 1), ("B", 1, 1)]))) == ["A"]
    ties = [("C", 10, 1), ("A", 10, 1), ("B", 10, 1)]
    assert kept(waits.wait_pareto(wait_rows(rows, ties), threshold=50)) == ["A", "B"]
    unwanted = [("A", 10, 1), ("CHKPT", 900, 1), ("Z", 10, 0)]
    got = waits.wait_pareto(wait_rows(rows, unwanted)).collect()
    assert [(r.wait_type, r.percentage) for r in got] == [("A", Decimal("100.00"))]


def test_pareto_columns(rows):
    got = waits.wait_pareto(wait_rows(rows, [("A", 1005, 3), ("B", 2010, 7)]), threshold=100).collect()
    b, a = got
    assert (b.wait_s, b.signal_s, b.resource_s) == (Decimal("2.01"), Decimal("0.50"), Decimal("1.51"))
    assert (b.percentage, a.percentage) == (Decimal("66.67"), Decimal("33.33"))
    assert a.avg_wait_s == Decimal("0.3350") and a.help_url.endswith("/A")


def test_pareto_per_server_equals_each_alone(rows):
    data = [("s1", f"W{i}", i * i, 1) for i in range(1, 12)] + [("s2", f"W{i}", 100 - i, 2) for i in range(1, 12)]
    together = bag(waits.wait_pareto(wait_rows(rows, data, "server_name"), scope=["server_name"], slices=5))
    alone = [
        (s, *r) for s in ("s1", "s2") for r in listed(waits.wait_pareto(wait_rows(rows, [d[1:] for d in data if d[0] == s]), slices=3))
    ]
    assert together == sorted(alone, key=repr)


def test_top_waits(rows):
    data = [("A", 5, 1), ("B", 9, 1), ("SLEEP_TASK", 99, 1), ("C", 5, 1)]
    assert kept(waits.top_waits(wait_rows(rows, data), k=2)) == ["B", "A"]


def test_wait_names(rows):
    requests = rows("requests", [
        {"session_id": i, "wait_type": str(i), "last_wait_type": "LAST"} for i in range(1, 5)
    ])
    mapped = rows("wait_map", [
        {"name": "wait_types", "map_key": 1, "map_value": "UNKNOWN"}, {"name": "wait_types", "map_key": 2, "map_value": "LAST"},
        {"name": "wait_types", "map_key": 3, "map_value": "OTHER"}, {"name": "lock_mode", "map_key": 4, "map_value": "X"},
    ])
    names = {r.session_id: r.wait_type_name for r in waits.wait_type_names(requests, mapped).collect()}
    assert names == {1: "LAST", 2: "LAST", 3: "OTHER", 4: None}


def test_wait_names_of_texts_without_a_number(rows):
    requests = rows("requests", [{"session_id": 1, "wait_type": "PAGELATCH_UP"}, {"session_id": 2}])
    mapped = rows("wait_map", [{"name": "wait_types", "map_key": 1, "map_value": "X"}])
    assert [r.wait_type_name for r in waits.wait_type_names(requests, mapped).collect()] == [None, None]


def test_zero_sizes_leave_the_report_whole(rows):
    drives = rows("drives", [{"drive_letter": "C", "label": "a", "total_space": 100, "free_space": 25}, {"drive_letter": "D", "label": "b", "total_space": 0, "free_space": 0}])
    assert [r.percentage_free for r in storage.drive_space(drives).collect()] == [25, None]
    files = rows("database_files", [{"database_id": 1, "file_id": 1, "size": 0, "space_used_pages": 0}])
    assert listed(storage.file_space_usage(files))[0][-1] is None


def test_statement_slices_of_long_texts(rows):
    long = "x" * 200_000
    requests = rows("requests", [{"session_id": 1, "sql_handle": b"a", "statement_start_offset": 2, "statement_end_offset": -1}])
    texts = rows("sql_text", [{"sql_handle": b"a", "text": long}])
    assert sessions.running_statement(requests, texts).first().statement == long


def test_full_names_in_the_overview(rows):
    name = "n" * 40
    databases = rows("databases", [{"database_id": 1, "name": name, "status": "RECOVERY_PENDING"}])
    files, backups_ = rows("master_files", []), rows("backupset", [])
    got = backups.database_overview(databases, files, backups_, T0).first()
    assert (got.full_name, got.full_status, got.database_name, got.last_backup) == (name, "RECOVERY_PENDING", "n" * 25, "-")


def test_wait_names_by_two_byte_key(rows):
    requests = rows("requests", [{"session_id": 1}]).withColumn("wait_type", F.unhex(F.lit("0103")))
    mapped = rows("wait_map", [{"name": "wait_types", "map_key": 259, "map_value": "X"}])
    assert waits.wait_type_names(requests, mapped).first().wait_type_name == "X"


# sessions


def test_connections_by_login(rows):
    processes = rows("processes", [
        {"spid": 1, "dbid": 1, "loginame": "a"}, {"spid": 2, "dbid": 1, "loginame": "a"}, {"spid": 3, "dbid": None, "loginame": "a"},
        {"spid": 4, "dbid": 0, "loginame": "a"}, {"spid": 5, "dbid": 2, "loginame": "b"},
    ])
    databases = rows("databases", [{"database_id": 1, "name": "one"}])
    assert bag(sessions.connections_by_login(processes, databases, "a")) == sorted(
        [(None, None, "a", 0), (0, None, "a", 1), (1, "one", "a", 2)], key=repr
    )
    assert listed(sessions.connections_staged(processes, databases, "a")) == [("one", 2, "a")]


def test_longest_wait_of_a_task(rows):
    ids = range(51, 55)
    tables = dict(
        sessions=rows("sessions", [
            {"session_id": i, "group_id": 5, "is_user_process": True, "reads": 1000, "writes": 24, "memory_usage": 2, "cpu_time": i,
             "last_request_start_time": T0} for i in (*ids, 50)
        ]),
        connections=rows("connections", [{"session_id": 51}]),
        requests=rows("requests", [{"session_id": i, "request_id": 0, "blocking_session_id": 0 if i == 51 else 51} for i in (*ids, 50)]),
        tasks=rows("tasks", [
            {"session_id": i, "request_id": 0, "task_address": None if i == 54 else bytes([i]), "task_state": "running"} for i in (*ids, 50)
        ]),
        waiting_tasks=rows("waiting_tasks", [
            {"waiting_task_address": bytes([51]), "wait_duration_ms": d, "wait_type": f"w{n}", "waiting_task_id": n}
            for n, d in enumerate([5, 9, 9])
        ] + [{"waiting_task_address": None, "wait_duration_ms": 99, "wait_type": "none"}]),
        workload_groups=rows("workload_groups", [{"group_id": 5, "name": "users"}]),
        processes=rows("processes", [{"spid": 51, "dbid": 1}]),
        databases=rows("databases", [{"database_id": 1, "name": "one"}]),
    )
    got = sessions.activity_monitor(**tables).collect()
    # 51 blocks the other four requests, 50 among them.
    assert [r.session_id for r in got] == [51] * 4 + [52, 53, 54]
    head = got[0]
    assert (head.wait_time_ms, head.wait_type, head.head_blocker, head.database) == (9, "w1", "1", "one")
    assert (head.total_physical_io_mb, head.memory_use_kb, head.kill_command) == (8, 16, "Kill 51")
    assert (got[-1].wait_time_ms, got[-1].wait_type, got[-1].head_blocker) == (0, "", "")
    assert [r.session_id for r in sessions.activity_monitor(**tables, head_blockers_only=True).collect()] == [51] * 4
    assert [r.session_id for r in sessions.activity_monitor(**tables, sort="cpu").collect()] == [54, 53, 52] + [51] * 4


def test_many_copies_come_from_many_tasks(spark):
    df = spark.createDataFrame([(1, 95), (2, 1), (3, 10)], "k INT, n INT")
    got = repeat_rows(df, F.col("n"), ["k"], chunk=10)
    assert {r.k: (r["count"], r["lo"], r["hi"]) for r in got.groupBy("k").agg(
        F.count("*").alias("count"), F.min("__copy").alias("lo"), F.max("__copy").alias("hi")).collect()
    } == {1: (95, 1, 95), 2: (1, 1, 1), 3: (10, 1, 10)}
    assert got.where("k = 1").select(F.spark_partition_id()).distinct().count() > 1


@pytest.fixture()
def waiting(rows):
    requests = rows("requests", [
        {"session_id": i, "request_id": 0, "status": "suspended" if i != 3 else "Background", "command": "SELECT" if i != 4 else "Task Manager",
         "wait_time": i * 10, "blocking_session_id": 0 if i < 6 else 1, "database_id": i % 2, "sql_handle": bytes([i]),
         "plan_handle": bytes([i % 3]), "statement_start_offset": 0, "statement_end_offset": -1, "logical_reads": 100 - i, "cpu_time": i}
        for i in range(1, 9)
    ])
    texts = rows("sql_text", [{"sql_handle": bytes([i]), "dbid": 1, "objectid": 9, "text": f"text {i}"} for i in range(1, 8)])
    plans = rows("query_plan", [{"plan_handle": bytes([1]), "query_plan": "<p/>"}])
    statement_plans = rows("statement_plan", [
        {"plan_handle": bytes([1]), "statement_start_offset": 0, "statement_end_offset": -1, "query_plan": "<p>"},
        {"plan_handle": bytes([2]), "statement_start_offset": 0, "statement_end_offset": -1, "query_plan": "<p>ok</p>"},
    ])
    databases = rows("databases", [{"database_id": 1, "name": "one"}])
    names = rows("object_names", [{"database_id": 1, "object_id": 9, "name": "obj"}])
    return requests, texts, plans, statement_plans, databases, names


def test_top_waiting_requests(waiting):
    got = sessions.top_waiting_requests(*waiting, k=4, self_id=7).collect()
    assert [r.session_id for r in got] == [8, 6, 5, 2]
    eight, five = got[0], got[2]
    assert (eight.sql_text, eight.sql_statement, eight.database_name) == (None, None, None)
    assert (eight.statement_plan, eight.statement_plan_xml, eight.query_plan) == ("<p>ok</p>", "<p>ok</p>", None)
    assert (five.sql_text, five.database_name, five.object_name) == ("text 5", "one", "obj")
    seven = sessions.top_waiting_requests(*waiting, session_ids=[7]).first()
    assert (seven.query_plan, seven.statement_plan, seven.statement_plan_xml) == ("<p/>", "<p>", None)


def test_top_waiting_requests_filters(waiting, rows):
    ids = lambda **f: [r.session_id for r in sessions.top_waiting_requests(*waiting, **f).collect()]
    assert ids(blocked_only=True) == [8, 7, 6]
    assert ids(blocking_session_id=1) == [8, 7, 6]
    assert ids(request_database_id=1) == [7, 5, 1]
    assert ids(text_database="one") == [7, 6, 5, 2, 1]
    of = rows("sessions", [{"session_id": 2, "program_name": "My App"}, {"session_id": 5, "program_name": "other"}])
    assert ids(sessions=of, program_like="%app%") == [2]


def test_busy_requests_need_text_and_plan(waiting, rows):
    requests, texts, plans, _, databases, _ = waiting
    of = rows("sessions", [{"session_id": i} for i in range(1, 9)])
    got = sessions.busy_requests(of, requests, texts, plans, databases, k=2).collect()
    assert [(r.session_id, r.text, r.query_plan) for r in got] == [(1, "text 1", "<p/>"), (4, "text 4", "<p/>")]


def test_scoped_top_k_keeps_servers_apart(rows):
    def two(table, records):
        return rows(table, [{**r, "server_name": s} for s in ("a", "b") for r in records], "server_name")

    requests = two("requests", [
        {"session_id": i, "request_id": 0, "status": "running", "command": "SELECT", "wait_time": i, "sql_handle": b"1"} for i in range(5)
    ])
    got = sessions.top_waiting_requests(
        requests, two("sql_text", [{"sql_handle": b"1", "text": "t"}]), two("query_plan", []), two("statement_plan", []),
        two("databases", []), two("object_names", []), k=2, scope=["server_name"],
    ).collect()
    assert [(r.server_name, r.session_id, r.sql_text) for r in got] == [("a", 4, "t"), ("a", 3, "t"), ("b", 4, "t"), ("b", 3, "t")]


def test_text_by_binary_handle(rows):
    texts = rows("sql_text", [{"sql_handle": b"\x03\x00", "text": "x"}, {"sql_handle": b"\x04", "text": "y"}])
    assert sessions.text_by_handle(texts, "0x0300").first().text == "x"


def test_connection_counts(rows):
    connections = rows("connections", [{"session_id": i, "most_recent_sql_handle": h} for i, h in enumerate([b"a", b"a", None, b"b"])])
    assert [r.connections for r in sessions.connections_by_handle(connections).collect()] == [2, 1, 1]
    assert sessions.connection_total(connections).first().connections == 4


def test_locked_objects(rows):
    locks = rows("lock_info", [{"rsc_objid": 1, "req_spid": 7}] * 3 + [{"rsc_objid": 2, "req_spid": 7}, {"rsc_objid": 3, "req_spid": 8}])
    processes = rows("processes", [{"spid": 7, "loginame": "u"}, {"spid": 7, "loginame": "u"}])
    objects = rows("objects", [{"object_id": 1, "name": "t"}, {"object_id": 2, "name": None}, {"object_id": 3, "name": "x"}])
    assert listed(sessions.locked_objects(locks, processes, objects)) == [("t", 7, "u")]


# cached statements


def test_top_queries(rows):
    stats = rows("query_stats", [
        {"sql_handle": bytes([i]), "plan_handle": bytes([i]), "statement_start_offset": 0, "statement_end_offset": -1,
         "last_execution_time": T0, "execution_count": 101 + i, "total_worker_time": 1000 * i, "total_logical_reads": 7000 - i,
         "last_logical_reads": 500} for i in range(1, 6)
    ] + [
        {"sql_handle": b"\x01", "plan_handle": b"\x01", "last_execution_time": T0, "execution_count": 100, "total_worker_time": 10**9},
        {"sql_handle": b"\x01", "plan_handle": b"\x01", "last_execution_time": T0 - timedelta(days=9), "execution_count": 999, "total_worker_time": 10**9},
    ])
    texts = rows("sql_text", [{"sql_handle": bytes([i]), "dbid": i % 3, "objectid": 1, "text": f"text {i}"} for i in range(1, 6)])
    plans = rows("query_plan", [{"plan_handle": bytes([i]), "query_plan": "<p/>"} for i in range(1, 6)])
    databases = rows("databases", [{"database_id": 1, "name": "one"}, {"database_id": 2, "name": "tools"}])
    names = rows("object_names", [{"database_id": 1, "object_id": 1, "name": "proc"}])
    got = queries.top_queries(stats, texts, plans, databases, names, since=T0 - timedelta(days=1), k=3, excluded_databases=["tools"]).collect()
    assert len(got) <= 12
    # of 5, 4, 3 by CPU: 5 is in the excluded database, 3 in none.
    assert [(r.report_name, r.row_no, r.sql_statement) for r in got if r.report_name == "TotalCPU"] == [("TotalCPU", 2, "text 4")]
    four = next(r for r in got if r.report_name == "TotalCPU")
    assert (four.avg_worker_time, four.avg_logical_reads, four.last_reads_per_execution, four.object_name) == (38, 66, 4, "proc")


def test_statements_matching_any_case(rows):
    stats = rows("query_stats", [{"sql_handle": bytes([i]), "statement_start_offset": 0, "statement_end_offset": -1} for i in (1, 2)])
    texts = rows("sql_text", [{"sql_handle": b"\x01", "text": "exec FN_X"}, {"sql_handle": b"\x02", "text": "exec fn"}])
    assert [r.text for r in queries.statements_matching(stats, texts, "%fn_x%").collect()] == ["exec FN_X"]


def test_procedure_plans(rows):
    procedures = rows("procedure_stats", [{"plan_handle": b"p", "database_id": 1, "object_id": 5, "execution_count": 9}])
    stats = rows("query_stats", [{"plan_handle": b"p", "execution_count": n, "plan_generation_num": n + 1} for n in (3, 4)])
    plans = rows("query_plan", [{"plan_handle": b"p", "query_plan": "<p/>"}])
    names = rows("object_names", [{"database_id": 1, "object_id": 5, "name": "proc"}])
    assert bag(queries.procedure_plans(procedures, stats, plans, names, 1, "proc")) == [("proc", 9, 4, 3, "<p/>"), ("proc", 9, 5, 4, "<p/>")]
    assert queries.procedure_plans(procedures, stats, plans, names, 1, "other").isEmpty()


# backups and databases


def test_last_backup_text(rows):
    at = datetime(2024, 1, 10, 12)
    databases = rows("databases", [{"database_id": i, "name": n, "compatibility_level": 110} for i, n in enumerate(["never", "odd", "open", "long", "night", "newer"])])
    backupset = rows("backupset", [
        {"backup_set_id": 1, "database_name": "odd", "type": "X", "backup_start_date": at, "backup_finish_date": at},
        {"backup_set_id": 2, "database_name": "open", "type": "D", "backup_start_date": at, "backup_finish_date": None},
        {"backup_set_id": 3, "database_name": "long", "type": "D", "backup_start_date": at, "backup_finish_date": at + timedelta(seconds=12345)},
        {"backup_set_id": 4, "database_name": "night", "type": "L", "backup_start_date": datetime(2024, 1, 8, 23, 59, 59),
         "backup_finish_date": datetime(2024, 1, 9, 0, 0, 1)},
        {"backup_set_id": 6, "database_name": "newer", "type": "I", "backup_start_date": at, "backup_finish_date": at},
        {"backup_set_id": 5, "database_name": "newer", "type": "D", "backup_start_date": at + timedelta(days=1), "backup_finish_date": at + timedelta(days=1)},
    ])
    files = rows("master_files", [
        {"database_id": 0, "type_desc": "ROWS", "size": 129}, {"database_id": 0, "type_desc": "rows", "size": 255}, {"database_id": 0, "type_desc": "LOG", "size": 127},
    ])
    got = {r.database_name: r for r in backups.database_overview(databases, files, backupset, at).collect()}
    assert got["never"].last_backup == got["odd"].last_backup == got["open"].last_backup == "-"
    assert (got["odd"].last_backup_type, got["never"].last_backup_type) == ("X", None)
    assert got["long"].last_backup == "Full – 0 days ago – 10/01/2024 12:00:00 – 10/01/2024 15:25:45 (12345 seconds)"
    assert got["night"].last_backup == "Transaction log – 1 days ago – 08/01/2024 23:59:59 – 09/01/2024 00:00:01 (2 seconds)"
    assert got["newer"].last_backup_type == "I"
    # 129 and 255 pages are 1 MB each.
    assert (got["never"].data_files, got["never"].data_mb, got["never"].log_files, got["never"].log_mb) == (2, 2, 1, 0)
    assert (got["odd"].data_files, got["odd"].data_mb, got["odd"].compatibility_level) == (0, None, None)


def test_last_backup_history(rows):
    backupset = rows("backupset", [
        {"database_name": "a", "type": t, "backup_finish_date": T0 + timedelta(days=d)} for t, d in [("D", 1), ("D", 3), ("L", 2), ("Q", 9)]
    ] + [{"database_name": "b", "type": "Q", "backup_finish_date": T0}])
    assert listed(backups.last_backup_history(backupset)) == [
        ("b", None, None, None), ("a", T0 + timedelta(days=3), None, T0 + timedelta(days=2)),
    ]


# storage and indexes


def catalog(rows, indexes_of, partitions, pages=(), heap=True):
    db = {"database_name": "db"}
    return (
        rows("indexes", [{**db, "object_id": o, "index_id": i, "name": f"ix{i}", "type_desc": "NONCLUSTERED"} for o, i in indexes_of], "database_name"),
        rows("objects", [{**db, "object_id": o, "schema_id": 1, "name": f"t{o}", "is_user_table": True, "has_clustered_index": not heap}
                         for o in sorted({o for o, _ in indexes_of})], "database_name"),
        rows("schemas", [{**db, "schema_id": 1, "name": "dbo"}, {**db, "schema_id": 2, "name": "SYS"}], "database_name"),
        rows("partitions", [{**db, "partition_id": p, "object_id": o, "index_id": i, "rows": n} for p, o, i, n in partitions], "database_name"),
        rows("allocation_units", [{**db, "container_id": c, "total_pages": n} for c, n in pages], "database_name"),
    )


def test_equal_indexes_count_once(rows):
    tables = catalog(rows, [(1, 0), (1, 2), (1, 3)], [(10, 1, 0, 20), (11, 1, 2, 20), (12, 1, 3, 30)], [(10, 128), (11, 100), (11, 28), (12, 64)])
    assert storage.heap_tables(*tables).first().total_space_mb == Decimal("1.50")
    assert storage.heap_tables(*tables, distinct_first=False).first().total_space_mb == Decimal("2.50")
    assert storage.heap_tables(*tables).first().number_of_rows == 30


def test_table_edges(rows):
    tables = catalog(rows, [(1, 0), (2, 0), (3, 0)], [(10, 1, 0, 10), (20, 2, 0, 11)])
    assert [(r.table_name, r.total_space_mb) for r in storage.heap_tables(*tables).collect()] == [("t2", None)]
    assert [(r.table_name, r.number_of_rows) for r in storage.table_sizes(*tables).collect()] == [("t2", 11), ("t1", 10), ("t3", None)]
    assert storage.heap_tables(*tables, excluded_databases=["DB"]).isEmpty()
    assert [r.table_name for r in storage.heap_tables(*tables, min_rows=0, k=1).collect()] == ["t2"]
    clustered = catalog(rows, [(1, 1)], [(10, 1, 1, 100)], heap=False)
    assert storage.heap_tables(*clustered).isEmpty() and storage.table_sizes(*clustered).count() == 1


def test_growth_texts(rows):
    files = rows("master_files", [
        {"database_id": 1, "file_id": n, "type_desc": "ROWS", "physical_name": "x:/f", "size": s, "growth": g, "is_percent_growth": p}
        for n, (s, g, p) in enumerate([(1280, 10, True), (1280, 6400, False), (1280, 0, False), (1280, 127, False), (300, 7, True), (1, 1, None)])
    ])
    got = storage.file_space(files, rows("file_io_stats", []), rows("file_space_used", []), rows("databases", [])).collect()
    assert {r.file_id: (r.growth, r.next_growth_mb) for r in got} == {
        0: ("10%", Decimal("1.00")), 1: ("50 MB", Decimal("50.00")), 2: ("0 MB", Decimal("0.00")), 3: ("0 MB", Decimal("0.99")),
        4: ("7%", Decimal("0.16")), 5: (None, None),
    }
    assert got[0].disk_drive == "X" and got[0].size_on_disk_mb is None


def test_spaces(rows):
    drives = rows("drives", [{"drive_letter": "D", "total_space": 3, "free_space": 2}, {"drive_letter": "C", "total_space": 4, "free_space": 1}])
    assert [(r.drive_letter, r.used_space_mb, r.percentage_free) for r in storage.drive_space(drives).collect()] == [
        ("C", 3, Decimal("25.0000000000")), ("D", 1, Decimal("66.6666666600")),
    ]
    files = rows("master_files", [{"database_id": 1, "file_id": i, "type": i % 2, "size": 131072 * i} for i in (1, 2, 4)])
    volumes = rows("volumes", [
        {"database_id": 1, "file_id": i, "volume_mount_point": "V", "logical_volume_name": "l", "total_bytes": 3 * 2**30, "available_bytes": 2**31} for i in (1, 2)
    ])
    assert listed(storage.volume_free_space(files, volumes)) == [(None, "MSSQLSERVER", "V", "l", 3, 2, Decimal("66.67"))]
    assert storage.volume_free_space(files, volumes)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    sizes = storage.database_sizes(rows("databases", [{"database_id": 1, "name": "a"}, {"database_id": 2, "name": "b"}]), files)
    assert bag(sizes) == [("a", Decimal("6.000000"), Decimal("1.000000")), ("b", None, None)]


def test_unused_index_order(rows):
    db = {"database_name": "db"}
    tables = catalog(rows, [(1, 2), (2, 2), (3, 2), (4, 2)], [(n, o, 2, 5) for n, o in enumerate((1, 1, 2, 3, 4))])
    flags = {"is_primary_key": F.lit(False), "is_unique_constraint": F.lit(False), "is_unique": F.col("object_id") == 4}
    usage = rows("index_usage", [
        {**db, "object_id": o, "index_id": 2, "last_user_seek": t} for o, t in [(1, T0), (2, None), (3, None), (4, None)]
    ], "database_name")
    stats = rows("partition_stats", [{**db, "object_id": o, "index_id": 2, "used_page_count": 64 * o} for o in (1, 2, 3, 4)], "database_name")
    got = indexes.unused_indexes(usage, tables[0].withColumns(flags), stats, tables[3], tables[1], tables[2])
    assert [(r.table_name, r.index_size_mb, r.table_rows) for r in got.collect()] == [
        ("t3", Decimal("1.500"), 5), ("t2", Decimal("1.000"), 5), ("t1", Decimal("0.500"), 10),
    ]


def test_index_scripts(rows):
    db = {"database_name": "db"}
    table = catalog(rows, [(1, 2), (2, 2), (2, 3)], [])
    same_name = table[0].withColumn("name", F.lit("ix]2"))
    columns = rows("index_columns", [
        {**db, "object_id": 1, "index_id": 2, "column_id": c, "key_ordinal": k, "is_included_column": k == 0}
        for c, k in [(1, 2), (2, 1), (4, 0), (3, 0)]
    ] + [{**db, "object_id": 2, "index_id": 2, "column_id": 1, "key_ordinal": 1, "is_included_column": False}], "database_name")
    names = rows("all_columns", [{**db, "object_id": o, "column_id": c, "name": f"c{c}"} for o in (1, 2) for c in range(1, 5)], "database_name")
    got = {(r.table_name, r.index_id): r for r in indexes.index_scripts(same_name, columns, names, table[1], table[2]).collect()}
    assert got["t1", 2].create_statement == "CREATE INDEX ix]2 ON [dbo].[t1] ( c2, c1 )  INCLUDE ( c3, c4 )"
    assert got["t2", 2].create_statement == "CREATE INDEX ix]2 ON [dbo].[t2] ( c1 ) "
    assert got["t2", 3].create_statement is None
    assert got["t1", 2].drop_statement == "DROP INDEX [ix]]2] ON [dbo].[t1]"


# temporary space


def test_prefixes(rows):
    names = rows("temp_tables", [{"name": n} for n in ("#abcdefgh", "#abcdefghi", "__abcdefgh", "#abc__defg", "#abc____xyz", "#ab      ")])
    assert bag(tempspace.temp_table_prefixes(names)) == sorted([("", 2), ("#abc", 2)], key=repr)
    assert tempspace.temp_table_count(names).first().tables == 4


@pytest.fixture()
def snapshots(rows):
    long = "x" * 100
    data = [(T0, long + "1", 1, 2), (T0, long + "2", 3, 4), (T0, None, 50, 0), (T0, "small", 0, 1), (T0 + timedelta(hours=1), long + "1", 9, 9)]
    return rows("tempdb_snapshots", [dict(zip(("collect_date", "query_text", "internal_pages", "user_pages"), d)) for d in data])


def test_snapshot_offenders(snapshots):
    long = "x" * 100
    got = bag(tempspace.snapshot_top_offenders(snapshots, T0, k=2))
    assert got == sorted([(T0, long + "1", 1, 2, long, 10), (T0, long + "2", 3, 4, long, 10), (None, None, None, None, None, 50)], key=repr)


def test_snapshot_counts(snapshots):
    counts = listed(tempspace.snapshot_query_counts(snapshots, T0))
    assert sorted(c[1] for c in counts) == [1, 1, 2] and sum(c[1] for c in counts) == 4
    assert [r.pages for r in tempspace.snapshot_query_pages(snapshots, T0).collect()] == [50, 7, 3, 1]
    assert listed(tempspace.snapshot_timeline(snapshots, T0 + timedelta(hours=24))) == [(T0 + timedelta(hours=1), 1)]


def test_space(rows):
    space = rows("session_space", [{"session_id": i, "user_objects_alloc_page_count": 1, "internal_objects_alloc_page_count": i % 3} for i in range(9)])
    assert [r.session_id for r in tempspace.top_session_space(space).collect()] == [2, 5, 8, 1, 4]
    files = rows("file_space", [{"database_id": d, "user_object_reserved_page_count": 2**31} for d in (2, 2, 3)])
    assert tempspace.space_summary(files).first() == (2**35, None, None, None)


def test_files_of_a_path_largest_first(rows):
    paths = {1: "X:\\tempdb\\a.mdf", 2: "x:\\TempDB\\b.ndf", 3: "X:\\tempdb2\\c.mdf", 4: "X:\\tempdb\\d.ndf", 5: None}
    files = rows("master_files", [{"database_id": 2, "file_id": i, "physical_name": p} for i, p in paths.items()])
    sizes = rows("file_io_stats", [{"database_id": 2, "file_id": i, "size_on_disk_bytes": i * 2**20} for i in (1, 2, 3)])
    other = rows("file_space_used", []), rows("databases", [])
    assert [r.file_id for r in storage.file_space(files, sizes, *other, path_like="X:\\tempdb\\%", largest_first=True).collect()] == [2, 1, 4]
    assert [r.file_id for r in storage.file_space(files, sizes, *other, largest_first=True).collect()] == [3, 2, 1, 4, 5]
