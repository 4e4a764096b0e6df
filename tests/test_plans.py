"""Physical plans: what must not appear, and what must be pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from registered import QUERIES
from servertide.operators.scratch import scratch_path
from servertide.plans import queries, sessions, tempspace, waits
from servertide.sources.collected import read_collected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(lines, at):
    """The first line under ``at`` that does more than project or pass on."""
    for line in lines[at + 1:]:
        name = re.sub(r"^[\s:+\-*()\d]*", "", line)
        if not name.startswith(("Project", "Sort ", "WholeStageCodegen")):
            return name
    return ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_and_no_single_task_over_raw_rows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert below(lines, at).startswith(("HashAggregate", "TakeOrderedAndProject")), line


@pytest.fixture(scope="module", autouse=True)
def whole_lines(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def collected(spark):
    """Telemetry tables as files, with the types of collected telemetry."""
    from servertide.sources.schemas import schema

    root = scratch_path(spark, "collected")
    for table in ("sessions", "connections", "sql_text", "databases", "object_names", "query_stats", "query_plan", "statement_plan", "wait_stats", "perf_counters"):
        spark.createDataFrame([], schema(table)).write.parquet(f"{root}/{table}")
    return lambda table, *name_keys: read_collected(spark, root, table, name_keys=name_keys)


def scan_of(plan, column):
    return next(line for line in plan.splitlines() if "FileScan" in line and column in line)


def test_filters_and_columns_reach_the_scan(collected):
    others = [collected(t) for t in ("connections", "sql_text", "databases", "object_names")]
    df = sessions.session_inventory(collected("sessions", "login_name"), *others, login="x", self_id=7)
    scan = scan_of(plan_of(df), "login_name")
    assert "EqualTo(login_name_key,x)" in scan and "memory_usage" not in scan

    df = queries.top_queries(
        *[collected(t) for t in ("query_stats", "sql_text", "query_plan", "databases", "object_names")], since="2024-01-01 00:00:00"
    )
    scan = scan_of(plan_of(df), "execution_count")
    assert "GreaterThan(execution_count,100)" in scan and "GreaterThan(last_execution_time,2024-01-01T00:00)" in scan
    assert "plan_generation_num" not in scan

    scan = scan_of(plan_of(waits.top_waits(collected("wait_stats"))), "wait_type")
    assert "Not(In(wait_type" in scan

    scan = scan_of(plan_of(sessions.replica_undo_backlog(collected("perf_counters", "counter_name"))), "counter_name")
    assert "EqualTo(counter_name_key,log remaining for undo)" in scan and "Not(EqualTo(cntr_value,0))" in scan


def test_top_k_keeps_k_rows_per_task(spark, sf_dir, collected):
    for name in ("heap_tables", "unused_indexes", "activity_monitor", "top_waits_by_server"):
        assert re.search(r"WindowGroupLimit .* Partial", plan_of(QUERIES[name](spark, sf_dir))), name
    assert "TakeOrderedAndProject" in plan_of(waits.top_waits(collected("wait_stats")))


def scans(plan, name):
    return plan.count(f"/{name}]")


def test_inputs_are_read_once(collected):
    """On collected tables: one scan of each input, and no text where the report shows none."""
    since = "2024-01-01 00:00:00"
    stats, text, plans = (collected(t) for t in ("query_stats", "sql_text", "query_plan"))
    df = queries.top_queries(stats, text, plans, collected("databases"), collected("object_names"), since=since)
    assert scans(plan_of(df), "query_stats") == 1
    df = queries.cached_statements_with_plan(stats, text, collected("statement_plan"))
    assert (scans(plan_of(df), "query_stats"), scans(plan_of(df), "sql_text")) == (1, 1)
    df = queries.query_averages(stats, text)
    assert scans(plan_of(df), "query_stats") == 1 and "text#" not in plan_of(df)
    df = sessions.session_inventory(*[collected(t) for t in ("sessions", "connections", "sql_text", "databases", "object_names")])
    assert scans(plan_of(df), "connections") == 1


def test_offenders_do_not_move_the_details(spark, sf_dir):
    plan = plan_of(QUERIES["snapshot_top_offenders"](spark, sf_dir))
    join = next(line for line in plan.splitlines() if "query_prefix" in line and "Join" in line)
    assert "BroadcastHashJoin" in join


def test_a_limit_alone_takes_the_sample(spark, sf_dir):
    from servertide.sources.derived import view

    plan = plan_of(tempspace.task_space_sample(view(spark, sf_dir, "task_space")))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
