"""Statistics of cached statements and procedures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.functions.numbers import div
from servertide.functions.text import name_key, statement_slice
from servertide.functions.times import instant
from servertide.operators.lookup import attach, lookup_join
from servertide.operators.numbering import row_numbers
from servertide.operators.ranking import rankings
from servertide.plans.sessions import database_names, object_names

HANDLES = ["sql_handle", "plan_handle"]
OFFSETS = ["statement_start_offset", "statement_end_offset"]
MEASURES = [
    "creation_time", "last_execution_time", "execution_count", "total_worker_time", "last_worker_time",
    "total_logical_reads", "last_logical_reads", "total_elapsed_time", "last_elapsed_time", "total_rows", "last_rows",
    "total_grant_kb", "last_grant_kb", "total_used_grant_kb", "last_used_grant_kb", "total_ideal_grant_kb",
    "last_ideal_grant_kb",
]


def _statement(variant: str):
    return statement_slice(F.col("text"), *[F.col(c) for c in OFFSETS], variant)


def statements_matching(query_stats: DataFrame, sql_text: DataFrame, pattern: str, scope: Sequence[str] = ()) -> DataFrame:
    """Cached statements whose batch matches a LIKE pattern in any case."""
    texts = sql_text.where(F.col("text").ilike(pattern)).select(*scope, "sql_handle", "dbid", "objectid", "text")
    found = lookup_join(query_stats.select(*scope, *HANDLES, *OFFSETS, *MEASURES), texts, [*scope, "sql_handle"])
    return found.select(*scope, _statement("zero_based").alias("statement"), *HANDLES, *OFFSETS, *MEASURES, "dbid", "objectid", "text")


def cached_statements_with_plan(query_stats: DataFrame, sql_text: DataFrame, statement_plan: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Statement and plan of every cached statement."""
    plan_key = [*scope, "plan_handle", *OFFSETS]
    rows = query_stats.select(*scope, *HANDLES, *OFFSETS)
    planned = lookup_join(rows, statement_plan.select(*plan_key, "query_plan"), plan_key)
    full = lookup_join(planned, sql_text.select(*scope, "sql_handle", "text"), [*scope, "sql_handle"])
    return full.select(*scope, *HANDLES, *OFFSETS, _statement("inclusive").alias("statement"), "query_plan")


def procedure_plans(
    procedure_stats: DataFrame, query_stats: DataFrame, query_plan: DataFrame, objects: DataFrame,
    database_id: int | None = None, object_name: str | None = None, scope: Sequence[str] = (),
) -> DataFrame:
    """Executions of procedures against executions and version of their current plan."""
    plan = [*scope, "plan_handle"]
    procedures = procedure_stats.select(
        *plan, "database_id", "object_id", F.col("execution_count").alias("procedure_executes")
    )
    if database_id is not None:
        procedures = procedures.where(F.col("database_id") == database_id)
    procedures = procedures.join(object_names(objects, scope, "database_id", "object_id"), [*scope, "database_id", "object_id"], "left")
    if object_name is not None:
        procedures = procedures.where(F.col("object_name") == object_name)
    statements = query_stats.select(
        *plan, F.col("plan_generation_num").alias("version_of_plan"),
        F.col("execution_count").alias("executions_of_current_plan"),
    )
    joined = lookup_join(statements, procedures, plan)
    return lookup_join(joined, query_plan.select(*plan, "query_plan"), plan).select(
        *scope, F.col("object_name").alias("procedure_name"), "procedure_executes", "version_of_plan",
        "executions_of_current_plan", "query_plan",
    )


def query_averages(query_stats: DataFrame, sql_text: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Totals and whole-number averages of each statement whose batch is known, by total CPU."""
    rows = query_stats.select(
        *scope, *HANDLES, *OFFSETS, "total_logical_reads", "total_worker_time", "execution_count",
        div(F.col("total_logical_reads"), F.col("execution_count")).alias("avg_reads"),
        div(F.col("total_worker_time"), F.col("execution_count")).alias("avg_cpu"),
    )
    known = lookup_join(rows, sql_text.select(*scope, "sql_handle"), [*scope, "sql_handle"], "left_semi")
    return known.orderBy(F.col("total_worker_time").desc(), *scope, *HANDLES, *OFFSETS).select(*rows.columns)


def text_of(sql_text: DataFrame, scope: Sequence[str]) -> DataFrame:
    return sql_text.select(*scope, "sql_handle", "dbid", "objectid", "text")


def ranked_statements(query_stats: DataFrame, since, min_executions: int = 100, measure: str = "total_worker_time", scope: Sequence[str] = ()) -> DataFrame:
    """All recent statements that ran often enough, numbered by a measure."""
    recent = query_stats.where((F.col("last_execution_time") > instant(since)) & (F.col("execution_count") > min_executions))
    order = [F.col(measure).desc(), *(F.col(c) for c in (*HANDLES, *OFFSETS))]
    return row_numbers(recent.select(*scope, *HANDLES, *OFFSETS, "execution_count", measure), order, scope, "row_no")


def top_queries(
    query_stats: DataFrame, sql_text: DataFrame, query_plan: DataFrame, databases: DataFrame, objects: DataFrame,
    since, min_executions: int = 100, k: int = 20, excluded_databases: Sequence[str] = (), scope: Sequence[str] = (),
) -> DataFrame:
    """Top statements by total and average CPU and by total and average reads, enriched.

    The four lists are cut to k rows from numbers alone; batch and plan are fetched for
    those rows. ``avg_logical_reads`` is what the average list is ordered by;
    ``last_reads_per_execution`` is last reads over executions.
    """
    scope = list(scope)
    recent = query_stats.select(*scope, *HANDLES, *OFFSETS, *MEASURES).where(
        (F.col("last_execution_time") > instant(since)) & (F.col("execution_count") > min_executions)
    )
    executions = F.col("execution_count")
    lists = rankings(
        recent, k,
        {
            "TotalCPU": F.col("total_worker_time"),
            "AvgCPU": div(F.col("total_worker_time"), executions),
            "TotalIO": F.col("total_logical_reads"),
            "AVGIO": div(F.col("total_logical_reads"), executions),
        },
        [*HANDLES, *OFFSETS], scope,
    )
    full = attach(lists, text_of(sql_text, scope), [*scope, "sql_handle"])
    full = attach(full, query_plan.select(*scope, "plan_handle", "query_plan"), [*scope, "plan_handle"])
    named = (
        full.join(database_names(databases, scope, "dbid"), [*scope, "dbid"], "left")
        .where(~F.coalesce(name_key(F.col("database_name")), F.lit("")).isin("", *map(name_key, excluded_databases)))
        .join(object_names(objects, scope), [*scope, "dbid", "objectid"], "left")
    )
    return named.select(
        *scope, "row_no", "report_name", "creation_time", "last_execution_time", "execution_count", "total_worker_time",
        div(F.col("total_worker_time"), executions).alias("avg_worker_time"), "last_worker_time", "total_logical_reads",
        div(F.col("total_logical_reads"), executions).alias("avg_logical_reads"),
        div(F.col("last_logical_reads"), executions).alias("last_reads_per_execution"), "last_logical_reads",
        *MEASURES[7:], F.col("dbid").alias("database_id"), "database_name", "objectid",
        F.coalesce("object_name", F.lit("")).alias("object_name"),
        _statement("exclusive").alias("sql_statement"), "query_plan",
    )
