"""Waits: top types, the types that make up most of the time, and wait names."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servertide.functions.numbers import rounded_ratio
from servertide.operators.lookup import lookup_join
from servertide.operators.numbering import row_numbers
from servertide.operators.ranking import top_k
from servertide.operators.running import running_total

# Wait types that say nothing about load.
BENIGN_WAITS_SHORT = (
    "BAD_PAGE_PROCESS", "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "DBMIRROR_EVENTS_QUEUE",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "ONDEMAND_TASK_QUEUE",
    "PREEMPTIVE_OS_AUTHENTICATIONOPS", "PREEMPTIVE_OS_GETPROCADDRESS", "REQUEST_FOR_DEADLOCK_SEARCH",
    "SLEEP_BPOOL_FLUSH", "SLEEP_TASK", "SQLTRACE_BUFFER_FLUSH", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)

# The longer list used for the Pareto report.
BENIGN_WAITS = (
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH", "BROKER_TRANSMITTER",
    "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "CLR_SEMAPHORE", "DBMIRRORING_CMD",
    "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE", "DIRTY_PAGE_POLL",
    "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC", "FSAGENT", "FT_IFTSHC_MUTEX", "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "HADR_CLUSAPI_CALL", "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE",
    "MEMORY_ALLOCATION_EXT", "ONDEMAND_TASK_QUEUE", "PREEMPTIVE_XE_GETTARGETSTATE",
    "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT", "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_SHUTDOWN_QUEUE",
    "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE", "SERVER_IDLE_CHECK",
    "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP", "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP",
    "SNI_HTTP_ACCEPT", "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "SQLTRACE_WAIT_ENTRIES", "WAITFOR", "WAITFOR_TASKSHUTDOWN", "WAIT_FOR_RESULTS", "WAIT_XTP_CKPT_CLOSE",
    "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "WAIT_XTP_RECOVERY", "XE_DISPATCHER_JOIN",
    "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)

# Fixed value: start of the help page of a wait type.
WAIT_HELP_PREFIX = "https://www.sqlskills.com/help/waits/"


def top_waits(wait_stats: DataFrame, excluded: Sequence[str] = BENIGN_WAITS_SHORT, k: int = 10, scope: Sequence[str] = ()) -> DataFrame:
    """Wait types with the most wait time."""
    order = [F.col("wait_time_ms").desc(), F.col("wait_type")]
    waits = wait_stats.where(~F.col("wait_type").isin(*excluded)).select(
        *scope, "wait_type", "waiting_tasks_count", "wait_time_ms", "max_wait_time_ms", "signal_wait_time_ms"
    )
    return top_k(waits, k, order, scope).orderBy(*scope, *order)


def ranked_waits(wait_stats: DataFrame, excluded: Sequence[str] = BENIGN_WAITS, scope: Sequence[str] = ()) -> DataFrame:
    """All wait types that were waited for, numbered by wait time."""
    waits = wait_stats.where(~F.col("wait_type").isin(*excluded) & (F.col("waiting_tasks_count") > 0)).select(
        *scope, "wait_type", "waiting_tasks_count", "wait_time_ms", "max_wait_time_ms", "signal_wait_time_ms"
    )
    return row_numbers(waits, [F.col("wait_time_ms").desc(), F.col("wait_type")], scope, "row_num")


def wait_pareto(
    wait_stats: DataFrame, excluded: Sequence[str] = BENIGN_WAITS, threshold: float = 95, scope: Sequence[str] = (),
    help_prefix: str = WAIT_HELP_PREFIX, slices: int | None = None,
) -> DataFrame:
    """Largest wait types until those before a type reach ``threshold`` percent of all wait time.

    Comparing the sums in integers keeps a type out exactly when the types before it
    reach the threshold.
    """
    waits = wait_stats.where(~F.col("wait_type").isin(*excluded) & (F.col("waiting_tasks_count") > 0)).select(
        *scope, "wait_type", "waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms"
    )
    order = [F.col("wait_time_ms").desc(), F.col("wait_type")]
    summed = running_total(waits, "wait_time_ms", order, scope, slices)
    share = Decimal(str(threshold))
    kept = summed.where(F.col("total_before").cast("decimal(24,0)") * 100 < F.col("grand_total").cast("decimal(24,0)") * F.lit(share))
    wait, signal, tasks = F.col("wait_time_ms"), F.col("signal_wait_time_ms"), F.col("waiting_tasks_count")
    resource = wait - signal
    return (
        kept.orderBy(*scope, *order)
        .select(
            *scope, "wait_type",
            rounded_ratio(wait, 1000, 16, 2).alias("wait_s"),
            rounded_ratio(resource, 1000, 16, 2).alias("resource_s"),
            rounded_ratio(signal, 1000, 16, 2).alias("signal_s"),
            tasks.alias("wait_count"),
            rounded_ratio(wait * 100, F.col("grand_total"), 5, 2).alias("percentage"),
            rounded_ratio(wait, tasks * 1000, 16, 4).alias("avg_wait_s"),
            rounded_ratio(resource, tasks * 1000, 16, 4).alias("avg_res_s"),
            rounded_ratio(signal, tasks * 1000, 16, 4).alias("avg_sig_s"),
            F.concat(F.lit(help_prefix), F.col("wait_type")).alias("help_url"),
        )
    )


def wait_type_names(requests: DataFrame, wait_map: DataFrame, map_name: str = "wait_types", scope: Sequence[str] = ()) -> DataFrame:
    """Requests with the name of their wait type from a map.

    The name is the last wait type where the map says UNKNOWN or the same, and NULL
    where the map does not know the type.
    """
    kind = requests.schema["wait_type"].dataType
    if isinstance(kind, T.BinaryType):
        # The number of the wait type in two bytes.
        key = F.unhex(F.lpad(F.hex(F.pmod(F.col("map_key").cast("long"), F.lit(65536))), 4, "0"))
    else:
        key = F.col("map_key").cast(kind)
    names = wait_map.where(F.col("name") == map_name).select(*scope, key.alias("wait_type"), "map_value")
    columns = [*scope, "session_id", "request_id", "wait_type", "last_wait_type", "wait_time"]
    named = lookup_join(requests.select(*columns), names, [*scope, "wait_type"], "left")
    same = (F.col("map_value") == "UNKNOWN") | (F.col("map_value") == F.col("last_wait_type"))
    return named.select(
        *columns, "map_value", F.when(same, F.col("last_wait_type")).otherwise(F.col("map_value")).alias("wait_type_name")
    )
