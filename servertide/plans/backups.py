"""Databases and their backups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.functions.numbers import pages_to_whole_mb
from servertide.functions.text import fold, key_of, truncate
from servertide.functions.times import day_first, days_between, instant, seconds_between

# Names of compatibility levels.
COMPATIBILITY_LEVELS = {
    60: "60 (SQL Server 6.0)",
    65: "65 (SQL Server 6.5)",
    70: "70 (SQL Server 7.0)",
    80: "80 (SQL Server 2000)",
    90: "90 (SQL Server 2005)",
    100: "100 (SQL Server 2008)",
}

# Backup types.
BACKUP_TYPES = {"D": "Full", "I": "Differential", "L": "Transaction log"}

# Flag column, output column, text where the flag is set.
FLAG_TEXTS = [
    ("is_fulltext_enabled", "fulltext", "Fulltext enabled"),
    ("is_auto_close_on", "autoclose", "autoclose"),
    ("is_read_only", "read_only", "read only"),
    ("is_auto_shrink_on", "autoshrink", "autoshrink"),
    ("is_auto_create_stats_on", "auto_create_statistics", "auto create statistics"),
    ("is_auto_update_stats_on", "auto_update_statistics", "auto update statistics"),
    ("is_in_standby", "standby", "standby"),
    ("is_cleanly_shutdown", "cleanly_shutdown", "cleanly shutdown"),
]


def _named(column, names):
    """CASE without ELSE."""
    text = F.lit(None).cast("string")
    for value, name in names.items():
        text = F.when(column == value, F.lit(name)).otherwise(text)
    return text


def last_backup_history(backupset: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Last full, differential and log backup of each database; spellings of one name are one database."""

    def last(code: str):
        return F.max(F.when(F.col("type") == code, F.col("backup_finish_date")))

    return (
        backupset.withColumn("name_key", key_of(backupset, "database_name")).groupBy(*scope, "name_key")
        .agg(
            F.min("database_name").alias("database_name"),
            last("D").alias("last_full_backup"), last("I").alias("last_differential"), last("L").alias("last_log"),
        )
        .orderBy(*scope, F.col("name_key").desc()).drop("name_key")
    )


def database_overview(databases: DataFrame, master_files: DataFrame, backupset: DataFrame, as_of, scope: Sequence[str] = ()) -> DataFrame:
    """Every database with its files, state, flags and latest backup.

    The backup text is '-' where a part of it is unknown (no backup, other type code, not
    finished); the parts are columns as well.
    """
    scope = list(scope)
    kind = fold(F.col("type_desc"))
    mb = pages_to_whole_mb(F.col("size"))
    files = master_files.groupBy(*scope, "database_id").agg(
        F.count(F.when(kind == "rows", 1)).alias("data_files"),
        F.sum(F.when(kind == "rows", mb)).alias("data_mb"),
        F.count(F.when(kind == "log", 1)).alias("log_files"),
        F.sum(F.when(kind == "log", mb)).alias("log_mb"),
    )
    latest = backupset.groupBy(*scope, key_of(backupset, "database_name").alias("name_key")).agg(
        F.max_by(F.struct("type", "backup_start_date", "backup_finish_date"), "backup_set_id").alias("backup")
    )
    start, finish = F.col("backup.backup_start_date"), F.col("backup.backup_finish_date")
    age = F.abs(days_between(instant(as_of), finish)).cast("string")
    dash = F.lit(" – ")
    text = F.concat(
        _named(F.col("backup.type"), BACKUP_TYPES), dash,
        F.coalesce(F.concat(age, F.lit(" days ago")), F.lit("NEVER")), dash,
        day_first(start), dash, day_first(finish),
        F.lit(" ("), seconds_between(start, finish).cast("string"), F.lit(" seconds)"),
    )
    rows = databases.join(files, [*scope, "database_id"], "left").withColumn("name_key", key_of(databases, "name")).join(latest, [*scope, "name_key"], "left")
    flags = [F.when(F.col(flag), F.lit(shown)).otherwise("").alias(name) for flag, name, shown in FLAG_TEXTS]
    return (
        rows.select(
            *scope, "database_id", truncate(F.col("name"), 25).alias("database_name"),
            truncate(F.col("status"), 10).alias("status"), "state_desc",
            F.coalesce("data_files", F.lit(0)).cast("long").alias("data_files"), "data_mb",
            F.coalesce("log_files", F.lit(0)).cast("long").alias("log_files"), "log_mb",
            F.col("user_access_desc").alias("user_access"), F.col("recovery_model_desc").alias("recovery_model"),
            _named(F.col("compatibility_level"), COMPATIBILITY_LEVELS).alias("compatibility_level"),
            day_first(F.col("create_date")).alias("creation_date"), F.coalesce(text, F.lit("-")).alias("last_backup"),
            F.col("backup.type").alias("last_backup_type"), start.alias("last_backup_start"), finish.alias("last_backup_finish"),
            F.col("page_verify_option_desc").alias("page_verify_option"), *flags,
            F.col("name").alias("full_name"), F.col("status").alias("full_status"),
        )
        .orderBy(*scope, "database_name", F.col("last_backup").desc(), "full_name", "database_id")
    )
