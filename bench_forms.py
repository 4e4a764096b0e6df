"""Times plain forms of three reports against ours, on the tables in BENCH_SF_DIR.

Prints one JSON line per report: seconds of the plain form, seconds of ours, rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from servertide.plans.blocking import root_blockers  # noqa: E402
from servertide.plans.queries import top_queries  # noqa: E402
from servertide.plans.waits import wait_pareto  # noqa: E402
from servertide.sources.derived import view, views  # noqa: E402


def seconds(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 2)


def part_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wait statistics with a type per part: many types, so that quadratic work shows."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(
        F.concat(F.lit("W"), F.col("l_partkey").cast("string")).alias("wait_type")
    ).agg(
        F.count("*").alias("waiting_tasks_count"), F.sum(F.floor("l_extendedprice")).alias("wait_time_ms"),
        F.sum(F.col("l_linenumber").cast("long")).alias("signal_wait_time_ms"),
    )


def triangular(waits: DataFrame) -> DataFrame:
    ranked = waits.withColumn("n", F.row_number().over(Window.orderBy(F.col("wait_time_ms").desc(), "wait_type"))).withColumn(
        "total", F.sum("wait_time_ms").over(Window.partitionBy())
    )
    earlier = ranked.select(F.col("n").alias("n2"), F.col("wait_time_ms").alias("ms2"))
    return (
        ranked.join(earlier, F.col("n2") <= F.col("n")).groupBy("wait_type", "wait_time_ms", "total").agg(F.sum("ms2").alias("upto"))
        .where((F.col("upto") - F.col("wait_time_ms")) * 100 < F.col("total") * 95)
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that block each other in chains of 90."""
    return view(spark, sf_dir, "processes").select("spid", F.when(F.col("spid") % 90 == 1, F.lit(0)).otherwise(F.col("spid") - 1).alias("blocked"))


def recursive_roots(spark: SparkSession, processes: DataFrame) -> DataFrame:
    processes.createOrReplaceTempView("chained")
    return spark.sql("""
        WITH RECURSIVE walk(spid, root, depth) MAX RECURSION LEVEL 200 AS (
            SELECT spid, spid, 0 FROM chained WHERE blocked = 0
            UNION ALL
            SELECT c.spid, w.root, w.depth + 1 FROM chained c JOIN walk w ON c.blocked = w.spid WHERE c.blocked > 0)
        SELECT * FROM walk""")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wait_pareto(view(spark, sf_dir, "wait_stats")).count()  # start-up
    waits = part_waits(spark, sf_dir)
    processes = chain(spark, sf_dir)
    ranked = views(spark, sf_dir, ["query_stats", "sql_text", "query_plan", "databases", "object_names"])
    forms = {
        "wait_pareto (triangular join)": (lambda: triangular(waits), lambda: wait_pareto(waits)),
        "root_blockers (recursive query)": (lambda: recursive_roots(spark, processes), lambda: root_blockers(processes)),
        "top_queries (texts joined before the top-k)": (
            lambda: top_queries(ranked[0].join(ranked[1].select("sql_handle", "text"), "sql_handle"), *ranked[1:], since="1996-01-01", min_executions=25),
            lambda: top_queries(*ranked, since="1996-01-01", min_executions=25),
        ),
    }
    for name, (plain, ours) in forms.items():
        print(json.dumps({"report": name, "plain_sec": seconds(plain), "ours_sec": seconds(ours)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
