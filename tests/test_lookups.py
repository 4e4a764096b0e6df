"""Lookup tables in buckets: what they hold, and that joins leave them where they are."""

import re

import pytest

from registered import QUERIES, over, stored
from servertide.operators.lookup import lookup_join
from servertide.operators.scratch import scratch_path
from servertide.sources.lookups import KEYS, Lookup
from servertide.sources.schemas import schema


def texts(rows, *handles, text="t"):
    return rows("sql_text", [{"sql_handle": None if h is None else str(h).encode(), "dbid": 1, "text": f"{text}{h}"} for h in handles])


def held(lookup):
    return sorted((bytes(r.sql_handle).decode(), r.text) for r in lookup.read().collect())


def test_known_rows_are_not_added_again(spark, rows):
    root = scratch_path(spark, "lookups")
    lookup = Lookup(spark, root, "sql_text", buckets=4)
    assert held(lookup) == []
    lookup.add(texts(rows, 1, 2, 3, 3, None))
    first = [("1", "t1"), ("2", "t2"), ("3", "t3")]
    assert held(lookup) == first
    lookup.add(texts(rows, 1, 2, 3))
    lookup.add(texts(rows, 3, 4, text="u"))
    assert held(lookup) == [*first, ("4", "u4")]
    # Another reader of the same folder, with a catalog entry of its own.
    spark.sql(f"DROP TABLE {lookup._name}")
    assert held(Lookup(spark, root, "sql_text", buckets=4)) == [*first, ("4", "u4")]


def test_failed_job_adds_nothing(spark, rows):
    from pyspark.sql import functions as F

    lookup = Lookup(spark, scratch_path(spark, "lookups"), "sql_text", buckets=4)
    some = texts(rows, *range(40))
    broken = some.withColumn("text", F.when(F.col("sql_handle") == b"17", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        lookup.add(broken)
    lookup.add(some)
    assert len(held(lookup)) == 40


def test_scopes_are_part_of_the_key(spark, rows):
    lookup = Lookup(spark, scratch_path(spark, "lookups"), "sql_text", "server_name", buckets=4)
    for server in "ab":
        lookup.add(rows("sql_text", [{"server_name": server, "sql_handle": b"h", "text": server}], "server_name"))
    assert sorted((r.server_name, r.text) for r in lookup.read().collect()) == [("a", "a"), ("b", "b")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("hot_rows", [None, 5, 1000])
def test_hot_keys(spark, how, hot_rows):
    left = spark.sql("SELECT id AS n, CASE WHEN id < 60 THEN 1 WHEN id < 70 THEN NULL ELSE id END AS h FROM range(100)")
    right = spark.sql("SELECT id AS h, concat('t', id) AS text FROM range(80)")
    want = sorted(map(tuple, left.join(right, ["h"], how).collect()), key=repr)
    assert sorted(map(tuple, lookup_join(left, right, ["h"], how, hot_rows).collect()), key=repr) == want


REPORTS = sorted(n for n, q in QUERIES.items() if isinstance(q, over) and not isinstance(q, stored) and set(q.names) & set(KEYS))


@pytest.fixture(scope="module")
def tables(spark):
    root = scratch_path(spark, "lookups")

    def table(name):
        if name not in KEYS:
            return spark.createDataFrame([], schema("processes" if name == "chained_processes" else name))
        lookup = Lookup(spark, root, name, buckets=16)
        return lookup.read()

    # As with tables that are too large to broadcast.
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def depth(line):
    return len(re.match(r"^[\s:+\-|]*", line).group())


def moved(plan):
    """Exchanges between the scan of a lookup table and the join that reads it; and how many such scans there are."""
    lines, found, scans = plan.splitlines(), [], 0
    for at, line in enumerate(lines):
        if "FileScan" not in line or not re.search(r"servertide_(sql_text|query_plan|statement_plan)_", line):
            continue
        scans += 1
        here = depth(line)
        for above in reversed(lines[:at]):
            if depth(above) < here:
                here = depth(above)
                if "Join" in above:
                    break
                if "Exchange" in above:
                    found.append(above)
    return found, scans


@pytest.mark.parametrize("name", REPORTS)
def test_reports_leave_lookup_tables_in_place(spark, tables, name):
    query = QUERIES[name]
    parameters = {k: v for k, v in query.parameters.items() if k != "handle"}
    if "handle" in query.parameters:
        parameters["handle"] = "0x2a"
    plan = query.report(*map(tables, query.names), **parameters)._jdf.queryExecution().executedPlan().toString()
    found, scans = moved(plan)
    assert not found
    # Trees of blocking write intermediate tables, which an empty table ends early.
    assert scans or "blocking" in name
