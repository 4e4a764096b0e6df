"""Generic operators against plain Python on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from servertide.operators.lookup import attach, found_for, lookup_join
from servertide.operators.ranking import rankings, top_k
from servertide.operators.running import running_total
from servertide.operators.scratch import scratch_root, written


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has key 1, many have no key, some keys have no lookup."""
    rng = random.Random(7)
    keys = [1] * 300 + [None] * 200 + [rng.randrange(2, 60) for _ in range(400)]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k INT, v INT")
    lookup = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(None, "none")], "k INT, text STRING")
    return left, lookup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_spreads_hot_keys(spark, how):
    """A third of the rows with one key, a third without a key: no task gets them all."""
    rows = [(1, i * 7919) for i in range(3000)] + [(None, i) for i in range(3000)] + [(2 + i % 900, i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k INT, v INT").repartition(40)
    lookup = spark.createDataFrame([(k, f"text {k}") for k in range(800)], "k INT, text STRING")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = lookup_join(left, lookup, ["k"], how)
        tasks = Counter((r.k, r.task) for r in joined.select("k", "v", F.spark_partition_id().alias("task")).collect() if r.k in (1, None))
        assert max(tasks.values()) < 2000 and len(tasks) >= (4 if how == "left" else 2)
        assert bag(joined) == bag(left.join(lookup, ["k"], how))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_join_with_repeated_lookup_rows(skewed):
    left, lookup = skewed
    twice = lookup.unionByName(lookup)
    assert bag(lookup_join(left, twice, ["k"])) == bag(left.join(twice, ["k"]))


def test_attach(skewed):
    left, lookup = skewed
    few = left.limit(5)
    assert attach(few, lookup, ["k"]).count() == 5
    assert bag(found_for(few, lookup, ["k"]).select("k", "text")) == [(1, "text 1")]


def test_top_k(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9), ("b", None)], "g STRING, v INT")
    order = [F.col("v").desc()]
    assert bag(top_k(df, 2, order)) == [("a", 3), ("b", 9)]
    assert bag(top_k(df, 1, order, ["g"])) == [("a", 3), ("b", 9)]
    assert bag(top_k(df, 2, order, ["g"], "n")) == [("a", 2, 2), ("a", 3, 1), ("b", 9, 1), ("b", None, 2)]


def test_rankings(spark):
    df = spark.createDataFrame([(1, 10), (2, 5), (3, 7)], "x INT, y INT")
    lists = rankings(df, 2, {"x": F.col("x"), "y": F.col("y")}, ["x"])
    assert bag(lists.select("report_name", "row_no", "x")) == [("x", 1, 3), ("x", 2, 2), ("y", 1, 1), ("y", 2, 3)]


@pytest.mark.parametrize("slices", [1, 3, 8])
@pytest.mark.parametrize("scope", [[], ["s"]])
def test_running_total(spark, slices, scope):
    rng = random.Random(slices)
    data = [(rng.choice("ab"), rng.randrange(5), i) for i in range(120)] + [("c", None, 500), ("c", 4, 501)]
    df = spark.createDataFrame(data, "s STRING, v INT, id INT")
    got = running_total(df, "v", [F.col("v").desc(), F.col("id")], scope, slices)
    expected = []
    for part in ({d[0] for d in data} if scope else [None]):
        members = sorted((d for d in data if part in (None, d[0])), key=lambda d: (-(d[1] if d[1] is not None else -1), d[2]))
        seen, total = 0, sum(d[1] or 0 for d in members)
        for d in members:
            expected.append((*d, seen, total))
            seen += d[1] or 0
    assert bag(got.select("s", "v", "id", "total_before", "grand_total")) == sorted(expected, key=repr)


def test_running_total_splits_equal_values(spark):
    df = spark.range(1000).select(F.lit(1).alias("v"), "id")
    got = running_total(df, "v", [F.col("v").desc(), F.col("id")], slices=8)
    assert bag(got.select("id", "total_before")) == [(i, i) for i in sorted(range(1000), key=lambda i: repr((i, i)))]


def test_written_tables_lie_in_the_shared_folder(spark):
    df = written(spark.range(3), "probe")
    assert df.count() == 3
    assert all(f.removeprefix("file://").startswith(scratch_root(spark).removeprefix("file://")) for f in df.inputFiles())
    assert written(spark.range(0), "probe").isEmpty()
