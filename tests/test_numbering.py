"""Row numbers over whole tables against a plain window, and their plan."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from registered import QUERIES
from servertide.operators.numbering import row_numbers


def numbered(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("scope", [[], ["s"]])
@pytest.mark.parametrize("slices", [1, 3, 8])
def test_against_a_plain_window(spark, scope, slices):
    """Few values, so that rows of equal value fall into several slices; nulls in the scope and in the order."""
    df = spark.range(500).selectExpr("CASE id % 3 WHEN 0 THEN NULL ELSE id % 3 END AS s", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 2 END AS v", "id")
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    plain = Window.partitionBy(*scope, F.lit(1)).orderBy(*order)
    want = numbered(df.withColumn("n", F.row_number().over(plain).cast("long")), ["id", "n"])
    assert numbered(row_numbers(df, order, scope, "n", slices), ["id", "n"]) == want


def test_empty(spark):
    assert row_numbers(spark.range(0), [F.col("id")]).collect() == []


@pytest.mark.parametrize("name", ["ranked_waits", "ranked_waits_by_server", "ranked_statements"])
def test_no_single_task(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RowNumber" in plan.replace("row_number", "RowNumber")
