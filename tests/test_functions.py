"""Column helpers on edge values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from servertide.functions import numbers, text, times


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("start, length, expected", [
    (1, 3, "abc"), (0, 3, "ab"), (-1, 3, "a"), (0, 0, ""), (0, 1, ""), (2, 100, "bcdef"), (7, 2, ""), (3, -1, ""),
])
def test_substring(spark, start, length, expected):
    assert value(spark, text.tsql_substring(F.lit("abcdef"), F.lit(start), F.lit(length))) == expected


def test_substring_of_null(spark):
    assert value(spark, text.tsql_substring(F.lit(None).cast("string"), F.lit(1), F.lit(2))) is None
    assert value(spark, text.tsql_substring(F.lit("ab"), F.lit(1), F.lit(None).cast("int"))) is None


def test_lengths(spark):
    assert value(spark, text.tsql_len(F.lit("ab  "))) == 2
    assert value(spark, text.tsql_len(F.lit(" ab"))) == 3
    assert value(spark, text.datalength(F.lit("ab  "))) == 8
    assert value(spark, text.datalength(F.lit("é😀"))) == 6


def test_names_and_lines(spark):
    assert value(spark, text.quotename(F.lit("a]b"))) == "[a]]b]"
    assert value(spark, text.quotename(F.lit("x" * 130))) == "[" + "x" * 130 + "]"
    assert value(spark, text.single_line(F.lit("a\r\nb\nc"))) == "a  b c"


@pytest.mark.parametrize("variant, start, end, expected", [
    ("inclusive", 0, -1, "select 1; select 2 "),  # LEN is 18, one more character
    ("inclusive", 20, 34, "select 2"),
    ("inclusive", 20, -1, "select 2 "),
    ("exclusive", 20, 36, "select 2"),
    ("exclusive", 0, -1, "select 1; select 2"),
    ("exclusive", 20, 400, "select 2  "),
    ("zero_based", 0, 16, "select "),
    ("zero_based", 22, 38, "select 2"),
    ("zero_based", 22, -1, "select 2  "),
    ("zero_based_bytes", 22, -1, "select 2 "),
    ("zero_based_bytes", 0, 16, "select "),
])
def test_slice(spark, variant, start, end, expected):
    batch = "select 1; select 2  "
    assert value(spark, text.statement_slice(F.lit(batch), F.lit(start), F.lit(end), variant)) == expected


def test_slice_of_null(spark):
    for variant in text.SLICE_VARIANTS:
        assert value(spark, text.statement_slice(F.lit(None).cast("string"), F.lit(0), F.lit(-1), variant)) is None


def test_slice_counts_utf16_units(spark):
    batch = "/*😀😀*/select 1"  # 8 units before the statement
    assert value(spark, text.statement_slice(F.lit(batch), F.lit(16), F.lit(32), "exclusive")) == "select 1"
    assert value(spark, text.statement_slice(F.lit(batch), F.lit(16), F.lit(-1), "exclusive")) == "select 1"
    assert value(spark, text.statement_slice(F.lit(batch), F.lit(0), F.lit(8), "exclusive")) == "/*😀"


@pytest.mark.parametrize("n, d, scale, expected", [
    (1, 8, 2, "0.13"), (-1, 8, 2, "-0.13"), (1, 3, 4, "0.3333"), (2, 3, 4, "0.6667"), (0, 5, 2, "0.00"),
    # 0.00499999999999999999 is not 0.005
    (499999999999999999, 100000000000000000000 // 1000, 2, "5.00"), (49999999999999999, 10**19 // 1000, 2, "5.00"),
])
def test_rounded_ratio(spark, n, d, scale, expected):
    assert value(spark, numbers.rounded_ratio(F.lit(n).cast("long"), F.lit(d).cast("long"), 20, scale)) == Decimal(expected)


def test_rounded_once(spark):
    # Rounding at 14 digits first would give 0.01.
    n, d = 4999999999999999, 10**18
    assert value(spark, numbers.rounded_ratio(F.lit(n).cast("long"), F.lit(d).cast("long"), 20, 2)) == Decimal("0.00")


def test_truncated_ratio(spark):
    assert value(spark, numbers.truncated_ratio(F.lit(2), F.lit(3), 19, 10)) == Decimal("0.6666666666")


def test_page_sizes(spark):
    assert value(spark, numbers.pages_to_whole_mb(F.lit(2**31 - 1))) == (2**31 - 1) * 8 // 1024
    assert value(spark, numbers.pages_to_mb(F.lit(1))) == Decimal("0.01")


def test_times(spark):
    late, early = times.instant("2024-01-01 23:59:00"), times.instant("2024-01-02 00:01:00")
    assert value(spark, times.days_between(late, early)) == 1
    assert value(spark, times.seconds_between(times.instant("2024-01-01 00:00:00.900"), times.instant("2024-01-01 00:00:01.100"))) == 1
    assert value(spark, times.day_first(late)) == "01/01/2024 23:59:00"
    assert value(spark, times.duration_text(F.lit(7384))) == "2 hour(s), 3min, 4 sec"
    assert str(value(spark, times.plus_seconds(late, F.lit(61)))) == "2024-01-02 00:00:01"
