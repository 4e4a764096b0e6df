"""Column helpers for sizes and exact decimal results."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGES_PER_MB = 128  # 8 KB pages
WIDE = "decimal(38,0)"


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def pages_to_kb(pages: Column) -> Column:
    return pages.cast("long") * 8


def pages_to_whole_mb(pages: Column) -> Column:
    return div(pages_to_kb(pages), 1024)


def rounded_ratio(numerator: Column, denominator: Column | int, precision: int, scale: int) -> Column:
    """``numerator / denominator`` of integers, rounded half up once, as DECIMAL(precision, scale); NULL for a zero denominator.

    Plain decimal division would round twice (at Spark's own scale, then at ours).
    """
    bottom = denominator if isinstance(denominator, Column) else F.lit(denominator)
    bottom = F.nullif(bottom.cast(WIDE), F.lit(0).cast(WIDE))
    top = numerator.cast(WIDE) * F.lit(10**scale).cast(WIDE) * 2
    half = F.when((numerator < 0) != (bottom < 0), -bottom).otherwise(bottom)
    scaled = F.call_function("div", top + half, bottom * 2)
    return (scaled.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")


def truncated_ratio(numerator: Column, denominator: Column, precision: int, scale: int) -> Column:
    """``numerator / denominator`` of integers cut off after ``scale`` digits; NULL for a zero denominator."""
    top = numerator.cast(WIDE) * F.lit(10**scale).cast(WIDE)
    scaled = F.call_function("div", top, F.nullif(denominator.cast(WIDE), F.lit(0).cast(WIDE)))
    return (scaled.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")


def pages_to_mb(pages: Column, precision: int = 36, scale: int = 2) -> Column:
    return rounded_ratio(pages.cast("long"), PAGES_PER_MB, precision, scale)
