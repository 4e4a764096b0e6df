"""Column helpers for text whose meaning differs between T-SQL and Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points above U+FFFF take two UTF-16 units; offsets in telemetry count units.
_TWO_UNITS = r"([\x{10000}-\x{10FFFF}])"
# A noncharacter, which stands for the second unit while positions are counted.
_FILLER = "\uffff"
#: Collected tables may hold the key of a name column beside it.
KEY_SUFFIX = "_key"


def fold(column: Column) -> Column:
    """Form for comparing under a case-insensitive server collation."""
    return F.lower(column)


def name_key(name: Column | str) -> Column:
    """Sort key of a name under the server's case-insensitive collation, which also ignores trailing blanks.

    Names are compared, grouped, joined and ordered by it, and shown as they are stored.
    """
    return F.lower(F.rtrim(F.lit(name) if isinstance(name, str) else name))


def key_of(table: DataFrame, column: str) -> Column:
    """The key of a name column: the collected ``<column>_key``, on which filters reach the scan, or else computed."""
    stored = f"{column}{KEY_SUFFIX}"
    return F.col(stored) if stored in table.columns else name_key(F.col(column))


def tsql_len(column: Column) -> Column:
    """LEN: characters without trailing spaces."""
    return F.length(F.rtrim(column))


def datalength(column: Column) -> Column:
    """DATALENGTH of nvarchar: bytes in UTF-16."""
    return F.octet_length(F.encode(column, "UTF-16LE"))


def tsql_substring(column: Column, start: Column, length: Column) -> Column:
    """SUBSTRING with 1-based ``start``; positions below 1 use up ``length``.

    A length that leaves nothing gives ``''``.
    """
    first = F.when(start < 1, F.lit(1)).otherwise(start)
    left = start + length - first
    count = F.when(left < 0, F.lit(0)).otherwise(left)
    return F.substring(column, first.cast("int"), count.cast("int"))


def truncate(column: Column, chars: int) -> Column:
    """Cast to a shorter nvarchar: the rest is cut off."""
    return F.left(column, F.lit(chars))


def quotename(column: Column) -> Column:
    """QUOTENAME, for names of any length."""
    return F.concat(F.lit("["), F.replace(column, F.lit("]"), F.lit("]]")), F.lit("]"))


def single_line(column: Column) -> Column:
    """Line feeds and carriage returns as spaces."""
    return F.replace(F.replace(column, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def kill_text(session_id: Column) -> Column:
    return F.concat(F.lit("Kill "), session_id.cast("string"))


def _in_units(text: Column, use) -> Column:
    """Apply ``use`` to the text with one character per UTF-16 unit."""
    padded = F.regexp_replace(text, _TWO_UNITS, "$1" + _FILLER)
    cut = F.replace(use(padded), F.lit(_FILLER), F.lit(""))
    return F.when(text.rlike(_TWO_UNITS), cut).otherwise(use(text))


# name: (text starts at 1 + start/2 rather than start/2, one more character, end where the offset is open)
SLICE_VARIANTS = {
    "inclusive": (True, True, "len"),
    "exclusive": (True, False, "len"),
    "zero_based": (False, False, "fixed"),
    "zero_based_bytes": (False, False, "datalength"),
}


def statement_slice(text: Column, start: Column, end: Column, variant: str = "inclusive", open_end: int | None = None) -> Column:
    """Cut the running statement out of its batch by UTF-16 byte offsets.

    ``inclusive``         1 + start/2, (end - start)/2 + 1 characters, open end at LEN
    ``exclusive``         1 + start/2, (end - start)/2 characters, open end at LEN
    ``zero_based``        start/2, (end - start)/2 characters, open end at ``open_end`` bytes, by default the end of the text
    ``zero_based_bytes``  start/2, (end - start)/2 characters, open end at DATALENGTH
    """
    one_based, one_more, open_rule = SLICE_VARIANTS[variant]

    def cut(batch: Column) -> Column:
        if open_rule == "fixed":
            # Positions count from zero, so the last character ends one further.
            whole = (F.length(batch) + 1) * 2 if open_end is None else F.lit(open_end)
            until = F.when(end < 0, whole).otherwise(end)
        elif open_rule == "len":
            until = F.when(end == -1, tsql_len(batch) * 2).otherwise(end)
        else:
            until = F.when(end == -1, F.length(batch) * 2).otherwise(end)
        span = F.call_function("div", until - start, F.lit(2))
        position = F.call_function("div", start, F.lit(2))
        return tsql_substring(batch, position + int(one_based), span + int(one_more))

    return _in_units(text, cut)
