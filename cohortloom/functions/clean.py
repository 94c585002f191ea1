"""Typing of scraped strings. Nothing here raises on bad input: bad becomes null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ColumnOrName, col

_NUMBER = r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: ColumnOrName) -> Column:
    """'1,234', '$9,757,440', '.442', '+8.6', '45%' to double."""
    s = F.regexp_replace(F.trim(col(c)), r"[,$%+]", "")
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def parse_numbers(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """parse_number over the columns that exist."""
    return df.withColumns({c: parse_number(c) for c in cols if c in df.columns})


def feet_inches(c: ColumnOrName) -> Column:
    """'6-9' to 81."""
    a = F.regexp_extract(col(c), r"^(\d+)-(\d+)$", 1).try_cast("double")
    b = F.regexp_extract(col(c), r"^(\d+)-(\d+)$", 2).try_cast("double")
    return a * 12 + b


def end_year(c: ColumnOrName) -> Column:
    """'2018-19' to 2019, '1999-00' to 2000."""
    return F.substring(col(c), 1, 4).try_cast("int") + 1


def span_label(end: ColumnOrName) -> Column:
    """2020 to '2019-20'."""
    e = col(end).cast("int")
    return F.format_string("%d-%02d", e - 1, F.pmod(e, F.lit(100)))


def blank_to_null(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.replace("", None, subset=strings) if strings else df


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def marker(c: ColumnOrName, mark: str = "*") -> Column:
    """Does a trailing mark flag this value?"""
    return F.endswith(F.trim(col(c)), F.lit(mark))


def strip_marker(c: ColumnOrName, mark: str = "*") -> Column:
    return F.rtrim(F.trim(col(c)), F.lit(mark))


def strip_suffix(c: ColumnOrName, suffix: str) -> Column:
    return F.regexp_replace(col(c), r"\s*" + suffix + "$", "")


def id_from_link(c: ColumnOrName, pattern: str) -> Column:
    """First group of `pattern` in a link, null when absent."""
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))


def parse_date(c: ColumnOrName, fmt: str = "MMMM d, yyyy") -> Column:
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("date")


def drop_placeholder_date(c: ColumnOrName, month: int = 10, day: int = 15) -> Column:
    """Dates on the placeholder day mean unknown."""
    d = col(c)
    return F.when(~((F.month(d) == month) & (F.dayofmonth(d) == day)), d)


def guard_id(c: ColumnOrName, lo: int = 1, hi: int = 10**8) -> Column:
    """Ids outside the valid range are nulled, the row stays."""
    return F.when(col(c).between(lo, hi), col(c))


def trailing_parenthesis(c: ColumnOrName) -> Column:
    """'Club (Spain)' to 'Spain'; two capitals are a state, not a country."""
    inner = F.nullif(F.regexp_extract(col(c), r"\(([^()]+)\)\s*$", 1), F.lit(""))
    return F.when(~inner.rlike(r"^[A-Z]{2}$"), inner)


def suffix_columns(df: DataFrame, suffix: str = "", prefix: str = "", keep: Iterable[str] = ()) -> DataFrame:
    """Add a prefix or suffix to every column that is not a key."""
    kept = set(keep)
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in kept})


def select_known(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep and rename the columns of `mapping`; an absent one becomes null."""
    return df.select(
        *[
            (F.col(src) if src in df.columns else F.lit(None).cast("string")).alias(dst)
            for src, dst in mapping.items()
        ]
    )
