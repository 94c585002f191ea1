"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once inside an expression, so nested use does not repeat it."""
    return F.transform(F.array(value), body)[0]


def lookup(c: ColumnOrName, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Dictionary lookup; a missing key gives `default` (null unless set)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.create_map(*pairs)[col(c)] if pairs else F.lit(None)
    return hit if default is None else F.coalesce(hit, default)


def ladder(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered rules, first true one wins; a null condition counts as false."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    end = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return end if out is None else out.otherwise(end)


def true(cond: Column) -> Column:
    """Three-valued to two-valued logic: unknown is false."""
    return F.coalesce(cond, F.lit(False))


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Guarded ratio: null unless the denominator is positive."""
    return F.when(col(den) > 0, col(num) / col(den))
