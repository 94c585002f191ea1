"""Coordinates in feet from the basket, zones and shot kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import step
from .common import ColumnOrName, col, ladder, true

# Feet.
REFERENCE_LINE = 22.146
CORNER_LINE = 22.0
STANDARD_PRO_LINE = 23.75
INCONSISTENT = 2.0
CORNER_DX = 20.0
CORNER_DY = 8.0
ZONES = ["rim", "short_mid", "long_mid", "corner_three", "above_break_three"]
GRID_X = (0, 25)
GRID_Y = (-4, 30)


def college_line(season: ColumnOrName) -> Column:
    return step(season, [(2008, 19.75), (2019, 20.75)], REFERENCE_LINE)


def pro_line(season: ColumnOrName) -> Column:
    return F.when(col(season).between(1995, 1997), 22.0).otherwise(STANDARD_PRO_LINE)


def college_xy(x: ColumnOrName, y: ColumnOrName) -> dict[str, Column]:
    """Court feet to feet from the basket (basket at x = 25, y = 1)."""
    return {"dx": col(x) - 25.0, "dy": col(y) - 1.0}


def pro_xy(x: ColumnOrName, y: ColumnOrName) -> dict[str, Column]:
    """Tenths of feet to feet."""
    return {"dx": col(x) / 10.0, "dy": col(y) / 10.0}


def contradicts(dist: ColumnOrName, dx: ColumnOrName, is_three: ColumnOrName, line: ColumnOrName,
                corner_line: float | None = None) -> Column:
    """Coordinates that contradict the shot's value: a three well inside its line, a two well outside."""
    d, three, arc = col(dist), col(is_three), col(line)
    used = arc if corner_line is None else F.when(F.abs(col(dx)) >= corner_line - 0.5, corner_line).otherwise(arc)
    return true((three & (d < used - INCONSISTENT)) | (~three & (d > used + INCONSISTENT)))


def zone(dist: ColumnOrName, dx: ColumnOrName, dy: ColumnOrName, is_three: ColumnOrName) -> Column:
    d, three = col(dist), col(is_three)
    return ladder(
        [
            (~three & (d < 4), "rim"),
            (~three & (d < 14), "short_mid"),
            (~three & (d >= 14), "long_mid"),
            (three & (F.abs(col(dx)) >= CORNER_DX) & (col(dy) <= CORNER_DY), "corner_three"),
            (three & d.isNotNull(), "above_break_three"),
        ]
    )


def cell_zone(x: Column, y: Column, line: float = REFERENCE_LINE) -> Column:
    """Zone of a map cell: by distance alone, a cell is a three from the line outward."""
    d = F.hypot(x, y)
    return ladder(
        [
            ((d >= line - 0.5) & (x >= CORNER_DX) & (y <= CORNER_DY), "corner_three"),
            (d >= line - 0.5, "above_break_three"),
            (d < 4, "rim"),
            (d < 14, "short_mid"),
        ],
        "long_mid",
    )


def shot_kind(kind: ColumnOrName, text: ColumnOrName, score: ColumnOrName) -> Column:
    """Priority matters: a tip dunk is a dunk, a three-point jumper a three."""
    t = F.lower(F.concat_ws(" ", F.coalesce(col(kind), F.lit("")), F.coalesce(col(text), F.lit(""))))
    return ladder(
        [
            (t.contains("dunk"), "dunk"),
            (t.contains("tip"), "tip"),
            (t.contains("layup") | t.contains("lay up"), "layup"),
            (true(t.contains("three") | t.contains("3-pt")) | true(col(score) == 3), "three"),
            (t.contains("jump"), "jumper"),
        ],
        "unknown",
    )
