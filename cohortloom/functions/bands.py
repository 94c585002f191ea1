"""Bands, steps and ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ColumnOrName, col, ladder

# Slot bands, inclusive.
SLOT_BANDS = [(1, 5, "Picks 1-5"), (6, 14, "Picks 6-14"), (15, 30, "Picks 15-30"), (31, 60, "Picks 31-60")]

# Recruiting groups, right-closed edges.
RECRUIT_EDGES = [0, 10, 25, 50, 100]
RECRUIT_GROUPS = ["RSCI 1-10", "RSCI 11-25", "RSCI 26-50", "RSCI 51-100"]

# Outcome tiers from low to high, and honours above them.
TIERS = ["Out of league", "Bust", "Rotation", "Starter", "All-Star", "All-NBA"]
HONOURS = ["Superstar", "MVP", "Legend"]
STAR_TIERS = ["All-Star", "All-NBA", "Superstar", "MVP", "Legend"]
STARTER_TIERS = ["Starter", *STAR_TIERS]


def band(
    c: ColumnOrName, edges: list[float], labels: list[str], include_lowest: bool = False
) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; outside or null gives null."""
    x = col(c)
    rules = []
    for i, label in enumerate(labels):
        low = x >= edges[i] if include_lowest and i == 0 else x > edges[i]
        rules.append((low & (x <= edges[i + 1]), label))
    return ladder(rules)


def inclusive_band(c: ColumnOrName, spans: list[tuple[float, float, str]]) -> Column:
    return ladder([(col(c).between(lo, hi), label) for lo, hi, label in spans])


def slot_band(c: ColumnOrName) -> Column:
    return inclusive_band(c, SLOT_BANDS)


def recruit_group(rank: ColumnOrName) -> Column:
    return F.coalesce(band(rank, RECRUIT_EDGES, RECRUIT_GROUPS), F.lit("Unranked"))


def bin_index(c: ColumnOrName, cuts: Column, right_closed: bool = False) -> Column:
    """How many cuts lie at or below the value (strictly below when right_closed)."""
    x = col(c)
    return F.size(F.filter(cuts, lambda cut: (cut < x) if right_closed else (cut <= x)))


def digitize(c: ColumnOrName, cuts: list[float], right_closed: bool = False) -> Column:
    return bin_index(c, F.array(*[F.lit(float(v)) for v in cuts]), right_closed)


def step(c: ColumnOrName, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """Value of the first step whose upper bound is not below the input."""
    return ladder([(col(c) <= upper, value) for upper, value in steps], otherwise)


def tier_name(idx: ColumnOrName, names: list[str] = TIERS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), col(idx).cast("int") + 1)


def honour(all_league: Column, first_team: Column, mvps: Column, finals: Column) -> Column:
    """Highest honour earned so far."""
    return ladder(
        [
            ((mvps >= 2) | (finals >= 2) | (all_league >= 10), "Legend"),
            (mvps >= 1, "MVP"),
            (first_team >= 2, "Superstar"),
        ]
    )


def role_anchor(
    all_league: Column, star: Column, best_starts: Column, best_minutes: Column, minutes: Column
) -> Column:
    """0-5 role from awards and playing time, never from value."""
    return ladder(
        [
            (all_league > 0, 5),
            (star > 0, 4),
            ((best_starts >= 41) & (best_minutes >= 1800), 3),
            (best_minutes >= 1000, 2),
            (minutes >= 1000, 1),
        ],
        0,
    )


def career_status(n: ColumnOrName, retired: ColumnOrName, final_n: int = 8) -> Column:
    n, r = col(n), col(retired)
    return ladder(
        [
            (r & (n > 0), "Career Grade (retired)"),
            (n == 0, "Projection"),
            (n == 1, "Provisional (low confidence)"),
            (n <= 3, "Provisional (medium confidence)"),
            (n < final_n, "Year-4 Verdict"),
        ],
        "Career Grade",
    )


def equivalent_label(slot: ColumnOrName) -> Column:
    s = col(slot)
    return ladder(
        [(s.isNull(), "no NBA value"), (s <= 1, "#1 or better")],
        F.concat(F.lit("#"), s.cast("int").cast("string")),
    )
