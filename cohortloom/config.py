"""Settings with the checks that keep cohort ranges ordered and disjoint."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CohortRanges:
    """Inclusive cohort ranges: training, then in progress, then live."""

    training: tuple[int, int]
    in_progress: tuple[int, int]
    live: tuple[int, int]

    def __post_init__(self) -> None:
        spans = (self.training, self.in_progress, self.live)
        if any(lo > hi for lo, hi in spans):
            raise ValueError(f"a cohort range starts after it ends: {spans}")
        if any(a[1] >= b[0] for a, b in zip(spans, spans[1:])):
            raise ValueError(f"cohort ranges overlap or are out of order: {spans}")

    def years(self) -> list[int]:
        return [y for lo, hi in (self.training, self.in_progress, self.live) for y in range(lo, hi + 1)]


@dataclass(frozen=True)
class Settings:
    """What a pipeline run needs to know; column bindings are passed to operators."""

    cohorts: CohortRanges
    last_complete_period: int
    horizon: int = 6
    final_n: int = 8
    neighbours: int = 60
    calib_cohorts: int = 3
    min_fit_cohorts: int = 4
    min_training: int = 100

    def __post_init__(self) -> None:
        if self.horizon < 1 or self.final_n < 2:
            raise ValueError("horizon must be >= 1 and final_n >= 2")
