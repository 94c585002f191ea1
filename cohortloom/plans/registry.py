"""Query registry: a Spark plan, and the SQL a second engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import size_files
from .bindings import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, list[str]]] = {}


def _places(rnd: str, default: int) -> list[tuple[str, int]]:
    """'x y:11' to column and decimal places."""
    parts = [token.partition(":") for token in rnd.split()]
    return [(name, int(n) if n else default) for name, _, n in parts]


def query(name: str, sql: str | None = None, ctes: str = "", rnd: str = "", ints: str = "", places: int = 9):
    """Register a plan under `name`.

    `rnd` and `ints` list the columns both sides round or cast, so two engines that add in a
    different order still print the same table.
    """

    def register(plan: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size_files(spark)
            df = plan(Tables(spark, sf_dir))
            cols = {c: F.round(F.col(c).cast("double"), n) + F.lit(0.0) for c, n in _places(rnd, places)}
            cols.update({c: F.col(c).cast("bigint") for c in ints.split()})
            return df.withColumns(cols) if cols else df

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            fixed = [f"round(CAST({c} AS DOUBLE), {n}) + 0.0 AS {c}" for c, n in _places(rnd, places)]
            fixed += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            body = f"SELECT * REPLACE ({', '.join(fixed)}) FROM ({sql})" if fixed else sql
            _SQL[name] = (body, ctes.split())
        return plan

    return register


def oracles() -> dict[str, str]:
    """SQL per query, with the CTEs it needs."""
    return {name: with_ctes(body, ctes) for name, (body, ctes) in _SQL.items()}
