"""How queries and their SQL are registered: one list of columns serves either side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Views = Callable[[str], DataFrame]


def query(name: str, columns: str, sql: str | None = None, digits: int = 6) -> Callable:
    """Registers a function of the views. columns: names to return; ~name is rounded to `digits`, #name is a bigint."""
    names = columns.split()

    def put(f: Callable[[Views], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda v: view(spark, sf_dir, v))
            kinds = {"~": lambda c: F.round(F.col(c).cast("double"), digits) + 0.0, "#": lambda c: F.col(c).cast("bigint")}
            return df.select(*[kinds[c[0]](c[1:]).alias(c[1:]) if c[0] in kinds else F.col(c) for c in names])

        QUERIES[name] = run
        if sql is not None:
            kinds = {"~": f'round(CAST("{{0}}" AS DOUBLE), {digits}) + 0e0 AS "{{0}}"', "#": 'CAST("{0}" AS BIGINT) AS "{0}"'}
            ORACLES[name] = f"SELECT {', '.join(kinds[c[0]].format(c[1:]) if c[0] in kinds else f'"{c}"' for c in names)} FROM ({with_views(sql)}) AS result"
        return f

    return put
