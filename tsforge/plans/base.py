"""Registry of the queries and the SQL fragments that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    """Floating-point columns rounded, so that two engines' orders of summation agree."""
    def fit(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.round(c.cast("double"), places).alias(name) if kind in ("double", "float") else c

    return df.select(*(fit(n, t) for n, t in df.dtypes))


EVT = """
evt_cells AS (SELECT event_type AS unique_id, date_trunc('hour', ts)::TIMESTAMP AS ds, count(*)::DOUBLE AS y FROM events GROUP BY ALL),
evt_span AS (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM evt_cells GROUP BY unique_id),
evt_grid AS (SELECT unique_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ds FROM evt_span),
evt AS (SELECT g.unique_id, g.ds::TIMESTAMP AS ds, c.y FROM evt_grid g LEFT JOIN evt_cells c USING (unique_id, ds))"""

SHIP = """
ship_cells AS (SELECT l_returnflag AS unique_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ds, sum(l_quantity)::DOUBLE AS y FROM lineitem GROUP BY ALL),
ship_span AS (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM ship_cells GROUP BY unique_id),
ship_grid AS (SELECT unique_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds FROM ship_span),
ship AS (SELECT g.unique_id, g.ds::TIMESTAMP AS ds, c.y FROM ship_grid g LEFT JOIN ship_cells c USING (unique_id, ds))"""
