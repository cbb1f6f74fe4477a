"""All queries on panels and forecasts, and their DuckDB SQL."""

from tsforge.plans import forecast_queries, model_queries, panel_queries  # noqa: F401  (they register themselves)
from tsforge.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
