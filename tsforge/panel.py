"""Panels: long frames of (unique_id, ds, values), their invariants, slices and grids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tsforge.spec import KEYS, PanelError, PanelSpec


def by_series() -> WindowSpec:
    """A series in the order of time."""
    return Window.partitionBy("unique_id").orderBy("ds")
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def seconds(ds: str | Column = "ds") -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    c = F.col(ds) if isinstance(ds, str) else ds
    return F.timestamp_diff("SECOND", F.expr(EPOCH), c)


def at_seconds(s: Column) -> Column:
    return (F.expr(EPOCH) + F.make_dt_interval(secs=s)).cast("timestamp_ntz")


def missing(c: str | Column) -> Column:
    """The value, or null where it isn't a finite number."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    spec: PanelSpec
    static: DataFrame | None = None

    def slice(self, start, end) -> Panel:
        """Both ends included; statics keep the series that are left."""
        if start > end:
            raise PanelError("the slice ends before it starts")
        df = self.df.where(F.col("ds").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        static = self.static and self.static.join(df.select("unique_id").distinct(), "unique_id", "left_semi")
        return Panel(df, self.spec, static)

    def select_ids(self, ids: list[str]) -> Panel:
        return Panel(self.df.where(F.col("unique_id").isin(ids)), self.spec, self.static)

    def ids(self) -> DataFrame:
        return self.df.select("unique_id").distinct()

    def span(self) -> DataFrame:
        return self.df.agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))

    def grid(self) -> DataFrame:
        """All instants from the first to the last of any series."""
        step = F.expr(f"INTERVAL {self.spec.step} SECONDS")
        return self.span().select(F.explode(F.sequence("first_ds", "last_ds", step)).alias("ds"))

    def futr(self, start, end) -> DataFrame:
        """What is known ahead over a window: keys and future columns, nothing else."""
        return self.slice(start, end).df.select(*KEYS, *self.spec.futr_exog)

    def futr_of(self, window, ids: list[str], h: int) -> DataFrame:
        """The same for some series and a row of the windows table; all their steps must be there."""
        rows = self.select_ids(ids).futr(window["first_pred"], window["last_pred"])
        if (n := rows.count()) != len(ids) * h:
            raise PanelError(f"{n} rows, not {len(ids)} series of {h} steps")
        return rows

    def long(self) -> DataFrame:
        """The columns of the spec in their order."""
        return self.df.select(*self.spec.columns)


def violations(df: DataFrame, spec: PanelSpec, static: DataFrame | None = None) -> DataFrame:
    """One row for each broken invariant, with how many series or rows break it."""
    if set(df.columns) != set(spec.columns):
        return df.sparkSession.createDataFrame([("columns", len(set(df.columns) ^ set(spec.columns)))], "rule string, n long")
    if dict(df.dtypes)["ds"] != "timestamp_ntz":
        return df.sparkSession.createDataFrame([("naive_ds", 1)], "rule string, n long")
    per = df.groupBy("unique_id").agg(
        F.count("*").alias("n"), F.count_distinct("ds").alias("n_ds"), F.count(missing(spec.target)).alias("n_y"),
        (F.timestamp_diff("SECOND", F.min("ds"), F.max("ds")) / spec.step + 1).alias("expected"),
    )
    rules = {
        "null_key": F.count_if(F.col("unique_id").isNull()), "unique_key": F.count_if(F.col("n") != F.col("n_ds")),
        "complete_grid": F.count_if(F.col("n_ds") != F.col("expected")), "min_history": F.count_if(F.col("n_y") < max(spec.seasonalities) + 1),
    }
    wide = per.agg(*(c.cast("long").alias(k) for k, c in rules.items()))
    long = wide.unpivot([], list(rules), "rule", "n").where("n > 0")
    if static is not None:
        twice = static.groupBy("unique_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("one_static_row").alias("rule"), "n").where("n > 0")
        long = long.unionByName(twice)
    return long


def build_panel(df: DataFrame, spec: PanelSpec, static: DataFrame | None = None) -> Panel:
    """A checked panel: values as float, non-finite numbers as null."""
    broken = violations(df, spec, static).collect()
    if broken:
        raise PanelError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))
    return Panel(df.select(*KEYS, *(missing(c).cast("float").alias(c) for c in spec.value_columns)), spec, static)
