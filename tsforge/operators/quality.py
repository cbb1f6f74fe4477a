"""Data quality: duplicates, zeros, outliers, coverage, schema rules, clock changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.panel import missing


def duplicates(df: DataFrame) -> DataFrame:
    """Every row whose (unique_id, ds) occurs more than once."""
    seen = F.count("*").over(Window.partitionBy("unique_id", "ds"))
    return df.withColumn("_n", seen).where("_n > 1").drop("_n")


def zeros(df: DataFrame, value: str = "y") -> DataFrame:
    return df.where(F.col(value) == 0)


def outliers(df: DataFrame, *, value: str = "y", threshold: float = 4.0) -> DataFrame:
    """Rows with a robust z over the threshold, by median and median absolute deviation."""
    x, by = missing(value), Window.partitionBy("unique_id")
    centred = df.withColumn("_x", x).withColumn("_m", F.median("_x").over(by)).withColumn("_d", F.median(F.abs(F.col("_x") - F.col("_m"))).over(by))
    z = F.when(F.col("_d") > 0, (F.col("_x") - F.col("_m")) / (1.4826 * F.col("_d"))).otherwise(F.when(F.col("_x").isNotNull(), 0.0))
    return centred.withColumn("robust_z", z).where(F.abs("robust_z") > threshold).drop("_x", "_m", "_d")


def coverage(raw: DataFrame, aligned: DataFrame, *, step_seconds: int, value: str = "y", threshold: float = 4.0) -> DataFrame:
    per_key = raw.groupBy("unique_id", "ds").count()
    first = per_key.groupBy("unique_id").agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.sum("count").alias("n_raw"), F.sum(F.col("count") - 1).alias("n_duplicates")
    )
    second = aligned.groupBy("unique_id").agg(
        F.count("*").alias("n_aligned"), F.count_if(F.col(value).isNull()).alias("n_gaps"), F.count_if(F.col(value) == 0).alias("n_zeros")
    )
    third = outliers(aligned, value=value, threshold=threshold).groupBy("unique_id").agg(F.count("*").alias("n_outliers"))
    out = first.join(second, "unique_id", "left").join(third, "unique_id", "left").na.fill(0)
    expected = (F.timestamp_diff("SECOND", "first_ds", "last_ds") / step_seconds + 1).cast("long")
    return out.withColumn("n_expected", expected).withColumn("coverage", (F.col("n_aligned") - F.col("n_gaps")) / F.col("n_expected"))


def hourly_step(aligned: DataFrame) -> float:
    """The median distance in hours between a row and the next of its series, over the first
    series; 1.0 where there is none."""
    first = aligned.agg(F.min("unique_id")).first()[0]
    gap = F.timestamp_diff("SECOND", F.lag("ds").over(Window.partitionBy("unique_id").orderBy("ds")), "ds") / 3600
    found = aligned.where(F.col("unique_id") == first).select(gap.alias("gap")).agg(F.median("gap")).first()[0]
    return 1.0 if found is None else float(found)


def raw_schema(df: DataFrame, values: dict[str, tuple[float | None, float | None]], *, coerce: bool = True) -> tuple[DataFrame, DataFrame]:
    """A closed schema: unique_id, ds and ``values`` with their bounds, nothing else. Returns the
    rows in it (what can't be read as its type is null) and (rule, n_violations), one row for each
    rule that is broken; columns that lack or are too many make the only rule then."""
    wanted = {"unique_id": "string", "ds": "timestamp_ntz", **dict.fromkeys(values, "double")}
    if odd := set(df.columns) ^ set(wanted):
        return df, df.sparkSession.createDataFrame([(f"columns: {', '.join(sorted(odd))}", len(odd))], "rule string, n_violations long")
    kinds = dict(df.dtypes)
    cast = df.select(*(F.col(c).try_cast(k).alias(c) if coerce else F.col(c) for c, k in wanted.items()))
    both = df.select(*(F.col(c).isNotNull().alias(f"_{c}") for c in wanted), *(F.col(c).try_cast(k).alias(c) for c, k in wanted.items()))
    order = Window.partitionBy("unique_id").orderBy("ds")
    both = both.withColumn("_again", F.lag("ds").over(order) == F.col("ds"))
    rules = {f"{c} is {k}": ~F.col(f"_{c}") | F.col(c).isNotNull() for c, k in wanted.items()}
    rules |= {"unique_id is known": F.col("unique_id").isNotNull(), "ds is known": F.col("ds").isNotNull(), "one row for each series and ds": ~F.coalesce("_again", F.lit(False))}
    for c, (low, high) in values.items():
        inside = F.lit(True)
        for bound, holds in ((low, F.col(c) >= low if low is not None else None), (high, F.col(c) <= high if high is not None else None)):
            inside = inside if bound is None else inside & holds
        rules[f"{c} lies within its bounds"] = F.col(c).isNull() | inside
    found = rule_violations(both, rules).where("n_violations > 0")
    if not coerce:
        wrong = [(f"{c} is {k}", 1) for c, k in wanted.items() if kinds[c] != k]
        found = found.unionByName(df.sparkSession.createDataFrame(wrong, "rule string, n_violations long")).groupBy("rule").agg(F.max("n_violations").alias("n_violations"))
    return cast, found


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the rows: how many break each rule (a condition that should hold)."""
    wide = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return wide.unpivot([], list(rules), "rule", "n_violations")


def not_increasing(df: DataFrame, *, seq: str) -> DataFrame:
    """Rows whose ds isn't later than the one that arrived before in their series."""
    before = F.lag("ds").over(Window.partitionBy("unique_id").orderBy(seq))
    return df.withColumn("_b", before).where("_b >= ds").drop("_b")


def clock_changes(raw: DataFrame, aligned: DataFrame, transitions: DataFrame, *, value: str = "y", tz: str = "UTC") -> DataFrame:
    """For each ``transition`` (UTC): raw rows of that local day; duplicates and nulls within three
    hours in the aligned frame. Transitions are two rows a year."""
    t = F.broadcast(transitions.select("transition"))
    day = F.to_date(F.from_utc_timestamp("transition", tz))
    n_raw = raw.join(t, F.to_date(F.from_utc_timestamp("ds", tz)) == day).groupBy("transition").agg(F.count("*").alias("n_raw"))
    near = (F.col("ds") >= F.col("transition") - F.expr("INTERVAL 3 HOURS")) & (F.col("ds") <= F.col("transition") + F.expr("INTERVAL 3 HOURS"))
    keys = aligned.join(t, near).groupBy("transition", "unique_id", "ds").agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"))
    rest = keys.groupBy("transition").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_duplicates"), F.sum("nulls").alias("n_nulls"))
    return transitions.select("transition").join(n_raw, "transition", "left").join(rest, "transition", "left").na.fill(0)
