"""Forecast comparison tests and p-value adjustment."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def loss_differences(forecasts: DataFrame, *, loss: str = "abs") -> DataFrame:
    """Each pair of models, rows aligned on series, window and instant. Models are few: a row is
    joined with those of the same key alone."""
    e = F.col("y") - F.col("y_hat")
    rows = forecasts.select("unique_id", "window_id", "ds", "model_id", (F.abs(e) if loss == "abs" else e * e).alias("l")).where("l is not null")
    key = ["unique_id", "window_id", "ds"]
    a, b = (rows.withColumnsRenamed({"model_id": f"model_{s}", "l": f"l_{s}"}) for s in "ab")
    return a.join(b, key).where("model_a < model_b").select(*key, "model_a", "model_b", (F.col("l_a") - F.col("l_b")).alias("d"))


def pairwise_dm(forecasts: DataFrame, *, loss: str = "abs", hac_lag: int = 0, hln: bool = True, by_series: bool = False) -> DataFrame:
    """The Diebold-Mariano statistic of each pair with a Bartlett long-run variance."""
    by = ["model_a", "model_b", *(["unique_id"] if by_series else [])]
    rows = loss_differences(forecasts, loss=loss)
    means = rows.groupBy(*by).agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    centred = rows.join(F.broadcast(means), by).withColumn("c", F.col("d") - F.col("mean"))
    order = Window.partitionBy(*by).orderBy("unique_id", "window_id", "ds")
    products = [F.sum(F.col("c") * F.col("c")).alias("g0")]
    for k in range(1, hac_lag + 1):
        centred = centred.withColumn(f"c{k}", F.lag("c", k).over(order))
        products.append(F.sum(F.col("c") * F.col(f"c{k}")).alias(f"g{k}"))
    sums = centred.groupBy(*by, "mean", "n").agg(*products).where("n >= 2")
    total = F.col("g0")
    for k in range(1, hac_lag + 1):
        total = total + 2 * (1 - k / (hac_lag + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0))
    h = hac_lag + 1
    factor = F.sqrt((F.col("n") + 1 - 2 * h + h * (h - 1) / F.col("n")) / F.col("n")) if hln else F.lit(1.0)
    out = sums.withColumn("variance", F.greatest(total / F.col("n"), F.lit(0.0)) / F.col("n")).withColumn("degenerate", F.col("variance") <= 0)
    endless = F.when(F.col("mean") == 0, 0.0).when(F.col("mean") > 0, float("inf")).otherwise(float("-inf"))
    stat = F.when(F.col("degenerate"), endless).otherwise(F.try_divide(F.col("mean"), F.sqrt("variance")) * factor)
    return out.select(*by, F.col("n").alias("n_obs"), F.col("mean").alias("mean_difference"), stat.alias("stat"), "degenerate")


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function by its series of positive terms, taken from the
    side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    term = math.exp(math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    total, n = term, 0
    while term > total * 1e-16:
        term *= (a + b + n) / (a + 1 + n) * x
        total, n = total + term, n + 1
    return total


def student_tail(t: float, df: float) -> float:
    """P(T > |t|)."""
    return 0.0 if math.isinf(t) else _beta_share(df / 2, 0.5, df / (df + t * t)) / 2


def with_p_values(tests: DataFrame, *, hln: bool = True) -> DataFrame:
    @F.pandas_udf("double")
    def p(stat: pd.Series, n: pd.Series) -> pd.Series:
        normal = NormalDist()
        return pd.Series([min(1.0, 2 * (student_tail(abs(s), k - 1) if hln else 1 - normal.cdf(abs(s)))) for s, k in zip(stat, n, strict=True)])

    return tests.withColumn("p_value", p("stat", "n_obs"))


def adjust(tests: DataFrame, *, method: str = "holm", p: str = "p_value", order: tuple[str, ...] = ("model_a", "model_b"), family: tuple[str, ...] = ()) -> DataFrame:
    """Family-wise (holm, bonferroni) or false-discovery (bh) adjustment. A family is one table of
    model pairs: a few hundred rows at most."""
    every = Window.partitionBy(*(family or (F.lit(1),)))
    up = every.orderBy(p, *order)
    ranked = tests.withColumn("_n", F.count("*").over(every)).withColumn("_r", F.row_number().over(up))
    raw = F.col(p)
    if method == "holm":
        value = F.max(raw * (F.col("_n") - F.col("_r") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        value = F.min(raw * F.col("_n") / F.col("_r")).over(up.rowsBetween(0, Window.unboundedFollowing))
    else:
        value = raw * F.col("_n") if method == "bonferroni" else raw
    return ranked.withColumn("p_value_adjusted", F.least(value, F.lit(1.0))).drop("_n", "_r")


def test_table(tests: DataFrame, *, hac_lag: int, hln: bool = True, method: str = "holm", level: float = 0.05, family: tuple[str, ...] = ()) -> DataFrame:
    """Tests with p-values, adjusted, with how they were made and what is significant."""
    size = F.count("*").over(Window.partitionBy(*(family or (F.lit(1),))))
    return adjust(tests, method=method, family=family).select(
        "*", F.lit(hac_lag).cast("short").alias("hac_lag"), F.lit(hln).alias("hln_corrected"), F.lit(method).alias("adjust_method"), size.alias("n_comparisons"),
        F.coalesce(F.col("p_value_adjusted") < level, F.lit(False)).alias("significant"),
    )
