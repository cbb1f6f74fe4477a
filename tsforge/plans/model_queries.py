"""Queries on models and detectors. Tests hold those without SQL against brute force on small cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.functions import trend
from tsforge.functions.eda import autocorrelation, partial_autocorrelation
from tsforge.operators import adaptive, automodels, backtest, conformal, detectors, models, neural, recursive, shared_pools, trees, trends
from tsforge.operators.runs import run_forecasters
from tsforge.plans.base import SHIP, query, rounded
from tsforge.plans.forecast_queries import PLAN, WINDOWS
from tsforge.sources.shared import new_folder
from tsforge.sources.tables import daily_shipments, hourly_events
from tsforge.spec import BacktestPlan
from tsforge.streaming import online


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = backtest.backtest(daily_shipments(spark, sf_dir), BacktestPlan(h=7, n_windows=40))
    return conformal.residuals(run.forecasts.where("model_id = 'seasonal_naive'"))


@query()
def online_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.online_conformal(_residuals(spark, sf_dir), step=86400)


@query()
def shared_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive scores whose widest pools hold the residuals of all series."""
    run = backtest.backtest(daily_shipments(spark, sf_dir), BacktestPlan(h=7, n_windows=12))
    residuals = conformal.residuals(run.forecasts.where("model_id = 'seasonal_naive'"))
    return shared_pools.shared_adaptive_scores(residuals, new_folder(spark, "pools"), step=86400, min_calibration=30)[0]


@query()
def conformal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive.coverage_report(adaptive.advance(_residuals(spark, sf_dir), step=86400))


@query()
def conformal_freezes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive.freeze_report(adaptive.advance(_residuals(spark, sf_dir), step=86400))


@query()
def discord_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.discords(hourly_events(spark, sf_dir).df)


@query()
def discords_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten days of events against the stretches of the days before."""
    rows = hourly_events(spark, sf_dir).df
    cut = F.lit("2024-01-21").cast("timestamp_ntz")
    return detectors.discords_behind(rows.where(F.col("ds") < cut), rows.where(F.col("ds") >= cut))


@query()
def iforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.isolation_forest(detectors.window_features(hourly_events(spark, sf_dir).df))


@query()
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.pca_reconstruction(daily_shipments(spark, sf_dir).df, length=14)


@query()
def series_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.backtest_series(daily_shipments(spark, sf_dir), PLAN)


@query()
def auto_arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal ARIMA of chosen orders on the last week, with intervals from two inner origins."""
    model = automodels.AutoArima(max_p=2, max_q=2)
    return automodels.auto_backtest(daily_shipments(spark, sf_dir), BacktestPlan(h=7, n_windows=1), model).forecasts


@query()
def auto_ets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing of a chosen form on four weeks, fitted on every other one."""
    return automodels.auto_backtest(daily_shipments(spark, sf_dir), BacktestPlan(h=7, n_windows=4, refit_every=2), automodels.AutoEts(), calibration=0).forecasts


@query()
def sparse_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise linear trends with a weekly and a yearly season, refitted every other week."""
    shape = trend.Shape(seasons=((7.0, 3), (365.25, 10)))
    return trends.trend_backtest(daily_shipments(spark, sf_dir), BacktestPlan(h=7, n_windows=4, refit_every=2), trends.TrendModel(shape)).forecasts


#: What the recursive models see of daily series.
DAILY = recursive.TargetFeatures(lags=(1, 2, 3, 7, 14), windows=(7, 28), stats=("mean", "std"), diffs=(1, 7))


@query()
def recursive_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of forecasts that feed on themselves, with intervals from inner origins."""
    panel, plan = daily_shipments(spark, sf_dir), BacktestPlan(h=14, n_windows=1)
    made = automodels.calibrated(recursive.forecaster(DAILY, new_folder(spark, "trees")), h=plan.h, quantiles=plan.quantiles)
    return run_forecasters(panel, plan, {"recursive_boosted": made}, new_folder(spark, "runs")).forecasts


@query()
def boosted_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain and mean absolute Shapley value of each input of the recursive model, on 200 rows of its
    design."""
    model, design, names = recursive.fit(daily_shipments(spark, sf_dir), DAILY)
    forest, keys = trees.forest_of(model, new_folder(spark, "trees")), ["unique_id", "ds"]
    values = trees.shapley_values(trees.sampled(design, keys, rows=200, seed=0), forest, names, keys)
    return trees.mean_abs_shap(values).join(trees.importance(model, names), "feature")


@query()
def lstm_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrent network of all series forecasts the quantiles of the last week."""
    panel, plan = daily_shipments(spark, sf_dir), BacktestPlan(h=7, n_windows=1)
    made = neural.lstm_forecaster(new_folder(spark, "samples"), context=28, horizon=plan.h, quantiles=plan.quantiles, how=neural.Training(epochs=4))
    return run_forecasters(panel, plan, {"lstm": made}, new_folder(spark, "runs")).forecasts


@query()
def autoencoder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year of shipments by the errors of a network trained on what came before."""
    rows = daily_shipments(spark, sf_dir).df
    year = F.lit("2001-01-01").cast("timestamp_ntz")
    fitted = neural.fit_autoencoder(rows.where(F.col("ds") < year), new_folder(spark, "samples"), length=14, how=neural.Training(epochs=4))
    return fitted.score(rows.where(F.col("ds") >= year))


@query()
def boosted_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.boosted_direct(daily_shipments(spark, sf_dir), BacktestPlan(h=7, n_windows=1))


@query(f"""WITH RECURSIVE {SHIP}, kn AS (SELECT unique_id, y - avg(y) OVER (PARTITION BY unique_id) AS c, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS i FROM ship WHERE y IS NOT NULL),
ac AS (SELECT a.unique_id, k, sum(a.c * b.c) / any_value(v) AS r FROM kn a JOIN (SELECT unnest(range(1, 15)) AS k) ON true JOIN kn b ON b.unique_id = a.unique_id AND b.i = a.i - k
  JOIN (SELECT unique_id, sum(c * c) AS v FROM kn GROUP BY unique_id) t ON t.unique_id = a.unique_id GROUP BY a.unique_id, k),
rs AS (SELECT unique_id, list(r ORDER BY k) AS r FROM ac GROUP BY unique_id),
dl AS (SELECT unique_id, 1 AS k, [r[1]] AS phi, r[1] AS last, r FROM rs
  UNION ALL SELECT unique_id, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - l * phi[k + 1 - i]), l), l, r
  FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i]))) AS l FROM dl WHERE k < 14))
SELECT unique_id, k::INT AS lag, round(last, 4) AS pacf FROM dl""")
def pacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partial_autocorrelation(autocorrelation(daily_shipments(spark, sf_dir).df, max_lag=14)), 4)


@query(f"""WITH {WINDOWS}, k AS (SELECT unnest([3, 7, 14, 28]) AS average),
lv AS (SELECT unique_id, window_id, average, avg(y) AS y_hat FROM wins JOIN ship ON ds <= cutoff JOIN k ON date_diff('day', ds, cutoff) < average WHERE stage = 'dev' GROUP BY ALL)
SELECT average::INT AS average, round(avg(abs(y - y_hat)), 4) AS mae FROM lv JOIN wins USING (window_id) JOIN ship s ON s.unique_id = lv.unique_id AND s.ds > cutoff AND s.ds <= cutoff + INTERVAL 14 DAY GROUP BY average""")
def tune_window_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.tune_window_average(daily_shipments(spark, sf_dir), PLAN), 4)


@query(f"""WITH {SHIP}, f AS (SELECT unique_id, ds, y, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s, count(y) OVER w AS n, y - lag(y, 1) OVER o AS diff1, y - lag(y, 2) OVER o AS diff2 FROM ship
  WINDOW o AS (PARTITION BY unique_id ORDER BY ds), w AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT unique_id, ds, round(y, 4) AS value, round(CASE WHEN s > 0 THEN (y - m) / s ELSE 0 END, 4) AS zscore, round(diff1, 4) AS diff1, round(diff2, 4) AS diff2, round(s * s * 7 / 2, 4) AS energy, hour(ds)::DOUBLE AS hour, n = 7 AND y IS NOT NULL AND diff1 IS NOT NULL AND diff2 IS NOT NULL AS usable FROM f""")
def detector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.window_features(daily_shipments(spark, sf_dir).df, window=7)
    return rounded(rows.select("unique_id", "ds", *detectors.FEATURES, "usable"), 4)


@query("""WITH r AS (SELECT user_id, ts + INTERVAL 1 HOUR AS ts, max(value) AS value FROM events GROUP BY ALL)
SELECT l.event_id, round(r.value, 4) AS value, r.ts AS known_at FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's latest value that was known by then, an hour after it happened."""
    from tsforge.operators.asof import asof_join as asof
    from tsforge.sources.tables import table

    rows = table(spark, sf_dir, "events")
    right = rows.select("user_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias("ts"), "value")
    return rounded(asof(rows.select("event_id", "user_id", "ts"), right, by="user_id", on="ts").select("event_id", "value", "known_at"), 4)


@query()
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsforge.functions.eda import decomposition as split

    return split(hourly_events(spark, sf_dir).df)


@query()
def series_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsforge.functions.eda import decomposition as split
    from tsforge.functions.eda import difficulty

    return difficulty(split(hourly_events(spark, sf_dir).df))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files: whatever lies at the table's path."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select(F.col("event_type").alias("unique_id"), F.col("ts").cast("timestamp").alias("ds"), F.col("value").alias("y"))


@query("""SELECT * FROM (SELECT event_type AS unique_id, date_trunc('hour', ts)::TIMESTAMP AS ds, round(sum(value), 4) AS y, count(*)::BIGINT AS n FROM events GROUP BY ALL)
WHERE ds + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)""")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark, two hours behind the latest event, has closed."""
    hours = online.drained(online.hourly(_event_stream(spark, sf_dir)), new_folder(spark, "streams"), "hours")
    return rounded(hours.withColumn("ds", F.col("ds").cast("timestamp_ntz")), 4)


@query("""WITH o AS (SELECT event_type AS unique_id, ts::TIMESTAMP AS ds, value AS y, pow(2, (row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1) / 48.0) AS w FROM events WHERE value IS NOT NULL),
s AS (SELECT *, sum(w) OVER b AS sw, sum(w * y) OVER b / sum(w) OVER b AS m, sum(w * y * y) OVER b AS sq, w * pow(0.5, 1 / 48.0) AS last FROM o
  WINDOW b AS (PARTITION BY unique_id ORDER BY ds, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT unique_id, ds, y, round(CASE WHEN sw / last > 2 AND sq - sw * m * m > 0 THEN (y - m) / sqrt((sq - sw * m * m) / sw) END, 3) AS z FROM s
UNION ALL SELECT event_type, ts::TIMESTAMP, value, NULL FROM events WHERE value IS NULL""")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event passes the stateful scorer once, in the order of time."""
    scored = online.drained(online.running_z(_event_stream(spark, sf_dir)), new_folder(spark, "streams"), "scores")
    return scored.select("unique_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "y", F.round("z", 3).alias("z"))
