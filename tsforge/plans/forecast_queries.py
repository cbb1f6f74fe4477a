"""Queries on backtests and anomalies over the daily shipments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.functions import metrics, stats
from tsforge.operators import adaptive, anomaly_metrics, backtest, conformal, events, inject, split
from tsforge.operators.inject import AnomalySpec
from tsforge.panel import Panel
from tsforge.plans.base import ORACLES, EVT, SHIP, query, rounded
from tsforge.sources.shared import stored
from tsforge.sources.tables import daily_shipments, hourly_events
from tsforge.spec import BacktestPlan, normal_quantile, quantile_column

H, N, M = 14, 8, 7
PLAN = BacktestPlan(h=H, n_windows=N, holdout_windows=2)
SLIDING = BacktestPlan(h=H, n_windows=N, step_size=21, gap=3, mode="sliding", train_size=200, holdout_windows=3)

WINDOWS = f"""{SHIP},
span AS (SELECT min(ds) AS lo, date_diff('day', min(ds), max(ds)) + 1 AS n FROM ship),
wins AS (SELECT i::SMALLINT AS window_id, CASE WHEN i >= {N - 2} THEN 'holdout' ELSE 'dev' END AS stage, lo AS train_start,
  lo + to_days((n - 1 - {H} - ({N - 1} - i) * {H})::INT) AS cutoff FROM span, (SELECT unnest(range({N})) AS i))"""

_Q = {q: normal_quantile(q) for q in PLAN.quantiles}
FORECASTS = f"""{WINDOWS},
filled AS (SELECT unique_id, ds, last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds) AS v FROM ship),
diffs AS (SELECT *, v - lag(v) OVER w AS d1, v - lag(v, {M}) OVER w AS dm FROM filled WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
train AS (SELECT d.*, w.window_id, w.cutoff, date_diff('day', d.ds, w.cutoff) AS behind FROM diffs d JOIN wins w ON d.ds <= w.cutoff),
state AS (SELECT unique_id, window_id, cutoff, count(*) AS n, arg_max(v, ds) AS last, arg_min(v, ds) AS first, stddev_samp(d1) AS sd1, stddev_samp(dm) AS sdm, avg(v) AS ma, stddev_samp(v) AS sa,
  avg(v) FILTER (WHERE behind < {M}) AS mr, stddev_samp(v) FILTER (WHERE behind < {M}) AS sr FROM train GROUP BY ALL),
steps AS (SELECT s.*, h, s.cutoff + to_days(h::INT) AS ds FROM state s, (SELECT unnest(range(1, {H + 1})) AS h)),
pred AS (
  SELECT unique_id, 'naive' AS model_id, window_id, cutoff, ds, h, last AS y_hat, sd1 * sqrt(h) AS sigma FROM steps WHERE n >= 2
  UNION ALL SELECT unique_id, 'drift', window_id, cutoff, ds, h, last + (last - first) / (n - 1) * h, sd1 * sqrt(h * (1 + h / greatest(n - 1, 1)::DOUBLE)) FROM steps WHERE n >= 2
  UNION ALL SELECT s.unique_id, 'seasonal_naive', s.window_id, s.cutoff, s.ds, h, t.v, sdm * sqrt((h - 1) // {M} + 1) FROM steps s LEFT JOIN train t
    ON t.unique_id = s.unique_id AND t.window_id = s.window_id AND t.behind = {M} - 1 - (h - 1) % {M} WHERE n >= {M + 2}
  UNION ALL SELECT unique_id, 'window_average', window_id, cutoff, ds, h, mr, sr FROM steps
  UNION ALL SELECT unique_id, 'historic_average', window_id, cutoff, ds, h, ma, sa * sqrt(1 + 1 / n::DOUBLE) FROM steps),
fc AS (SELECT p.*, {", ".join(f"y_hat + sigma * ({z!r})::DOUBLE AS {quantile_column(q)}" for q, z in _Q.items())}, a.y FROM pred p LEFT JOIN ship a USING (unique_id, ds))"""
DENOM = f"""md AS (SELECT *, abs(y - lag(y, {M}) OVER (PARTITION BY unique_id ORDER BY ds)) AS d FROM ship),
den AS (SELECT unique_id, window_id, nullif(avg(d), 0) AS mase_denominator FROM md JOIN wins ON ds <= cutoff GROUP BY ALL),
sc AS (SELECT fc.*, mase_denominator, y - y_hat AS e FROM fc LEFT JOIN den USING (unique_id, window_id))"""
POINT = """count(e)::BIGINT AS n_obs, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(100 * avg(CASE WHEN y <> 0 THEN abs(e) / abs(y) END), 4) AS mape,
  round(avg(CASE WHEN abs(y) + abs(y_hat) > 0 THEN 200 * abs(e) / (abs(y) + abs(y_hat)) WHEN e IS NOT NULL THEN 0 END), 4) AS smape, round(avg(CASE WHEN mase_denominator > 0 THEN abs(e) / mase_denominator END), 4) AS mase,
  round(avg(CASE WHEN e IS NOT NULL THEN mase_denominator END), 4) AS mase_denominator"""


def _run(spark: SparkSession, sf_dir: str) -> tuple[Panel, backtest.Backtest]:
    panel = daily_shipments(spark, sf_dir)
    return panel, backtest.backtest(panel, PLAN)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, run = _run(spark, sf_dir)
    return metrics.scored(run.forecasts, metrics.mase_denominators(panel, run.windows))


@query(f"WITH {WINDOWS} SELECT window_id, stage, train_start, cutoff, cutoff + INTERVAL 1 DAY AS first_pred, cutoff + INTERVAL {H} DAY AS last_pred FROM wins")
def windows_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.windows(daily_shipments(spark, sf_dir), PLAN)


@query(f"""WITH {SHIP}, span AS (SELECT min(ds) AS lo, date_diff('day', min(ds), max(ds)) + 1 AS n FROM ship)
SELECT i::SMALLINT AS window_id, CASE WHEN i >= 5 THEN 'holdout' ELSE 'dev' END AS stage, lo + to_days((c - 199)::INT) AS train_start, lo + to_days(c::INT) AS cutoff, lo + to_days((c + 4)::INT) AS first_pred, lo + to_days((c + 17)::INT) AS last_pred
FROM (SELECT i, lo, n - 1 - 3 - 14 - (7 - i) * 21 AS c FROM span, (SELECT unnest(range(8)) AS i))""")
def windows_sliding_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.windows(daily_shipments(spark, sf_dir), SLIDING)


@query(f"""WITH {WINDOWS} SELECT window_id, stage, count(y)::BIGINT AS n_train_obs, count(DISTINCT unique_id)::INT AS n_series FROM wins JOIN ship ON ds <= cutoff WHERE y IS NOT NULL GROUP BY ALL""")
def window_train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_shipments(spark, sf_dir)
    return split.with_train_counts(panel, split.windows(panel, PLAN)).select("window_id", "stage", "n_train_obs", "n_series")


@query(f"WITH {FORECASTS} SELECT unique_id, model_id, window_id, cutoff, ds, h::SMALLINT AS h_step, round(y_hat, 4) AS y_hat, round(sigma, 4) AS sigma, round(q_0250, 4) AS q_0250, round(q_9750, 4) AS q_9750, y FROM fc")
def backtest_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir)[1].forecasts
    return rounded(rows.select("unique_id", "model_id", "window_id", "cutoff", "ds", "h_step", "y_hat", "sigma", "q_0250", "q_9750", "y"), 4)


@query(f"WITH {WINDOWS} SELECT m AS model_id, window_id, 'ok' AS status FROM wins, (SELECT unnest(['naive', 'drift', 'seasonal_naive', 'window_average', 'historic_average']) AS m)")
def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].model_runs.select("model_id", "window_id", "status")


@query(f"WITH {FORECASTS}, {DENOM} SELECT unique_id, window_id, round(mase_denominator, 4) AS mase_denominator FROM den")
def mase_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_shipments(spark, sf_dir)
    return rounded(metrics.mase_denominators(panel, split.windows(panel, PLAN)), 4)


_VALID = "y IS NOT NULL AND q_0250 IS NOT NULL"
_PIN = {q: f"greatest({q}::DOUBLE * (y - {quantile_column(q)}), ({q}::DOUBLE - 1) * (y - {quantile_column(q)}))" for q in PLAN.quantiles}
_QS = list(PLAN.quantiles)
_CRPS = " + ".join(f"{(b - a) / 2!r}::DOUBLE * ({_PIN[a]} + {_PIN[b]})" for a, b in zip(_QS, _QS[1:], strict=False))
PROB = ", ".join([
    f"(count(*) FILTER (WHERE {_VALID}))::BIGINT AS n_obs_prob", *(f"round(avg({c}), 4) AS pinball_{quantile_column(q)}" for q, c in _PIN.items()),
    f"round(avg(({' + '.join(_PIN.values())}) / {len(_QS)}), 4) AS pinball_mean", f"round(2 * avg({_CRPS}), 4) AS crps",
    *(f"round(avg((y BETWEEN {lo} AND {hi})::INT), 4) AS coverage_{n}, round(avg(CASE WHEN {_VALID} THEN {hi} - {lo} END), 4) AS width_{n}" for n, lo, hi in ((95, "q_0250", "q_9750"), (80, "q_1000", "q_9000"), (50, "q_2500", "q_7500"))),
])


@query(f"WITH {FORECASTS}, {DENOM} SELECT model_id, unique_id, grouping(unique_id)::INT::BOOLEAN AS overall, {POINT}, {PROB} FROM sc GROUP BY GROUPING SETS ((model_id, unique_id), (model_id))")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.leaderboard(_scored(spark, sf_dir)), 4)


@query(f"WITH {FORECASTS}, {DENOM} SELECT model_id, h::SMALLINT AS h_step, {POINT} FROM sc GROUP BY ALL")
def error_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.by_step(_scored(spark, sf_dir)), 4)


@query(f"WITH {FORECASTS}, {DENOM} SELECT model_id, {POINT} FROM sc WHERE window_id >= {N - 2} GROUP BY ALL")
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, run = _run(spark, sf_dir)
    rows = metrics.of_stage(run.forecasts, run.windows, "holdout")
    scored = metrics.scored(rows, metrics.mase_denominators(panel, run.windows))
    return rounded(scored.groupBy("model_id").agg(*metrics.point_metrics()), 4)


_DM = """ls AS (SELECT unique_id, window_id, ds, model_id, abs(y - y_hat) AS l FROM fc WHERE y IS NOT NULL AND y_hat IS NOT NULL),
pr AS (SELECT a.unique_id, a.window_id, a.ds, a.model_id AS model_a, b.model_id AS model_b, a.l - b.l AS d FROM ls a JOIN ls b USING (unique_id, window_id, ds) WHERE a.model_id < b.model_id),
ag AS (SELECT model_a, model_b, avg(d) AS mean, count(*) AS n FROM pr GROUP BY ALL),
ce AS (SELECT pr.*, mean, d - mean AS c, n FROM pr JOIN ag USING (model_a, model_b)),
lg AS (SELECT *, lag(c) OVER o AS c1, lag(c, 2) OVER o AS c2 FROM ce WINDOW o AS (PARTITION BY model_a, model_b ORDER BY unique_id, window_id, ds)),
dm AS (SELECT model_a, model_b, n, mean, greatest(sum(c * c) + 2 * (1 - 1 / 3.0::DOUBLE) * sum(c * c1) + 2 * (1 - 2 / 3.0::DOUBLE) * sum(c * c2), 0) / n / n AS v FROM lg GROUP BY model_a, model_b, n, mean)"""


@query(f"WITH {FORECASTS}, {_DM} SELECT model_a, model_b, n::BIGINT AS n_obs, round(mean, 4) AS mean_difference, round(mean / sqrt(v) * sqrt((n + 1 - 6 + 6 / n::DOUBLE) / n), 4) AS stat, v <= 0 AS degenerate FROM dm")
def dm_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pairwise_dm(_run(spark, sf_dir)[1].forecasts, hac_lag=2), 4)


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_p_values(stats.pairwise_dm(_run(spark, sf_dir)[1].forecasts, hac_lag=2))


# Student's tail: with x = sqrt(df) * tan(u), the density is a power of cos(u); both areas by Simpson's rule.
_P = """pv AS (SELECT *, mean / sqrt(v) * sqrt((n + 1 - 6 + 6 / n::DOUBLE) / n) AS stat FROM dm),
th AS (SELECT *, atan(abs(stat) / sqrt(n - 1)) AS th FROM pv),
ps AS (SELECT model_a, model_b, n, mean, v, stat, round(1 - sum(w * pow(cos(th * i / 2000), n - 2)) * th / (sum(w * pow(cos(pi() / 2 * i / 2000), n - 2)) * pi() / 2), 6) AS p
  FROM th, (SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(2001)) AS i)) GROUP BY model_a, model_b, n, mean, v, stat, th),
rk AS (SELECT *, row_number() OVER (ORDER BY p, model_a, model_b) AS r, count(*) OVER () AS k FROM ps)"""


def _adjusted(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    tests = _tested(spark, sf_dir).withColumn("p_value", F.round("p_value", 6))
    return rounded(stats.adjust(tests, method=method).select("model_a", "model_b", "p_value_adjusted"), 4)


@query(f"WITH {FORECASTS}, {_DM}, {_P} SELECT model_a, model_b, round(least(max(p * (k - r + 1)) OVER (ORDER BY r), 1), 4) AS p_value_adjusted FROM rk")
def p_adjust_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir, "holm")


@query(f"WITH {FORECASTS}, {_DM}, {_P} SELECT model_a, model_b, round(least(min(p * k / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 4) AS p_value_adjusted FROM rk")
def p_adjust_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir, "bh")


@query(f"WITH {FORECASTS}, {_DM}, {_P} SELECT model_a, model_b, n::BIGINT AS n_obs, round(mean, 4) AS mean_difference, round(stat, 4) AS stat, v <= 0 AS degenerate, round(p, 4) AS p_value FROM ps")
def dm_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tested(spark, sf_dir), 4)


@query(f"""WITH {FORECASTS}, {_DM}, {_P} SELECT model_a, model_b, n::BIGINT AS n_obs, 2::SMALLINT AS hac_lag, true AS hln_corrected, round(p, 4) AS p_value, round(least(max(p * (k - r + 1)) OVER (ORDER BY r), 1), 4) AS p_value_adjusted,
  'holm' AS adjust_method, k::BIGINT AS n_comparisons, least(max(p * (k - r + 1)) OVER (ORDER BY r), 1) < 0.05 AS significant FROM rk""")
def dm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _tested(spark, sf_dir).withColumn("p_value", F.round("p_value", 6))
    table = stats.test_table(tests, hac_lag=2, method="holm", level=0.05)
    return rounded(table.select("model_a", "model_b", "n_obs", "hac_lag", "hln_corrected", "p_value", "p_value_adjusted", "adjust_method", "n_comparisons", "significant"), 4)


@query("""WITH q AS (SELECT event_id, value AS a, value * (event_id % 3) AS b, CASE WHEN event_id % 5 > 0 THEN 10.0::DOUBLE END AS c FROM events),
s AS (SELECT *, list_sort(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS k FROM q)
SELECT event_id, round(k[1], 4) AS a, round(k[2], 4) AS b, CASE WHEN c IS NOT NULL THEN round(k[3], 4) END AS c, a <> k[1] OR b <> k[2] OR coalesce(c <> k[3], false) AS crossed FROM s""")
def quantile_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("value").alias("a"), (F.col("value") * (F.col("event_id") % 3)).alias("b"), F.when(F.col("event_id") % 5 > 0, 10.0).alias("c"))
    return rounded(backtest.repair_quantiles(rows, ["a", "b", "c"]), 4)


# Anomalies: the residuals of the seasonal-naive model score each day of its windows.
_RES = "res AS (SELECT unique_id, ds, window_id, greatest(q_0250 - y, y - q_9750) / nullif(greatest(q_9750 - q_0250, 0), 0) AS r, CASE WHEN y - q_9750 >= q_0250 - y THEN 1 ELSE -1 END::TINYINT AS side FROM fc WHERE model_id = 'seasonal_naive')"
_SCORES = f"""cal AS (SELECT unique_id, r FROM res WHERE window_id < {N - 2} AND r IS NOT NULL),
sco AS (SELECT a.unique_id, a.ds, count(c.r)::INT AS calib_n, a.r IS NOT NULL AND count(c.r) >= 50 AS scorable,
  CASE WHEN a.r IS NOT NULL AND count(c.r) >= 50 THEN -log10((1 + count(*) FILTER (WHERE c.r >= a.r)) / (count(c.r) + 1)::DOUBLE) END AS score, CASE WHEN a.r IS NOT NULL AND count(c.r) >= 50 THEN a.r END AS severity, a.side
  FROM res a LEFT JOIN cal c USING (unique_id) WHERE a.window_id >= {N - 2} GROUP BY a.unique_id, a.ds, a.r, a.side)"""


def _conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)[1]
    dev, held = (conformal.residuals(conformal.scoring_frame(run.forecasts, run.windows, model_id="seasonal_naive", stage=s, step=86400)) for s in ("dev", "holdout"))
    return conformal.split_conformal_scores(dev, held)


@query(f"WITH {FORECASTS} SELECT unique_id, ds, h::SMALLINT AS h_step, round(y_hat, 4) AS y_hat, y FROM fc WHERE model_id = 'naive' AND window_id >= {N - 2}")
def scoring_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)[1]
    return rounded(conformal.scoring_frame(run.forecasts, run.windows, model_id="naive", stage="holdout", step=86400).select("unique_id", "ds", "h_step", "y_hat", "y"), 4)


@query(f"WITH {FORECASTS}, {_RES}, {_SCORES} SELECT unique_id, ds, round(score, 4) AS score, scorable, round(severity, 4) AS severity, calib_n, side FROM sco")
def split_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_conformal(spark, sf_dir), 4)


@query(f"WITH {FORECASTS}, {_RES}, {_SCORES}, t AS (SELECT unnest([0.001, 0.01, 0.05, 0.1])::DOUBLE AS alpha) SELECT alpha, round(-log10(alpha), 4) AS threshold, coalesce(-log10(alpha) <= (SELECT max(score) FROM sco WHERE scorable), true) AS reachable FROM t")
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.threshold_table(_conformal(spark, sf_dir), (0.001, 0.01, 0.05, 0.1)), 4)


def _level(i: int, keys: str) -> str:
    on = " AND ".join([f"a.{k} = c.{k}" for k in keys.split()] or ["true"])
    return f"l{i} AS (SELECT a.unique_id, a.ds, count(*) AS n, count(*) FILTER (WHERE c.r >= a.r) AS ge FROM ga a JOIN gc c ON {on} GROUP BY ALL)"


_GROUPS = ("unique_id hour lead_bin", "unique_id hour_bin lead_bin", "unique_id hour_bin", "hour_bin", "")
_PICK = lambda c: "CASE " + " ".join(f"WHEN l{i}.n >= 50 THEN {c(i)}" for i in range(len(_GROUPS))) + " END"


@query(f"""WITH {FORECASTS}, {_RES}, gr AS (SELECT res.*, 0 AS hour, 0 AS hour_bin, (date_diff('day', cutoff, ds) > 1)::INT + (date_diff('day', cutoff, ds) > 6)::INT + (date_diff('day', cutoff, ds) > 24)::INT AS lead_bin FROM res JOIN wins USING (window_id)),
gc AS (SELECT * FROM gr WHERE window_id < {N - 2} AND r IS NOT NULL), ga AS (SELECT * FROM gr WHERE window_id >= {N - 2}), {", ".join(_level(i, k) for i, k in enumerate(_GROUPS))}
SELECT unique_id, ds, round(CASE WHEN ga.r IS NOT NULL THEN -log10((1 + {_PICK(lambda i: f"l{i}.ge")}) / (1 + {_PICK(lambda i: f"l{i}.n")})::DOUBLE) END, 4) AS score, ga.r IS NOT NULL AND {_PICK(str)} IS NOT NULL AS scorable,
  coalesce(CASE WHEN ga.r IS NOT NULL THEN {_PICK(str)} END, -1)::INT AS level, coalesce(CASE WHEN ga.r IS NOT NULL THEN {_PICK(lambda i: f"l{i}.n")} END, 0)::INT AS calib_n, side
FROM ga {" ".join(f"LEFT JOIN l{i} USING (unique_id, ds)" for i in range(len(_GROUPS)))}""")
def conditional_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)[1]
    frames = (conformal.residuals(conformal.scoring_frame(run.forecasts, run.windows, model_id="seasonal_naive", stage=s, step=86400)) for s in ("dev", "holdout"))
    dev, held = (stored(adaptive.with_groups(f, step=86400), "residuals") for f in frames)
    return rounded(adaptive.conditional_scores(dev, held).na.fill(-1, ["level"]), 4)


# Flags for the event queries: days that ship much; labels: days that ship very little or much.
_FLAGS = f"""{SHIP}, st AS (SELECT unique_id, avg(y) AS m, stddev_samp(y) AS s FROM ship GROUP BY unique_id),
fl AS (SELECT s.unique_id, ds, row_number() OVER (PARTITION BY s.unique_id ORDER BY ds) - 1 AS pos, y IS NOT NULL AND y > m + 0.8 * s AS flag, day(ds) <= 3 AND month(ds) % 2 = 0 AS label, round((y - m) / s, 1) AS score, y FROM ship s JOIN st USING (unique_id))"""
_GAP = lambda flag, gap: f"(SELECT *, sum(n) OVER (PARTITION BY unique_id ORDER BY pos) AS island FROM (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY unique_id ORDER BY pos) - 1 > {gap}, false)::INT AS n FROM fl WHERE {flag}))"
_RANGES = f"""tr AS (SELECT unique_id, island, min(pos) AS a, max(pos) AS b FROM {_GAP("label", 0)} GROUP BY ALL),
fr AS (SELECT unique_id, island, min(pos) AS a, max(pos) AS b FROM {_GAP("flag", 2)} GROUP BY ALL)"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = daily_shipments(spark, sf_dir).df
    by = Window.partitionBy("unique_id")
    z = (F.col("y") - F.avg("y").over(by)) / F.stddev_samp("y").over(by)
    rows = df.select("unique_id", "ds", "y", z.alias("z"), (F.row_number().over(by.orderBy("ds")) - 1).alias("pos"))
    label = (F.dayofmonth("ds") <= 3) & (F.month("ds") % 2 == 0)
    return rows.select("unique_id", "ds", "pos", F.coalesce(F.col("z") > 0.8, F.lit(False)).alias("flag"), label.alias("label"), F.round("z", 1).alias("score"), "y")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flagged(spark, sf_dir)
    scores = rows.select("unique_id", "ds", F.when(F.col("flag"), 2.0).otherwise(0.0).alias("score"), F.col("y").isNotNull().alias("scorable"), F.col("y").alias("severity"), F.lit(1).alias("side"))
    return events.aggregate_events(scores, detector_id="level", alpha=0.05, merge_gap=2, min_points=2)


_EVENTS = f"""{_FLAGS}, {_RANGES},
ev AS (SELECT unique_id, min(ds) AS start_ds, max(ds) AS end_ds, count(*)::BIGINT AS n_points, max(pos) - min(pos) + 1 AS duration_steps, max(y) AS peak_severity, sum(y) AS cum_severity, arg_max(ds, (y, -pos)) AS peak_ds
  FROM {_GAP("flag", 2)} GROUP BY unique_id, island HAVING count(*) >= 2)"""


@query(f"WITH {_EVENTS} SELECT unique_id, start_ds, end_ds, n_points, duration_steps::INT AS duration_steps, round(peak_severity, 4) AS peak_severity, round(cum_severity, 4) AS cum_severity, peak_ds, 'over' AS direction, 'level|' || unique_id || '|0.0500|' || strftime(start_ds, '%Y%m%dT%H%M') AS event_id FROM ev")
def events_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_detected(spark, sf_dir).select("unique_id", "start_ds", "end_ds", "n_points", "duration_steps", "peak_severity", "cum_severity", "peak_ds", "direction", "event_id"), 4)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flagged(spark, sf_dir).where("label")
    return rows.select("unique_id", "ds", F.lit(True).alias("is_anomaly"), F.date_format("ds", "yyyyMM").alias("event_id"), F.lit("month_start").alias("anomaly_type"))


@query(f"WITH {_FLAGS} SELECT unique_id, strftime(ds, '%Y%m') AS event_id, min(ds) AS start_ds, max(ds) AS end_ds, count(*)::BIGINT AS n_points, 'month_start' AS anomaly_type FROM fl WHERE label GROUP BY ALL")
def truth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.truth_events(_truth(spark, sf_dir))


_TE = "te AS (SELECT unique_id, strftime(ds, '%Y%m') AS truth_id, min(ds) AS t0, max(ds) AS t1 FROM fl WHERE label GROUP BY ALL)"


@query(f"WITH {_EVENTS}, {_TE} SELECT ev.unique_id, start_ds, truth_id, date_diff('second', greatest(start_ds, t0), least(end_ds, t1))::BIGINT AS overlap FROM ev JOIN te ON ev.unique_id = te.unique_id AND start_ds <= t1 AND t0 <= end_ds")
def event_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.overlaps(_detected(spark, sf_dir), events.truth_events(_truth(spark, sf_dir))).select("unique_id", "start_ds", "truth_id", "overlap")


@query(f"""WITH RECURSIVE {_EVENTS}, tx AS (SELECT unique_id, strftime(ds, '%Y%m') AS truth_id, min(ds) AS t0, max(ds) AS t1 FROM fl WHERE label GROUP BY ALL),
ex AS (SELECT *, 'level|' || unique_id || '|0.0500|' || strftime(start_ds, '%Y%m%dT%H%M') AS event_id FROM ev),
pa AS (SELECT ex.unique_id, event_id, truth_id, row_number() OVER (PARTITION BY ex.unique_id ORDER BY date_diff('second', greatest(start_ds, t0), least(end_ds, t1)) DESC, start_ds, t0, event_id, truth_id) AS rn
  FROM ex JOIN tx ON ex.unique_id = tx.unique_id AND start_ds <= t1 AND t0 <= end_ds),
gr AS (SELECT DISTINCT unique_id, 0::BIGINT AS rn, []::VARCHAR[] AS ev_done, []::VARCHAR[] AS tr_done FROM pa
  UNION ALL SELECT pa.unique_id, pa.rn, CASE WHEN list_contains(ev_done, event_id) OR list_contains(tr_done, truth_id) THEN ev_done ELSE list_append(ev_done, event_id) END,
    CASE WHEN list_contains(ev_done, event_id) OR list_contains(tr_done, truth_id) THEN tr_done ELSE list_append(tr_done, truth_id) END FROM gr JOIN pa ON pa.unique_id = gr.unique_id AND pa.rn = gr.rn + 1),
fi AS (SELECT unique_id, unnest(ev_done) AS event_id, unnest(tr_done) AS truth_id FROM (SELECT unique_id, arg_max(ev_done, rn) AS ev_done, arg_max(tr_done, rn) AS tr_done FROM gr GROUP BY unique_id))
SELECT ex.unique_id, ex.event_id, fi.truth_id AS matched_truth_event_id, CASE WHEN fi.truth_id IS NULL THEN 'false_alarm' ELSE 'hit' END AS match_kind, start_ds, end_ds FROM ex LEFT JOIN fi ON fi.unique_id = ex.unique_id AND fi.event_id = ex.event_id
UNION ALL SELECT unique_id, NULL, truth_id, 'missed', t0, t1 FROM tx WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.unique_id = tx.unique_id AND fi.truth_id = tx.truth_id)""")
def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.match_events(_detected(spark, sf_dir), events.truth_events(_truth(spark, sf_dir)))


_RP = """bo AS (SELECT t.unique_id, t.island AS ti, f.island AS fi, t.a AS ta, t.b AS tb, f.a AS fa, f.b AS fb, least(t.b, f.b) - greatest(t.a, f.a) + 1 AS s FROM tr t JOIN fr f ON t.unique_id = f.unique_id AND t.a <= f.b AND f.a <= t.b),
rc AS (SELECT tr.unique_id, coalesce(x.r, 0) AS recall FROM tr LEFT JOIN (SELECT unique_id, ti, sum(s) / (tb - ta + 1)::DOUBLE / count(*) AS r FROM bo GROUP BY unique_id, ti, ta, tb) x ON x.unique_id = tr.unique_id AND x.ti = tr.island),
pc AS (SELECT fr.unique_id, coalesce(x.r, 0) AS precision FROM fr LEFT JOIN (SELECT unique_id, fi, sum(s) / (fb - fa + 1)::DOUBLE / count(*) AS r FROM bo GROUP BY unique_id, fi, fa, fb) x ON x.unique_id = fr.unique_id AND x.fi = fr.island)"""


@query(f"""WITH {_FLAGS}, {_RANGES}, {_RP} SELECT unique_id, round(precision, 4) AS precision, round(recall, 4) AS recall
FROM (SELECT unique_id, avg(recall) AS recall FROM rc GROUP BY unique_id) JOIN (SELECT unique_id, avg(precision) AS precision FROM pc GROUP BY unique_id) USING (unique_id)""")
def range_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.range_precision_recall(_flagged(spark, sf_dir), merge_gap=2).select("unique_id", "precision", "recall"), 4)


@query(f"""WITH {_FLAGS}, {_RANGES}, pl AS (SELECT t.unique_id, t.island, f.flag, f.pos - t.a + 1 AS i, t.b - t.a + 1 AS n, p.island AS fi FROM tr t JOIN fl f ON f.unique_id = t.unique_id AND f.pos BETWEEN t.a AND t.b
    LEFT JOIN fr p ON p.unique_id = t.unique_id AND f.pos BETWEEN p.a AND p.b),
sh AS (SELECT unique_id, island, sum(CASE WHEN fi IS NOT NULL THEN i END) / sum(i)::DOUBLE AS back, sum(CASE WHEN fi IS NOT NULL THEN n - i + 1 END) / sum(n - i + 1)::DOUBLE AS front,
  sum(CASE WHEN fi IS NOT NULL THEN least(i, n - i + 1) END) / sum(least(i, n - i + 1))::DOUBLE AS middle FROM pl GROUP BY ALL)
SELECT unique_id, round(avg(coalesce(0.3 + 0.7 * back, 0)), 4) AS back, round(avg(coalesce(0.3 + 0.7 * front, 0)), 4) AS front, round(avg(coalesce(0.3 + 0.7 * middle, 0)), 4) AS middle FROM sh GROUP BY unique_id""")
def range_recall_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = _flagged(spark, sf_dir), None
    for bias in ("back", "front", "middle"):
        one = anomaly_metrics.range_precision_recall(rows, merge_gap=2, existence=0.3, bias=bias, cardinality="one").select("unique_id", F.col("recall").alias(bias))
        out = one if out is None else out.join(one, "unique_id")
    return rounded(out, 4)


_ZONES = """z AS (SELECT unique_id, a, b, coalesce((lag(b) OVER w + a) // 2 + 1, 0) AS z0, coalesce((b + lead(a) OVER w) // 2, (SELECT max(pos) FROM fl f WHERE f.unique_id = tr.unique_id)) AS z1 FROM tr WINDOW w AS (PARTITION BY unique_id ORDER BY a)),
ip AS (SELECT z.*, f.pos, f.flag, f.label FROM z JOIN fl f ON f.unique_id = z.unique_id AND f.pos BETWEEN z0 AND z1),
pp AS (SELECT unique_id, a, avg((greatest(a - greatest(a - pos, pos - b, 0) - z0, 0) + greatest(z1 - b - greatest(a - pos, pos - b, 0), 0)) / (z1 - z0 + 1)::DOUBLE) AS p FROM ip WHERE flag GROUP BY ALL),
nn AS (SELECT x.unique_id, x.a, x.z0, x.z1, x.pos, min(abs(x.pos - y.pos)) AS n FROM ip x LEFT JOIN ip y ON x.unique_id = y.unique_id AND x.a = y.a AND y.flag WHERE x.label GROUP BY ALL),
rr AS (SELECT unique_id, a, avg(coalesce(1 - (least(z1, pos + n) - greatest(z0, pos - n) + 1) / (z1 - z0 + 1)::DOUBLE, 0)) AS r FROM nn GROUP BY unique_id, a)"""


@query(f"""WITH {_FLAGS}, {_RANGES}, {_ZONES} SELECT rr.unique_id, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall, count(*)::BIGINT AS n_zones FROM rr LEFT JOIN pp ON pp.unique_id = rr.unique_id AND pp.a = rr.a GROUP BY rr.unique_id""")
def affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.affiliation(_flagged(spark, sf_dir)).drop("f1"), 4)


@query(f"WITH {_FLAGS} SELECT unique_id, round(count(*) FILTER (WHERE flag AND label) / nullif(count(*) FILTER (WHERE flag), 0)::DOUBLE, 4) AS precision, round(count(*) FILTER (WHERE flag AND label) / nullif(count(*) FILTER (WHERE label), 0)::DOUBLE, 4) AS recall FROM fl GROUP BY unique_id")
def point_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.point_precision_recall(_flagged(spark, sf_dir)).drop("f1"), 4)


_CURVE = f"""{_FLAGS}, ti AS (SELECT unique_id, coalesce(score, '-infinity'::DOUBLE) AS s, count(*) AS n, count(*) FILTER (WHERE label) AS k FROM fl GROUP BY ALL),
cu AS (SELECT unique_id, s, sum(k) OVER w / (sum(n) OVER w)::DOUBLE AS p, sum(k) OVER w / (sum(k) OVER (PARTITION BY unique_id))::DOUBLE AS r FROM ti WINDOW w AS (PARTITION BY unique_id ORDER BY s DESC))"""


@query(f"WITH {_CURVE}, g AS (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY unique_id ORDER BY s DESC), 0) AS d FROM cu) SELECT g.unique_id, round(sum(d * p), 4) AS area, any_value(b.base) AS baseline FROM g JOIN (SELECT unique_id, round(avg(label::INT), 4) AS base FROM fl GROUP BY unique_id) b USING (unique_id) GROUP BY g.unique_id")
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.auc_pr(_flagged(spark, sf_dir)).select("unique_id", "area", "baseline"), 4)


@query(f"WITH {_CURVE} SELECT unique_id, round(p, 4) AS precision, round(r, 4) AS recall, s AS threshold FROM cu WHERE s > -100")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.pr_curve(_flagged(spark, sf_dir)).where("threshold > -100"), 4)


def _vus(buffers: int) -> str:
    """The area for each series and buffer, as va."""
    return f"""vb AS (SELECT f.unique_id, f.pos, l, coalesce(f.score, '-infinity'::DOUBLE) AS s, least(any_value(f.label::INT) + coalesce(sum(sqrt(1 - greatest(a - pos, pos - b) / l::DOUBLE)), 0), 1) AS ext
  FROM fl f CROSS JOIN (SELECT unnest(range({buffers + 1})) AS l) LEFT JOIN tr ON tr.unique_id = f.unique_id AND greatest(a - pos, pos - b) BETWEEN 1 AND l // 2 GROUP BY ALL),
vt AS (SELECT unique_id, l, s, sum(ext) AS tp, count(*) AS n FROM vb GROUP BY ALL),
vk AS (SELECT unique_id, s, count(*) AS seen FROM (SELECT tr.unique_id, tr.island, max(coalesce(f.score, '-infinity'::DOUBLE)) AS s FROM tr JOIN fl f ON f.unique_id = tr.unique_id AND pos BETWEEN a AND b GROUP BY ALL) GROUP BY ALL),
vn AS (SELECT unique_id, sum(b - a + 1) AS positives, count(*) AS n_events FROM tr GROUP BY unique_id),
vc AS (SELECT t.unique_id, l, t.s, sum(tp) OVER w / sum(n) OVER w AS p, least(sum(tp) OVER w / ((l + 1) * positives), 1) * coalesce(sum(seen) OVER w, 0) / n_events AS r
  FROM vt t JOIN vn USING (unique_id) LEFT JOIN vk ON vk.unique_id = t.unique_id AND vk.s = t.s WINDOW w AS (PARTITION BY t.unique_id, l ORDER BY t.s DESC)),
vg AS (SELECT unique_id, l, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS g FROM vc WINDOW w AS (PARTITION BY unique_id, l ORDER BY s DESC)),
va AS (SELECT unique_id, l, sum(g) AS area FROM vg GROUP BY ALL)"""


@query(f"WITH {_FLAGS}, {_RANGES}, {_vus(8)} SELECT unique_id, round(avg(area), 4) AS vus_pr FROM va GROUP BY unique_id")
def vus_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.vus_pr(_flagged(spark, sf_dir), max_buffer=8), 4)


@query(f"WITH {_FLAGS}, {_RANGES}, {_vus(6)} SELECT unique_id, l::INT AS buffer, round(area, 4) AS area FROM va WHERE l = 6")
def range_auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.range_auc_pr(_flagged(spark, sf_dir), buffers=[6]), 4)


_DELAYS = """h AS (SELECT tr.unique_id, a, min(f.pos) AS first FROM tr LEFT JOIN fl f ON f.unique_id = tr.unique_id AND f.flag AND f.pos BETWEEN a AND b GROUP BY ALL),
fa AS (SELECT unique_id, count(*) AS n FROM fr WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.unique_id = fr.unique_id AND tr.a <= fr.b AND fr.a <= tr.b) GROUP BY unique_id)"""


@query(f"""WITH {_FLAGS}, {_RANGES}, {_DELAYS} SELECT h.unique_id, count(*)::BIGINT AS n_true_events, count(first)::BIGINT AS n_detected, round(avg(first - a), 4) AS mean_delay, any_value(coalesce(fa.n, 0))::BIGINT AS n_false_alarms FROM h LEFT JOIN fa ON fa.unique_id = h.unique_id GROUP BY h.unique_id""")
def detection_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.detection_delay(_flagged(spark, sf_dir), merge_gap=2).select("unique_id", "n_true_events", "n_detected", "mean_delay", "n_false_alarms"), 4)


@query(f"""WITH {SHIP}, bf AS (SELECT y FROM ship WHERE unique_id = 'A' AND ds < '1998-03-02' AND ds >= '1998-02-16'), sg AS (SELECT greatest(1.4826::DOUBLE * median(abs(y - (SELECT median(y) FROM bf))), 1e-8) AS s FROM bf)
SELECT unique_id, ds, round(CASE WHEN unique_id = 'A' AND ds BETWEEN '1998-03-02' AND '1998-03-11' THEN y + 3 * (SELECT s FROM sg) ELSE y END, 4) AS y FROM ship""")
def inject_level_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AnomalySpec("level_shift", "A", datetime(1998, 3, 2), 10, 3.0)
    return rounded(inject.inject(daily_shipments(spark, sf_dir), [spec], reference=14)[0], 4)


_SPECS = (
    ("spike", "A", datetime(1996, 5, 6), 2, 4.0, -1), ("level_shift", "N", datetime(1997, 2, 3), 10, 3.0, 1), ("variance_shift", "R", datetime(1998, 6, 1), 8, 2.5, 1),
    ("seasonal_phase", "A", datetime(1999, 3, 1), 7, 3.0, 1), ("sensor_freeze", "N", datetime(2000, 4, 3), 5, 1.0, 1), ("data_gap", "R", datetime(2001, 5, 7), 6, 1.0, 1),
)
_VALUES = ", ".join(f"('{k}', '{u}', TIMESTAMP '{t}', {n}, {m}, {d})" for k, u, t, n, m, d in _SPECS)


@query(f"""WITH {SHIP}, sp(kind, unique_id, t, n, m, d) AS (VALUES {_VALUES}),
mu AS (SELECT kind, median(y) AS mu FROM sp JOIN ship USING (unique_id) WHERE ds < t AND ds >= t - INTERVAL 14 DAY GROUP BY kind),
sg AS (SELECT kind, mu, greatest(1.4826 * median(abs(y - mu)), 1e-8) AS sigma FROM sp JOIN mu USING (kind) JOIN ship USING (unique_id) WHERE ds < t AND ds >= t - INTERVAL 14 DAY GROUP BY kind, mu),
hd AS (SELECT kind, y AS held FROM sp JOIN ship s ON s.unique_id = sp.unique_id AND s.ds = t),
nw AS (SELECT s.unique_id, s.ds, CASE WHEN kind IN ('spike', 'level_shift') THEN y + d * m * sigma WHEN kind = 'variance_shift' THEN mu + (y - mu) * m
    WHEN kind = 'seasonal_phase' THEN coalesce((SELECT any_value(e.y) FROM ship e WHERE e.unique_id = s.unique_id AND e.ds = s.ds - INTERVAL 3 DAY), y) WHEN kind = 'sensor_freeze' THEN held END AS z
  FROM sp JOIN ship s ON s.unique_id = sp.unique_id AND s.ds >= t AND s.ds < t + n * INTERVAL 1 DAY JOIN sg USING (kind) JOIN hd USING (kind))
SELECT s.unique_id, s.ds, round(CASE WHEN nw.ds IS NULL THEN y ELSE z END, 4) AS y FROM ship s LEFT JOIN nw ON nw.unique_id = s.unique_id AND nw.ds = s.ds""")
def inject_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of anomaly once, in one pass over the panel."""
    return rounded(inject.inject(daily_shipments(spark, sf_dir), [AnomalySpec(*s) for s in _SPECS], reference=14)[0], 4)


_SETS = "GROUP BY GROUPING SETS ((unique_id), ())"


@query(f"""WITH {_CURVE}, {_RANGES}, {_RP}, {_ZONES}, {_DELAYS}, {_vus(4)},
au AS (SELECT unique_id, sum(d * p) AS area FROM (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY unique_id ORDER BY s DESC), 0) AS d FROM cu) GROUP BY unique_id),
pt AS (SELECT unique_id, 'range_precision' AS metric, precision AS value FROM pc UNION ALL SELECT unique_id, 'range_recall', recall FROM rc
  UNION ALL SELECT unique_id, 'affiliation_precision', p FROM pp UNION ALL SELECT unique_id, 'affiliation_recall', r FROM rr UNION ALL SELECT unique_id, 'auc_pr', area FROM au
  UNION ALL SELECT unique_id, 'vus_pr', v FROM (SELECT unique_id, avg(area) AS v FROM va GROUP BY unique_id)
  UNION ALL SELECT unique_id, 'detection_rate', (first IS NOT NULL)::INT FROM h UNION ALL SELECT unique_id, 'detection_delay_mean', first - a FROM h WHERE first IS NOT NULL
  UNION ALL SELECT unique_id, 'auc_pr_baseline', label::INT FROM fl UNION ALL SELECT unique_id, 'point_precision', label::INT FROM fl WHERE flag UNION ALL SELECT unique_id, 'point_recall', flag::INT FROM fl WHERE label),
me AS (SELECT unique_id, metric, avg(value) AS value FROM pt GROUP BY GROUPING SETS ((unique_id, metric), (metric))),
md AS (SELECT unique_id, 'detection_delay_median' AS metric, median(first - a) AS value FROM h WHERE first IS NOT NULL {_SETS}),
co AS (SELECT unique_id, count(*) AS n_obs FROM fl {_SETS}), ne AS (SELECT unique_id, count(*) AS n_events FROM h {_SETS}),
al AS (SELECT co.unique_id, n_obs, coalesce((SELECT sum(n) FROM fa WHERE fa.unique_id = co.unique_id OR co.unique_id IS NULL), 0) AS n FROM co),
fs AS (SELECT a.unique_id, replace(a.metric, 'precision', 'f1') AS metric, CASE WHEN a.value + b.value > 0 THEN 2 * a.value * b.value / (a.value + b.value) ELSE 0 END AS value
  FROM me a JOIN me b ON a.unique_id IS NOT DISTINCT FROM b.unique_id AND b.metric = replace(a.metric, 'precision', 'recall') WHERE a.metric IN ('range_precision', 'affiliation_precision', 'point_precision') AND a.value IS NOT NULL AND b.value IS NOT NULL),
un AS (SELECT * FROM me UNION ALL SELECT * FROM md UNION ALL SELECT * FROM fs UNION ALL SELECT unique_id, 'n_false_alarm_events', n FROM al UNION ALL SELECT unique_id, 'false_alarms_per_1000', 1000 * n / n_obs::DOUBLE FROM al)
SELECT 'level' AS detector_id, un.unique_id, metric, round(value, 4) AS value, n_obs::BIGINT AS n_obs, coalesce(n_events, 0)::BIGINT AS n_events
FROM un JOIN co ON co.unique_id IS NOT DISTINCT FROM un.unique_id LEFT JOIN ne ON ne.unique_id IS NOT DISTINCT FROM un.unique_id WHERE value IS NOT NULL""")
def evaluate_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly_metrics.evaluate_detector(_flagged(spark, sf_dir), detector_id="level", max_buffer=4), 4)


# The same SQL, in which a series of each kind stands for itself, without what belongs to the other.
_KINDS = "fl AS (SELECT k || '|' || unique_id AS unique_id, ds, row_number() OVER (PARTITION BY k, unique_id ORDER BY ds) - 1 AS pos, flag, label, score, y FROM fl0 JOIN (VALUES ('even'), ('odd')) t(k) ON NOT label OR k = CASE WHEN month(ds) % 4 = 2 THEN 'odd' ELSE 'even' END)"
_BY_KIND = ORACLES["evaluate_detector"].replace("fl AS (SELECT s.unique_id", "fl0 AS (SELECT s.unique_id", 1).replace(", ti AS (", f", {_KINDS}, ti AS (", 1)


@query(f"""SELECT detector_id, split_part(unique_id, '|', 2) AS unique_id, split_part(unique_id, '|', 1) AS anomaly_type, metric, value, n_obs, n_events FROM ({_BY_KIND}) x
WHERE unique_id IS NOT NULL AND metric IN {anomaly_metrics.OF_KINDS}""")
def evaluate_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, delays and areas of each kind of anomaly by itself, series by series."""
    rows = _flagged(spark, sf_dir)
    kind = F.when(F.col("label"), F.when(F.month("ds") % 4 == 2, "odd").otherwise("even"))
    found = anomaly_metrics.evaluate_by_type(stored(rows.withColumn("anomaly_type", kind), "flags"), ("even", "odd"), detector_id="level", max_buffer=4)
    return rounded(found.where("anomaly_type <> 'all' AND unique_id IS NOT NULL"), 4)


@query(f"""WITH {EVT}, kn AS (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS x, count(*) OVER (PARTITION BY unique_id) AS n FROM evt WHERE y IS NOT NULL),
li AS (SELECT unique_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM kn GROUP BY unique_id), dt AS (SELECT unique_id, x, n, y - a - b * x AS e FROM kn JOIN li USING (unique_id) WHERE n >= 4),
fq AS (SELECT unique_id, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT unique_id, n FROM dt))
SELECT unique_id, round(n / k::DOUBLE, 4) AS period, round((sum(e * cos(2 * pi() * k * x / n)) ** 2 + sum(e * sin(2 * pi() * k * x / n)) ** 2) / n, 4) AS power FROM fq JOIN dt USING (unique_id, n) GROUP BY unique_id, n, k""")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsforge.functions.eda import periodogram as spectrum

    return rounded(spectrum(hourly_events(spark, sf_dir).df), 4)
