"""Queries on panels: alignment, quality, calendar, window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.functions import calendar
from tsforge.operators import align, features, quality
from tsforge.panel import Panel
from tsforge.plans.base import EVT, SHIP, query, rounded
from tsforge.sources.tables import daily_shipments, event_rows, hourly_events, table
from tsforge.spec import PanelSpec


@query(f"WITH {EVT} SELECT unique_id, ds, y FROM evt")
def grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).df.select("unique_id", "ds", "y")


@query(f"WITH {SHIP} SELECT min(ds) AS first_ds, max(ds) AS last_ds, count(*)::BIGINT AS n FROM ship WHERE ds BETWEEN '1996-01-01' AND '1996-12-31' AND unique_id IN ('A', 'N')")
def panel_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = daily_shipments(spark, sf_dir).select_ids(["A", "N"]).slice("1996-01-01", "1996-12-31")
    return part.df.agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.count("*").alias("n"))


_DAY = "SELECT event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, value AS y, event_id FROM events"


def _daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).withColumn("ds", F.date_trunc("day", "ds").cast("timestamp_ntz"))


@query(f"SELECT unique_id, ds, round(avg(y), 5) AS y FROM ({_DAY}) GROUP BY ALL")
def dedup_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.deduplicate(_daily_rows(spark, sf_dir)))


@query(f"SELECT unique_id, ds, round(arg_min(y, event_id), 5) AS y FROM ({_DAY}) GROUP BY ALL")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.deduplicate(_daily_rows(spark, sf_dir), policy="first", seq="event_id"))


@query(f"SELECT unique_id, ds, round(arg_max(y, event_id), 5) AS y FROM ({_DAY}) GROUP BY ALL")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.deduplicate(_daily_rows(spark, sf_dir), policy="last", seq="event_id"))


@query(f"WITH {EVT} SELECT unique_id, date_trunc('day', ds)::TIMESTAMP AS ds, round(avg(y), 5) AS y FROM evt GROUP BY ALL")
def resample_day_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(align.resample_mean(hourly_events(spark, sf_dir).df))


@query("""SELECT event_id, CASE WHEN ts >= '2024-03-31 02:00:00' AND ts < '2024-03-31 03:00:00' THEN NULL
  WHEN ts >= '2024-03-31 03:00:00' THEN ts - INTERVAL 2 HOUR ELSE ts - INTERVAL 1 HOUR END AS ds
FROM (SELECT event_id, ts + INTERVAL 75 DAY AS ts FROM events)""")
def wall_clock_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("unique_id", (F.col("ds") + F.expr("INTERVAL 75 DAYS")).cast("timestamp_ntz").alias("ds"), "event_id")
    return align.to_utc(rows, tz="Europe/Madrid", seq="event_id", by="event_id").select("event_id", "ds")


@query("""SELECT 'quantity_range' AS rule, count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 40)::BIGINT AS n_violations FROM lineitem
UNION ALL SELECT 'discount_range', count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05)::BIGINT FROM lineitem
UNION ALL SELECT 'flag_known', count(*) FILTER (WHERE NOT l_returnflag IN ('A', 'N'))::BIGINT FROM lineitem""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "quantity_range": F.col("l_quantity").between(1, 40), "discount_range": F.col("l_discount").between(0, 0.05), "flag_known": F.col("l_returnflag").isin("A", "N"),
    }
    return quality.rule_violations(table(spark, sf_dir, "lineitem"), rules)


_OUT = """med AS (SELECT *, median(y) OVER (PARTITION BY unique_id) AS m FROM evt),
mad AS (SELECT *, median(abs(y - m)) OVER (PARTITION BY unique_id) AS d FROM med),
outl AS (SELECT *, CASE WHEN d > 0 THEN (y - m) / (1.4826::DOUBLE * d) WHEN y IS NOT NULL THEN 0.0 END AS robust_z FROM mad)"""


@query(f"WITH {EVT}, {_OUT} SELECT unique_id, ds, y, round(robust_z, 5) AS robust_z FROM outl WHERE abs(robust_z) > 2.5")
def outliers_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.outliers(hourly_events(spark, sf_dir).df, threshold=2.5))


@query(f"""WITH {EVT}, {_OUT}, raw AS (SELECT event_type AS unique_id, date_trunc('hour', ts)::TIMESTAMP AS ds FROM events),
a AS (SELECT unique_id, min(ds) AS first_ds, max(ds) AS last_ds, count(*)::BIGINT AS n_raw, (count(*) - count(DISTINCT ds))::BIGINT AS n_duplicates FROM raw GROUP BY unique_id),
b AS (SELECT unique_id, count(*)::BIGINT AS n_aligned, (count(*) - count(y))::BIGINT AS n_gaps, (count(*) FILTER (WHERE y = 0))::BIGINT AS n_zeros FROM evt GROUP BY unique_id),
c AS (SELECT unique_id, (count(*) FILTER (WHERE abs(robust_z) > 4))::BIGINT AS n_outliers FROM outl GROUP BY unique_id)
SELECT a.*, n_aligned, n_gaps, n_zeros, n_outliers, (date_diff('hour', first_ds, last_ds) + 1)::BIGINT AS n_expected,
  round((n_aligned - n_gaps) / (date_diff('hour', first_ds, last_ds) + 1)::DOUBLE, 5) AS coverage FROM a JOIN b USING (unique_id) JOIN c USING (unique_id)""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = event_rows(spark, sf_dir).withColumn("ds", F.date_trunc("hour", "ds").cast("timestamp_ntz"))
    return rounded(quality.coverage(raw, hourly_events(spark, sf_dir).df, step_seconds=3600))


@query("""SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type, date_trunc('minute', ts)) AS n FROM events) WHERE n > 1""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("ds", F.date_trunc("minute", "ds").cast("timestamp_ntz"))
    return quality.duplicates(rows).select("event_id")


@query("""SELECT o_orderkey, hour(t)::SMALLINT AS hour, (isodow(t) - 1)::SMALLINT AS dayofweek, day(t)::SMALLINT AS day, month(t)::SMALLINT AS month, isodow(t) > 5 AS is_weekend,
  round(sin(2 * pi() * (isodow(t) - 1) / 7), 4) AS dayofweek_sin, round(cos(2 * pi() * (month(t) - 1) / 12), 4) AS month_cos
FROM (SELECT o_orderkey, o_orderdate + INTERVAL 13 HOUR AS t FROM orders)""")
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 13 HOURS")).cast("timestamp_ntz").alias("ds"))
    kept = ["o_orderkey", "hour", "dayofweek", "day", "month", "is_weekend", "dayofweek_sin", "month_cos"]
    return rounded(rows.select("o_orderkey", *calendar.calendar_columns()).select(*kept), 4)


@query(f"""WITH {EVT}, t AS (SELECT unique_id, ds, epoch(ds)::DOUBLE / 3600 AS h FROM evt)
SELECT unique_id, ds, round(sin(2 * pi() * h / 24), 4) AS fourier_day_sin_1, round(cos(2 * pi() * h / 24), 4) AS fourier_day_cos_1,
  round(sin(4 * pi() * h / 24), 4) AS fourier_day_sin_2, round(cos(4 * pi() * h / 24), 4) AS fourier_day_cos_2 FROM t""")
def fourier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly_events(spark, sf_dir).df.select("unique_id", "ds", *calendar.fourier_columns(periods={"day": 24.0})), 4)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m-%d') IN ('01-01', '12-25') AS is_holiday, strftime(o_orderdate + INTERVAL 1 DAY, '%m-%d') IN ('01-01', '12-25') AS is_holiday_eve FROM orders""")
def holiday_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1990, 2010).select(F.explode(F.array(F.make_date("id", F.lit(1), F.lit(1)), F.make_date("id", F.lit(12), F.lit(25)))).alias("day"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ds"))
    return calendar.with_holidays(rows, days).drop("ds")


@query(f"WITH {EVT} SELECT unique_id, ds, CASE WHEN y IS NOT NULL THEN greatest(18 - y, 0) END::DOUBLE AS y_hdd18, CASE WHEN y IS NOT NULL THEN greatest(y - 18, 0) END::DOUBLE AS y_cdd18 FROM evt")
def degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly_events(spark, sf_dir).df.select("unique_id", "ds", *calendar.degree_days("y")))


@query(f"""WITH {SHIP} SELECT unique_id, ds, lag(y, 1) OVER w AS y_lag1, lag(y, 7) OVER w AS y_lag7, y - lag(y, 1) OVER w AS y_diff1,
  round(CASE WHEN lag(y, 8) OVER w <> 0 THEN lag(y, 1) OVER w / lag(y, 8) OVER w - 1 END, 5) AS y_pct7_s1 FROM ship WINDOW w AS (PARTITION BY unique_id ORDER BY ds)""")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_shipments(spark, sf_dir)
    y = features.source(panel, "y")
    return rounded(features.feature_frame(panel, [features.lag(y, 1), features.lag(y, 7), features.diff(y), features.pct_change(y, 7)]))


_STATS = {"mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "sum": "sum(y)", "median": "median(y)"}


@query(f"WITH {SHIP} SELECT unique_id, ds, " + ", ".join(f"CASE WHEN count(y) OVER w = 7 THEN round({s} OVER w, 5) END AS y_roll{n}7_s1" for n, s in _STATS.items())
       + " FROM ship WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_shipments(spark, sf_dir)
    y = features.source(panel, "y")
    return rounded(features.feature_frame(panel, [features.roll(y, 7, stat=s) for s in _STATS]))


@query(f"WITH {SHIP} SELECT unique_id, ds, " + ", ".join(f"round({s} OVER w, 5) AS y_expand{n}_s1" for n, s in _STATS.items() if n in ("mean", "min", "max", "sum"))
       + " FROM ship WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def expanding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_shipments(spark, sf_dir)
    y = features.source(panel, "y")
    return rounded(features.feature_frame(panel, [features.expand(y, stat=s) for s in ("mean", "min", "max", "sum")]))


@query(f"""WITH {SHIP}, n AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS i FROM ship)
SELECT a.unique_id, a.ds, round(sum(b.y * 0.5::DOUBLE ** ((a.i - 1 - b.i) / 3.0::DOUBLE)) / sum(CASE WHEN b.y IS NOT NULL THEN 0.5::DOUBLE ** ((a.i - 1 - b.i) / 3.0::DOUBLE) END), 5) AS y_ewm3_s1
FROM n a LEFT JOIN n b ON a.unique_id = b.unique_id AND b.i < a.i AND b.i >= a.i - 180 GROUP BY a.unique_id, a.ds""")
def ewm_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_shipments(spark, sf_dir)
    return rounded(features.feature_frame(panel, [features.ewm(features.source(panel, "y"), halflife=3)]))


@query(f"""WITH {EVT}, h AS (SELECT hour(ds)::INT AS hour, isodow(ds) - 1 AS d, y FROM evt)
SELECT hour, """ + ", ".join(f"round(avg(y) FILTER (WHERE d = {d}), 5) AS d{d}" for d in range(7)) + " FROM h GROUP BY hour")
def hour_weekday_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly_events(spark, sf_dir).df.select(F.hour("ds").alias("hour"), F.concat(F.lit("d"), F.weekday("ds")).alias("d"), "y")
    return rounded(df.groupBy("hour").pivot("d", [f"d{d}" for d in range(7)]).avg("y"))


@query(f"WITH {SHIP} SELECT month(ds)::INT AS month, round(avg(y), 5) AS mean, round(quantile_cont(y, 0.1), 5) AS p10, round(quantile_cont(y, 0.9), 5) AS p90 FROM ship GROUP BY ALL")
def monthly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily_shipments(spark, sf_dir).df
    return rounded(df.groupBy(F.month("ds").alias("month")).agg(F.avg("y").alias("mean"), F.percentile("y", F.lit(0.1)).alias("p10"), F.percentile("y", F.lit(0.9)).alias("p90")))


@query(f"""WITH {SHIP}, c AS (SELECT unique_id, ds, y - avg(y) OVER (PARTITION BY unique_id) AS c FROM ship WHERE y IS NOT NULL),
k AS (SELECT unnest(range(1, 15)) AS lag), n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS i FROM c)
SELECT a.unique_id, lag::INT AS lag, round(sum(a.c * b.c) / any_value(v.v), 5) AS acf FROM n a CROSS JOIN k JOIN n b ON a.unique_id = b.unique_id AND b.i = a.i - lag
JOIN (SELECT unique_id, sum(c * c) AS v FROM c GROUP BY unique_id) v ON v.unique_id = a.unique_id GROUP BY a.unique_id, lag""")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsforge.functions.eda import autocorrelation

    return rounded(autocorrelation(daily_shipments(spark, sf_dir).df, max_lag=14))


@query("""SELECT event_type AS unique_id, date_trunc('day', ts)::TIMESTAMP AS ds, count(*)::BIGINT AS n, sum(len(props))::BIGINT AS n_chars FROM events GROUP BY ALL""")
def props_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ds")).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("n_chars"))


_DEGREES = "WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ds, avg(o_totalprice) / 10000 AS t FROM orders GROUP BY ALL), h AS (SELECT ds, t, greatest(18 - t, 0)::FLOAT AS hdd, greatest(t - 18, 0)::FLOAT AS cdd FROM d)"


@query(f"""{_DEGREES} SELECT 'all' AS unique_id, ds, round(t, 4) AS temp_c, round(hdd::DOUBLE, 4) AS temp_c_hdd18, round(cdd::DOUBLE, 4) AS temp_c_cdd18, """
       + ", ".join(f"round(lag({c}, {k}) OVER w, 4) AS {n}_lag{k}" for c, n in (("t", "temp_c"), ("hdd::DOUBLE", "temp_c_hdd18"), ("cdd::DOUBLE", "temp_c_cdd18")) for k in (1, 7)) + " FROM h WINDOW w AS (ORDER BY ds)")
def thermal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' mean price of a day stands for its temperature."""
    days = table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg((F.avg("o_totalprice") / 10000).alias("temp_c"), F.count("*").cast("double").alias("y"))
    panel = Panel(days.withColumn("unique_id", F.lit("all")), PanelSpec("orders", "D", (7,), futr_exog=("temp_c",)))
    return rounded(features.feature_frame(panel, features.thermal_features(panel, lags=(1, 7))), 4)


@query(f"""WITH {SHIP}, kn AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM ship WHERE y IS NOT NULL AND ds >= '2000-01-01'),
fr AS (SELECT *, n * 2 // 3 AS q, least(greatest(i - (n * 2 // 3) // 2, 0), n - n * 2 // 3) AS f FROM kn),
nb AS (SELECT a.unique_id, a.ds, a.i, b.i - a.i AS x, b.y, pow(1 - pow(abs(b.i - a.i) / greatest(a.i - a.f, a.f + a.q - 1 - a.i)::DOUBLE, 3), 3) AS w FROM fr a JOIN fr b ON b.unique_id = a.unique_id AND b.i BETWEEN a.f AND a.f + a.q - 1)
SELECT unique_id, ds, round((sum(w * y) * sum(w * x * x) - sum(w * x) * sum(w * x * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2), 4) AS fit FROM nb GROUP BY unique_id, ds""")
def lowess_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsforge.functions.eda import lowess_fit as fit

    return rounded(fit(daily_shipments(spark, sf_dir).df.where("ds >= '2000-01-01'")), 4)


@query("""WITH r AS (SELECT o_orderpriority AS model_id, month(o_orderdate)::SMALLINT AS window_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, o_orderkey % 3 = 0 AS refit, o_totalprice / 1000 AS s FROM orders)
SELECT model_id, NULL::BIGINT AS n_params, round(sum(s), 2) AS fit_seconds_total, round(avg(s) FILTER (WHERE refit), 2) AS fit_seconds_mean, round(sum(s / 2), 2) AS predict_seconds_total, round(avg(s / 2) FILTER (WHERE status = 'ok'), 2) AS predict_seconds_mean,
  count(*) FILTER (WHERE refit)::BIGINT AS n_refits, count(*) FILTER (WHERE status = 'ok')::BIGINT AS n_windows_ok, count(*) FILTER (WHERE status = 'failed')::BIGINT AS n_windows_failed, count(*) FILTER (WHERE status = 'skipped')::BIGINT AS n_windows_skipped,
  false AS is_zero_shot, 'fitted' AS training_regime FROM r WHERE window_id > 6 GROUP BY model_id""")
def run_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for runs: priorities for models, months for windows, prices for seconds."""
    from tsforge.operators.runs import timings

    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    seconds = F.col("o_totalprice") / 1000
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("model_id"), F.month("o_orderdate").cast("short").alias("window_id"), status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("refit"),
        seconds.alias("fit_seconds"), (seconds / 2).alias("predict_seconds"), F.lit(None).cast("long").alias("n_params"), F.lit(False).alias("is_zero_shot"),
    )
    windows = spark.range(1, 13).select(F.col("id").cast("short").alias("window_id"), F.when(F.col("id") > 6, "holdout").otherwise("dev").alias("stage"))
    return rounded(timings(runs, windows, stage="holdout"), 2)
