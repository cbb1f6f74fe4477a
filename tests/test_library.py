"""Small cases of the panel library that the tables don't hold."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsforge.functions import eda, stats
from tsforge.functions.eda import autocorrelation, partial_autocorrelation
from tsforge.operators import align, anomaly_metrics, asof, backtest, events, features, models, quality, runs, split
from tsforge.operators.inject import AnomalySpec, inject
from tsforge.panel import Panel, build_panel, violations
from tsforge.spec import BacktestPlan, FeatureSpec, LeakError, PanelError, PanelSpec, interval_levels, quantile_column, usable_features

T0 = datetime(2024, 1, 1)


def frame(spark, values, uid="a", hours=True):
    step = timedelta(hours=1) if hours else timedelta(days=1)
    rows = [(uid, T0 + i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def panel(spark, values, **spec):
    return Panel(frame(spark, values), PanelSpec("t", **{"seasonalities": (3,), **spec}))


def test_clock_changes_to_utc(spark):
    wall = [datetime(2024, 10, 27, 1), datetime(2024, 10, 27, 2), datetime(2024, 10, 27, 2), datetime(2024, 10, 27, 3), datetime(2024, 3, 31, 2, 30)]
    rows = spark.createDataFrame([("a", t, i) for i, t in enumerate(wall)], "unique_id string, ds timestamp_ntz, seq int")
    got = [r["ds"] for r in align.to_utc(rows, tz="Europe/Madrid", seq="seq").orderBy("seq").collect()]
    assert got == [datetime(2024, 10, 26, 23), datetime(2024, 10, 27, 0), datetime(2024, 10, 27, 1), datetime(2024, 10, 27, 2), None]


def test_specs():
    with pytest.raises(PanelError):
        PanelSpec("x", seasonalities=(24, 24))
    with pytest.raises(PanelError):
        PanelSpec("x", futr_exog=("y",))
    spec = PanelSpec("x", futr_exog=("t",), hist_exog=("v",))
    assert spec.max_lead("t") == math.inf and spec.max_lead("v") == 0
    with pytest.raises(LeakError):
        FeatureSpec("y").led(1, "z")
    assert usable_features([FeatureSpec("a", 3), FeatureSpec("b", 1, True)], 2) == [FeatureSpec("a", 3)]
    assert quantile_column(0.025) == "q_0250" and interval_levels()[0] == (95, 0.025, 0.975)


def test_panel_invariants(spark):
    good = frame(spark, [1.0] * 30)
    assert build_panel(good, PanelSpec("t", seasonalities=(24,))).df.count() == 30
    holes = good.where(F.hour("ds") != 5)
    assert {r["rule"] for r in violations(holes.union(holes.limit(1)), PanelSpec("t", seasonalities=(24,))).collect()} == {"unique_key", "complete_grid"}
    with pytest.raises(PanelError):
        build_panel(holes, PanelSpec("t"))


@pytest.mark.parametrize("cut", [5, 9, 14])
def test_features_of_a_prefix_are_the_prefix_of_features(spark, cut):
    values = [float((i * 7) % 11) if i % 6 else None for i in range(20)]

    def made(vs):
        p = panel(spark, vs)
        y = features.source(p, "y")
        some = [features.lag(y, 2), features.roll(y, 3), features.roll(y, 3, stat="median"), features.expand(y, stat="std"), features.ewm(y, halflife=2), features.diff(y)]
        return features.feature_frame(p, some).orderBy("ds").toPandas()

    pd.testing.assert_frame_equal(made(values).head(cut), made(values[:cut]))


def test_ewm_equals_pandas(spark):
    values = [3.0, None, 5.0, 1.0, None, 2.0, 8.0]
    p = panel(spark, values)
    got = features.feature_frame(p, [features.ewm(features.source(p, "y"), halflife=2)]).orderBy("ds").toPandas().iloc[:, 2]
    want = pd.Series(values, dtype=float).shift(1).ewm(halflife=2).mean()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy())


def test_ewm_carries_over_any_gap(spark):
    values = [1.0, 5.0, *[None] * 90, 3.0, *[None] * 70, 2.0]
    p = panel(spark, values)
    got = features.feature_frame(p, [features.ewm(features.source(p, "y"), halflife=1)]).orderBy("ds").toPandas().iloc[:, 2]
    np.testing.assert_allclose(got.to_numpy(float), pd.Series(values, dtype=float).shift(1).ewm(halflife=1).mean())


def test_feature_sets(spark):
    rows = frame(spark, [float(i) for i in range(60)]).withColumn("temp_c", F.col("y") / 2)
    p = Panel(rows, PanelSpec("t", seasonalities=(24,), futr_exog=("temp_c",)))
    got = features.feature_set(p, 24, temperature="temp_c")
    assert {"y_lag24", "y_lag48", "temp_c_hdd18", "temp_c_lag1", "fourier_24h_sin_1", "hour"} <= set(got.columns)
    assert not {"y_lag1", "y_lag2", "y_rollmean24_s1"} & set(got.columns) and got.count() == 60
    row = got.orderBy("ds").collect()[50]
    assert row["y_lag24"] == 26.0 and row["temp_c_cdd18"] == 7.0 and row["temp_c_hdd18_lag1"] == 0.0
    with pytest.raises(LeakError):
        features.lead(features.source(p, "y"), 1)


def test_loess_equals_weighted_lines():
    rng = np.random.default_rng(4)
    y = rng.normal(size=41)
    for span in (5, 12, 41):
        got = eda.loess(y, span)
        for i in range(41):
            first = min(max(i - span // 2, 0), 41 - span)
            x = np.arange(first, first + span)
            far = max(abs(x - i).max(), 1e-9)
            w = (1 - (abs(x - i) / far) ** 3) ** 3
            slope, level = np.polyfit(x - i, y[x], 1, w=np.sqrt(w))
            assert math.isclose(got[i], level, abs_tol=1e-9)


def test_decomposition_finds_its_parts(spark):
    t = np.arange(24 * 28)
    trend, day, week = 10 + 0.01 * t, 3 * np.sin(2 * np.pi * t / 24), np.where(t % 168 < 48, -2.0, 0.8)
    rng = np.random.default_rng(5)
    y = trend + day + week + rng.normal(scale=0.1, size=len(t))
    got = eda.decomposition(frame(spark, y.tolist())).orderBy("ds").toPandas()
    np.testing.assert_allclose(got[["trend", "seasonal_24", "seasonal_168", "remainder"]].sum(axis=1), y)
    inner = slice(48, -48)
    assert np.abs(got["seasonal_24"][inner] - day[inner]).max() < 0.6 and np.corrcoef(got["seasonal_168"][inner], week[inner])[0, 1] > 0.95
    assert np.abs(got["trend"][inner] - trend[inner]).max() < 0.5 and got["remainder"][inner].std() < 0.4
    hard = eda.difficulty(eda.decomposition(frame(spark, y.tolist()))).first()
    assert hard["strength_24"] > 0.9 and hard["strength_168"] > 0.8
    noise = eda.difficulty(eda.decomposition(frame(spark, rng.normal(size=len(t)).tolist()))).first()
    assert noise["strength_24"] < hard["strength_24"] and noise["trend_strength"] < 0.6


def test_partial_gaps_and_random_directions(spark):
    p = panel(spark, [float(i % 5) for i in range(60)])
    gap = AnomalySpec("data_gap", "a", T0 + timedelta(hours=20), 10, 0.4)
    rows, truth = inject(p, [gap], reference=10)
    assert rows.where("y IS NULL").count() == truth.count() == 4
    shift = AnomalySpec("level_shift", "a", T0 + timedelta(hours=30), 5, 3.0, 0)
    assert {inject(p, [shift], reference=10, seed=s)[0].agg(F.sum("y") > 120).first()[0] for s in range(8)} == {True, False}


def test_boosted_forecasts_bridge_gaps(spark):
    y = [10 + 3.0 * (i % 7) if i % 9 else None for i in range(120)]
    y[100:112] = [None] * 12
    p = Panel(frame(spark, y, hours=False).union(frame(spark, [None] * 120, "empty", hours=False)), PanelSpec("t", "D", (7,)))
    plan = BacktestPlan(h=3, n_windows=1)
    made = models.boosted_direct(p, plan, trees=3, depth=2)
    assert sorted((r["unique_id"], r["h_step"]) for r in made.collect()) == [("a", 1), ("a", 2), ("a", 3)]
    assert [tuple(r) for r in models.without_forecast(p, made, split.windows(p, plan)).collect()] == [("empty", 0)]


def test_forecasters_run_and_fail_apart(spark, tmp_path):
    p = panel(spark, [float(i) for i in range(30)])
    plan = BacktestPlan(h=2, n_windows=2)

    def steps(window):
        first, last = (F.lit(window[c]).cast("timestamp_ntz") for c in ("first_pred", "last_pred"))
        return F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))

    def last(train, window, ahead):
        level = train.df.groupBy("unique_id").agg(F.max_by("y", "ds").alias("y_hat"))
        return level.select("unique_id", F.explode(steps(window)).alias("ds"), "y_hat", (F.col("y_hat") + 1).alias("q_0250"), F.col("y_hat").alias("q_5000"))

    def broken(train, window, ahead):
        raise ArithmeticError("no")

    def short(train, window, ahead):
        return last(train, window, ahead).limit(1)

    run = runs.run_forecasters(p, plan, {"last": last, "broken": broken, "short": short}, str(tmp_path))
    told = {(r["model_id"], r["window_id"]): (r["status"], r["error"], r["quantile_crossings"]) for r in run.model_runs.collect()}
    assert told["last", 0] == ("ok", None, 2) and told["broken", 1] == ("failed", "ArithmeticError: no", 0) and told["short", 0] == ("failed", "n_absent 1", 0)
    got = sorted((r["window_id"], r["h_step"], r["y_hat"], r["y"], r["q_0250"], r["q_5000"], r["q_9750"]) for r in run.forecasts.collect())
    assert got == [(0, 1, 25.0, 26.0, 25.0, 26.0, None), (0, 2, 25.0, 27.0, 25.0, 26.0, None), (1, 1, 27.0, 28.0, 27.0, 28.0, None), (1, 2, 27.0, 29.0, 27.0, 28.0, None)]
    cost = {r["model_id"]: r for r in runs.timings(run.model_runs, run.windows).collect()}
    assert (cost["last"]["n_windows_ok"], cost["broken"]["n_windows_failed"]) == (2, 2) and cost["last"]["fit_seconds_total"] > 0

    def leaky(train, window, ahead):
        return last(train, window, ahead).withColumn("ds", F.lit(window["cutoff"]).cast("timestamp_ntz"))

    with pytest.raises(LeakError):
        runs.run_forecasters(p, plan, {"leaky": leaky}, str(tmp_path / "l"))
    with pytest.raises(PanelError):
        runs.normalise_prediction(p.df, plan)
    board = spark.createDataFrame([("m", None, 2.0), ("k", None, None), ("b", None, 1.0)], "model_id string, unique_id string, mase double")
    assert [r["model_id"] for r in runs.ranked(board).orderBy("place").collect()] == ["b", "m", "k"]


def test_support_vintages_and_clock_changes(spark):
    rows = [(d, "a", T0 + timedelta(hours=h), ok, float(h), h == 2) for d, hs in (("x", (0, 1, 2)), ("y", (0, 1))) for h in hs for ok in [not (d == "y" and h == 1)]]
    scores = spark.createDataFrame(rows, "detector_id string, unique_id string, ds timestamp_ntz, scorable boolean, score double, is_anomaly boolean")
    common = {r["ds"].hour: (r["scorable"], r["aligned"]) for r in anomaly_metrics.common_support(scores).collect()}
    assert common == {0: (True, True), 1: (False, True), 2: (True, False)}
    marked = anomaly_metrics.support_rows(scores.where("detector_id = 'x'"), scores.where("detector_id = 'x'"), alpha=0.05).orderBy("pos").collect()
    assert [(r["pos"], r["flag"], r["label"]) for r in marked] == [(0, False, False), (1, False, False), (2, True, True)]
    cuts = spark.createDataFrame([(0, T0, T0 + timedelta(hours=2))], "window_id int, cutoff timestamp_ntz, last_pred timestamp_ntz")
    known = [("a", T0 + timedelta(hours=1), T0 - timedelta(hours=k), float(k)) for k in (3, 1, -1)] + [("a", T0 + timedelta(hours=9), T0, 7.0)]
    seen = asof.vintages_at(spark.createDataFrame(known, "unique_id string, ds timestamp_ntz, as_of timestamp_ntz, v double"), cuts, value="v").collect()
    assert [(r["v"], r["as_of"]) for r in seen] == [(1.0, T0 - timedelta(hours=1))]
    wall = frame(spark, [1.0] * 48)
    changes = spark.createDataFrame([(T0 + timedelta(hours=25),), (T0 + timedelta(days=9),)], "transition timestamp_ntz")
    aligned = wall.withColumn("y", F.when(F.col("ds") != T0 + timedelta(hours=24), F.col("y"))).union(wall.where(F.col("ds") == T0 + timedelta(hours=26)))
    told = {r["transition"]: (r["n_raw"], r["n_duplicates"], r["n_nulls"]) for r in quality.clock_changes(wall, aligned, changes).collect()}
    assert told == {T0 + timedelta(hours=25): (24, 2, 1), T0 + timedelta(days=9): (0, 0, 0)}


def test_biased_ranges_by_hand(spark):
    rows = marks(spark, [0, 1, 1, 0, 0, 0], [0, 1, 1, 1, 1, 0])
    recall = {b: anomaly_metrics.range_precision_recall(rows, bias=b, cardinality="one").first()["recall"] for b in anomaly_metrics.BIASES}
    assert recall == {"flat": 0.5, "front": 0.7, "back": 0.3, "middle": 0.5}
    with pytest.raises(ValueError):
        anomaly_metrics.range_parts(rows, bias="none")


def test_pooled_metrics_pool_ranges(spark):
    one = marks(spark, [0, 1, 0, 0], [0, 1, 0, 0])
    three = marks(spark, [0, 0, 0, 0, 1, 0, 0, 0], [1, 0, 1, 0, 1, 0, 0, 1]).withColumn("unique_id", F.lit("b"))
    got = {(r["unique_id"], r["metric"]): r["value"] for r in anomaly_metrics.evaluate_detector(one.union(three), detector_id="d", merge_gap=0, max_buffer=2).collect()}
    assert (got["a", "range_recall"], got["b", "range_recall"], got[None, "range_recall"]) == (1.0, 0.25, 0.4)
    assert (got["a", "detection_rate"], got["b", "detection_rate"], got[None, "detection_rate"]) == (1.0, 0.25, 0.4)
    assert got[None, "auc_pr"] == (got["a", "auc_pr"] + got["b", "auc_pr"]) / 2


def test_baselines_by_hand(spark):
    run = backtest.backtest(panel(spark, [float(v) for v in (1, 2, 4, 2, 3, 5, 3, 4, 6, 9, 9, 9)]), BacktestPlan(h=3, n_windows=1))
    rows = {(r["model_id"], r["h_step"]): r for r in run.forecasts.collect()}
    assert [rows["seasonal_naive", h]["y_hat"] for h in (1, 2, 3)] == [3, 4, 6]
    assert rows["naive", 2]["y_hat"] == 6 and math.isclose(rows["drift", 2]["y_hat"], 6 + 2 * 5 / 8)
    assert math.isclose(rows["naive", 3]["sigma"], np.std(np.diff([1, 2, 4, 2, 3, 5, 3, 4, 6]), ddof=1) * math.sqrt(3))
    assert all(r["ds"] > r["cutoff"] for r in rows.values()) and rows["naive", 1]["y"] == 9


def test_short_and_missing_series_are_rows(spark):
    gaps = frame(spark, [None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], "b")
    p = Panel(frame(spark, [1.0] * 7).union(gaps), PanelSpec("t", seasonalities=(3,)))
    runs = {r["model_id"]: r["status"] for r in backtest.backtest(p, BacktestPlan(h=2, n_windows=1)).model_runs.collect()}
    assert runs["naive"] == "failed"
    assert split.windows(p, BacktestPlan(h=9, n_windows=2)).count() == 0


def test_prediction_faults(spark):
    p = panel(spark, [1.0] * 12)
    table = split.windows(p, BacktestPlan(h=2, n_windows=1))
    bad = spark.createDataFrame([("a", 0, T0), ("a", 0, T0 + timedelta(hours=10)), ("z", 0, T0 + timedelta(hours=11))], "unique_id string, window_id short, ds timestamp_ntz")
    got = backtest.prediction_faults(bad, table, p.ids(), h=2).first().asDict()
    assert got == {"window_id": 0, "n_leaks": 1, "n_repeated": 0, "n_outside": 1, "n_unknown": 1, "n_absent": 0}


def test_student_tail_and_adjustment(spark):
    assert math.isclose(stats.student_tail(2.228138852, 10), 0.025, rel_tol=1e-6)
    assert math.isclose(stats.student_tail(0.5, 3), 0.32572, rel_tol=1e-4)
    tests = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03)], "model_a string, model_b string, p_value double")
    holm = {r["model_b"] + r["model_a"]: r["p_value_adjusted"] for r in stats.adjust(tests).collect()}
    assert np.allclose([holm["ba"], holm["cb"], holm["ca"]], [0.03, 0.06, 0.06])


def test_partial_autocorrelation_of_a_first_order_series(spark):
    rng, y = np.random.default_rng(0), [0.0]
    for e in rng.normal(size=800):
        y.append(0.7 * y[-1] + float(e))
    got = partial_autocorrelation(autocorrelation(frame(spark, y), max_lag=4)).orderBy("lag").toPandas()["pacf"]
    assert abs(got[0] - 0.7) < 0.08 and abs(got[1]) < 0.1


def marks(spark, flags, labels, scores=None):
    rows = [("a", i, bool(f), bool(g), float(s)) for i, (f, g, s) in enumerate(zip(flags, labels, scores or flags, strict=True))]
    return spark.createDataFrame(rows, "unique_id string, pos int, flag boolean, label boolean, score double")


def test_anomaly_metrics_by_hand(spark):
    rows = marks(spark, [0, 1, 1, 0, 0, 0, 1, 0], [0, 0, 1, 1, 0, 0, 0, 0])
    got = anomaly_metrics.range_precision_recall(rows).first()
    assert got["recall"] == 0.5 and got["precision"] == 0.25
    delay = anomaly_metrics.detection_delay(rows).first()
    assert (delay["n_detected"], delay["mean_delay"], delay["n_false_alarms"]) == (1, 0, 1)
    perfect = marks(spark, [0, 1, 1, 0], [0, 1, 1, 0])
    # In a zone of four, flags on the event leave 2 of 4 places farther off and cover 1 of 4.
    assert math.isclose(anomaly_metrics.affiliation(perfect).first()["f1"], 0.6)
    assert anomaly_metrics.auc_pr(perfect).first()["area"] == 1.0
    assert anomaly_metrics.vus_pr(perfect, max_buffer=0).first()["vus_pr"] == 1.0


def test_matching_is_one_to_one(spark):
    cols = "unique_id string, event_id string, start_ds timestamp_ntz, end_ds timestamp_ntz"
    h = timedelta(hours=1)
    found = spark.createDataFrame([("a", "d1", T0, T0 + 4 * h), ("a", "d2", T0 + 5 * h, T0 + 6 * h), ("a", "d3", T0 + 20 * h, T0 + 20 * h)], cols)
    truth = spark.createDataFrame([("a", "t1", T0 + 1 * h, T0 + 6 * h), ("a", "t2", T0 + 40 * h, T0 + 41 * h)], cols)
    got = {(r["event_id"], r["matched_truth_event_id"]): r["match_kind"] for r in events.match_events(found, truth).collect()}
    assert got == {("d1", "t1"): "hit", ("d2", None): "false_alarm", ("d3", None): "false_alarm", (None, "t2"): "missed"}


def test_series_models_equal_plain_loops(spark):
    from tsforge.operators import models

    values = [10 + (k % 3) * 2 + k * 0.1 + (k * 7 % 5) * 0.3 for k in range(60)]
    panel = Panel(frame(spark, values), PanelSpec("t", seasonalities=(3,)))
    plan = BacktestPlan(h=4, n_windows=2)
    got = {(r["model_id"], r["window_id"], r["h_step"]): r["y_hat"] for r in models.backtest_series(panel, plan).collect()}
    assert len(got) == 3 * 2 * 4

    def smoothed(y):
        def loss(a):
            level, total = y[0], 0.0
            for v in y[1:]:
                total += (v - level) ** 2
                level += a * (v - level)
            return total, level

        return min(loss(a) for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9))[1]

    for window in (0, 1):
        y = np.array(values[: 60 - 4 * (2 - window)])
        n, m = len(y), 3
        shape = [np.mean([v - y.mean() for v in y[k::m]]) for k in range(m)]
        flat = np.array([v - shape[k % m] for k, v in enumerate(y)])
        slope = np.cov(np.arange(n), flat, bias=True)[0, 1] / np.var(np.arange(n))
        for h in range(1, 5):
            season = shape[(n + h - 1) % m]
            assert got["ets", window, h] == pytest.approx(smoothed(flat) + season)
            assert got["theta", window, h] == pytest.approx(smoothed(flat) + slope / 2 * h + season)
        columns = lambda t: [1.0, t / n, np.sin(2 * np.pi * t / m), np.cos(2 * np.pi * t / m)]
        x = np.array([columns(t) for t in range(n)])
        stacked = np.vstack([x, np.diag([0.0, 1.0, 1.0, 1.0])])
        w = np.linalg.lstsq(stacked, np.r_[y, np.zeros(4)], rcond=None)[0]
        for h in range(1, 5):
            assert got["ridge_fourier", window, h] == pytest.approx(np.array(columns(n + h - 1)) @ w)
