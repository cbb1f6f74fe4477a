"""Piecewise linear trends: conditions of the optimum, known changes, states, quantiles and windows."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_automodels import panel_of
from tsforge.functions import trend
from tsforge.operators import trends
from tsforge.panel import Panel
from tsforge.spec import BacktestPlan, PanelError, PanelSpec

DAYS = np.arange(400) * trend.DAY
WEEK = trend.Shape(seasons=((7.0, 2),))
NONE = np.empty((400, 0))


def broken(n=400, seed=1, noise=0.3):
    t = np.arange(n)
    return 20 + 0.05 * t - 0.15 * np.maximum(0, t - 150) + 3 * np.sin(2 * np.pi * t / 7) + noise * np.random.default_rng(seed).normal(size=n)


def test_changes_meet_the_conditions_of_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 12)), rng.normal(size=80) * 2
    gram, toward, penalty = x.T @ x, x.T @ y, 6.0
    d = trend.sparse_changes(gram, toward, penalty, np.zeros(12))
    slope = toward - gram @ d
    assert (np.abs(slope[d == 0]) <= penalty + 1e-6).all() and slope[d != 0] == pytest.approx(penalty * np.sign(d[d != 0]), abs=1e-5) and 0 < (d == 0).sum() < 12
    value = lambda v: v @ gram @ v / 2 - toward @ v + penalty * np.abs(v).sum()
    assert all(value(d) <= value(d + rng.normal(size=12) * s) for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_a_known_change_is_found_and_most_others_are_nothing():
    y = broken()
    fit = trend.fit(DAYS, y, NONE, WEEK)
    slope = lambda a, b: np.diff(fit.scale * fit.trend(np.array([a, b]) / 399))[0] / (b - a)
    assert slope(20, 120) == pytest.approx(0.05, abs=0.01) and slope(200, 380) == pytest.approx(-0.1, abs=0.01)
    assert (np.abs(fit.changes) < 1e-3).sum() >= 18 and len(fit.changes) == 25
    late = DAYS + 400 * trend.DAY
    want = 20 + 0.05 * (400 + np.arange(400)) - 0.15 * (250 + np.arange(400)) + 3 * np.sin(2 * np.pi * (400 + np.arange(400)) / 7)
    assert np.abs(fit.predict(WEEK, late, NONE) - want)[:60].max() < 2
    assert fit.scale * fit.noise == pytest.approx(0.3, rel=0.25)


def test_the_whole_objective_is_at_its_least():
    y, fit = broken(), trend.fit(DAYS, broken(), NONE, WEEK, rounds=50)
    t = DAYS / DAYS[-1]
    base, hinges = np.column_stack([np.ones(400), t, WEEK.waves(DAYS)]), np.maximum(0, t[:, None] - fit.places)
    ridge = np.r_[1e-6, 1e-6, np.full(base.shape[1] - 2, 1 / 100)]

    def loss(w, d):
        e = y / fit.scale - base @ w - hinges @ d
        return e @ e / (2 * fit.noise**2) + (ridge * w * w).sum() / 2 + np.abs(d).sum() / WEEK.change_scale

    rng, best = np.random.default_rng(1), loss(fit.base, fit.changes)
    assert all(best <= loss(fit.base + rng.normal(size=len(fit.base)) * s, fit.changes + rng.normal(size=25) * s) + 1e-3 for s in (1e-4, 1e-3, 1e-2) for _ in range(100))


def test_states_round_trip_and_quantiles_widen():
    regressors = np.column_stack([np.random.default_rng(2).normal(10, 3, 400), (np.arange(400) % 50 == 0).astype(float)])
    y = broken() + 0.5 * regressors[:, 0] + 6 * regressors[:, 1]
    fit = trend.fit(DAYS, y, regressors, WEEK)
    again = trend.Fit.of(fit.numbers())
    assert again.predict(WEEK, DAYS, regressors) == pytest.approx(fit.predict(WEEK, DAYS, regressors))
    assert fit.scale * fit.base[-2] / fit.centres[0, 1] == pytest.approx(0.5, abs=0.05) and fit.scale * fit.base[-1] == pytest.approx(6, abs=0.5)
    ahead, inputs = DAYS + DAYS[-1] + trend.DAY, regressors
    paths = fit.samples(WEEK, ahead, inputs, n=400, rng=np.random.default_rng(3))
    spread = np.quantile(paths, 0.9, axis=0) - np.quantile(paths, 0.1, axis=0)
    assert spread[:5].mean() == pytest.approx(2 * 1.2816 * fit.noise * fit.scale, rel=0.2) and spread[-20:].mean() > 1.5 * spread[:5].mean()
    flat = trend.fit(DAYS[:30], np.full(30, 5.0), np.empty((30, 0)), WEEK)
    assert flat.predict(WEEK, DAYS[:40], np.empty((40, 0))) == pytest.approx(np.full(40, 5.0), abs=1e-3)


def test_backtests_refit_by_the_plan_and_repeat_their_draws(spark):
    y = broken(200)
    panel = panel_of(spark, {"a": np.where(np.arange(200) % 17 == 3, np.nan, y), "b": y[::-1] + 5, "few": np.r_[np.full(190, np.nan), np.arange(10.0)]})
    model, plan = trends.TrendModel(WEEK, samples=50, seed=4), BacktestPlan(h=5, n_windows=4, refit_every=2)
    run = trends.trend_backtest(panel, plan, model)
    got = run.forecasts.toPandas().set_index(["unique_id", "window_id", "h_step"]).sort_index()
    again = trends.trend_backtest(Panel(panel.df.repartition(6), panel.spec), plan, model).forecasts.toPandas().set_index(["unique_id", "window_id", "h_step"]).sort_index()
    assert got.equals(again) and set(got.index.get_level_values(0)) == {"a", "b"} and len(got) == 2 * 4 * 5
    assert [(r["refit"], r["fit_window"], r["status"]) for r in run.model_runs.orderBy("window_id").collect()] == [(True, 0, "ok"), (False, 0, "ok"), (True, 2, "ok"), (False, 2, "ok")]
    assert (got["q_9000"] >= got["q_1000"]).all()
    values = panel.df.where("unique_id = 'a'").orderBy("ds").toPandas()
    at = (values["ds"] - pd.Timestamp("1970-01-01")).dt.total_seconds().to_numpy()
    for window in range(4):
        end = 200 - 5 * (4 - window // 2 * 2)
        fit = trend.fit(at[:end], values["y"].to_numpy(float)[:end], np.empty((end, 0)), WEEK)
        first = 200 - 5 * (4 - window)
        want = fit.predict(WEEK, at[first : first + 5], np.empty((5, 0)))
        assert got.loc[("a", window), "y_hat"].to_numpy() == pytest.approx(want)
        paths = fit.samples(WEEK, at[first : first + 5], np.empty((5, 0)), n=50, rng=model.draws("a", at[first - 1]))
        assert got.loc[("a", window), "q_9000"].to_numpy() == pytest.approx(np.quantile(paths, 0.9, axis=0))


def test_regressors_and_holidays(spark):
    t, rng = np.arange(120), np.random.default_rng(5)
    warm = rng.normal(15, 4, 120)
    days = pd.date_range("2024-01-01", periods=120)
    holidays = tuple(d.date() for d in days[::13])
    y = 10 + 0.4 * warm + 5 * np.isin(t, t[::13]) + rng.normal(size=120) * 0.1
    rows = [("s", d.to_pydatetime(), float(v), float(w)) for d, v, w in zip(days, y, warm, strict=True)]
    panel = Panel(spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double, warm double"), PanelSpec("t", "D", (7,), futr_exog=("warm",)))
    model = trends.TrendModel(trend.Shape(seasons=(), changes=5), regressors=("warm",), holidays=holidays, samples=20)
    got = trends.trend_backtest(panel, BacktestPlan(h=20, n_windows=1), model).forecasts.toPandas()
    assert len(got) == 20 and np.abs(got["y"] - got["y_hat"]).max() < 0.6
    with pytest.raises(PanelError):
        trends.trend_backtest(panel, BacktestPlan(h=20, n_windows=1), trends.TrendModel(regressors=("cold",)))
    with pytest.raises(ValueError):
        trends.TrendModel(samples=0)
    assert model.inputs(np.array([0.0, 86400.0]), [[1.0, 2.0]]).shape == (2, 2) and date(1970, 1, 2) not in holidays
    assert panel.df.select(F.count("*")).first()[0] == 120
