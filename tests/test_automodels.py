"""Models that choose their own form: likelihoods, orders, refits and intervals against plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsforge.functions import arima, ets
from tsforge.functions.optimise import least_squares, minimise
from tsforge.operators import automodels
from tsforge.operators.runs import Stateful, run_forecasters
from tsforge.panel import Panel
from tsforge.spec import BacktestPlan, PanelSpec


def simulated(ar, ma, n, seed, d=0, mean=0.0):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(n + 200):
        x[t] = e[t] + sum(a * x[t - 1 - i] for i, a in enumerate(ar) if t > i) + sum(b * e[t - 1 - j] for j, b in enumerate(ma) if t > j)
    y = x[200:] + mean
    return np.cumsum(y) if d else y


def panel_of(spark, series, m=7):
    days = pd.date_range("2024-01-01", periods=max(map(len, series.values())))
    rows = [(k, d.to_pydatetime(), None if np.isnan(v) else float(v)) for k, y in series.items() for d, v in zip(days, y, strict=False)]
    return Panel(spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double"), PanelSpec("made", "D", (m,)))


@pytest.mark.parametrize(("ar", "ma"), [([0.5, -0.3], [0.4]), ([], [0.7, 0.2]), ([0.9], []), ([0.6, 0, 0, 0.2, -0.12], [0.3, 0, 0, 0.1])])
def test_exact_likelihood_equals_the_dense_one(ar, ma):
    w = np.random.default_rng(3).normal(size=100)
    psi = np.zeros(3000)
    psi[0] = 1
    for k in range(1, 3000):
        psi[k] = (ma[k - 1] if k <= len(ma) else 0) + sum(a * psi[k - 1 - i] for i, a in enumerate(ar) if k > i)
    cover = np.array([psi[: 3000 - k] @ psi[k:] for k in range(100)])[np.abs(np.subtract.outer(np.arange(100), np.arange(100)))]
    variance = w @ np.linalg.solve(cover, w) / 100
    dense = -0.5 * (100 * (math.log(2 * math.pi * variance) + 1) + np.linalg.slogdet(cover)[1])
    got, s2, e = arima.exact_likelihood(w, np.array(ar, float), np.array(ma, float))
    assert got == pytest.approx(dense, abs=1e-5) and s2 == pytest.approx(variance, rel=1e-6) and len(e) == 100


def test_minimisers_find_known_places():
    x, value = minimise(lambda x: (x[0] - 3) ** 2 + 10 * (x[1] - x[0] ** 2) ** 2, np.array([0.0, 0.0]), rounds=200, tolerance=1e-14)
    assert x == pytest.approx([3, 9], abs=0.05) and value < 1e-3
    t = np.arange(30.0)
    x, loss = least_squares(lambda x: x[0] * np.exp(-x[1] * t) - 5 * np.exp(-0.2 * t), np.array([1.0, 0.1]))
    assert x == pytest.approx([5, 0.2], abs=1e-4) and loss < 1e-8


def test_coefficients_are_stationary_and_products_multiply():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ar = arima.coefficients(rng.normal(size=3) * 2)
        assert np.abs(np.roots(np.r_[1.0, -ar])).max() < 1
    assert arima.product(np.array([0.5]), np.array([0.4]), 3) == pytest.approx([0.5, 0, 0.4, -0.2])


def test_orders_of_differencing():
    t = np.arange(400)
    noise = np.random.default_rng(5).normal(size=400)
    assert arima.differences(noise, 7) == (0, 0)
    assert arima.differences(np.cumsum(noise) + 5, 7) == (1, 0)
    assert arima.differences(10 * np.sin(2 * np.pi * t / 7) + noise, 7) == (0, 1)
    assert arima.differences(np.cumsum(np.cumsum(noise)), 7)[0] == 2
    assert arima.differences(np.full(50, 3.0), 7) == (0, 0)


SERIES = {"ar": simulated([0.7], [], 500, 1, mean=10), "ma": simulated([], [0.7], 500, 2, mean=5), "walk": simulated([0.6], [], 500, 4, d=1)}


def local_search(model, y, m):
    """The same search in plain loops."""
    y = automodels.filled(y)
    hint, tried = model.hint(y, m), []
    for spec in model.specs():
        criterion, found = model.fit(y, spec, hint, m)
        if criterion < math.inf:
            tried.append((criterion, spec, found))
    tried = sorted(tried, key=lambda t: t[:2])[: model.shortlist or None]
    full = [(*model.finish(y, spec, hint, m, found), spec) for _, spec, found in tried]
    criterion, found, spec = min(full, key=lambda t: (t[0], t[2]))
    return spec, hint, criterion, model.state(y, spec, hint, m, found)


def test_search_equals_plain_loops_and_finds_the_orders(spark):
    model = automodels.AutoArima(max_p=2, max_q=2, max_season_p=0, max_season_q=0)
    panel = panel_of(spark, SERIES | {"short": np.arange(9.0), "gaps": np.where(np.arange(60) % 5 == 0, np.nan, np.arange(60.0) % 7)})
    table = spark.sql("SELECT 0S AS window_id, 0 AS inner, timestamp_ntz'2024-01-01' AS train_start, timestamp_ntz'2030-01-01' AS cutoff")
    got = {r["unique_id"]: r for r in automodels.fitted_states(model, automodels.slices(panel, table), 7, min_context=14).collect()}
    assert set(got) == {"ar", "ma", "walk", "gaps"}
    for name, y in SERIES.items():
        spec, hint, criterion, state = local_search(model, y, 7)
        assert (got[name]["spec"], got[name]["hint"]) == (spec, hint) and got[name]["criterion"] == pytest.approx(criterion) and got[name]["state"] == pytest.approx(state)


def test_search_finds_simulated_orders(spark):
    kinds = {"1,0,0,0,1 0,0": ([0.7], [], 0, 10), "0,1,0,0,1 0,0": ([], [0.7], 0, 5), "1,0,0,0,0 1,0": ([0.6], [], 1, 0), "2,0,0,0,1 0,0": ([0.9, -0.6], [], 0, 3)}
    series = {f"{want}|{k}": simulated(ar, ma, 400, 100 * k + i, d, mean) for i, (want, (ar, ma, d, mean)) in enumerate(kinds.items()) for k in range(6)}
    table = spark.sql("SELECT 0S AS window_id, 0 AS inner, timestamp_ntz'2024-01-01' AS train_start, timestamp_ntz'2030-01-01' AS cutoff")
    model = automodels.AutoArima(max_p=2, max_q=2, max_season_p=0, max_season_q=0, shortlist=0)
    got = automodels.fitted_states(model, automodels.slices(panel_of(spark, series), table), 7, min_context=14).collect()
    assert len(got) == 24
    exact = 0
    for r in got:
        spec, hint = r["unique_id"].split("|")[0].split(" ")
        exact += (spec, hint) == (r["spec"], r["hint"])
        if hint == r["hint"]:  # a larger order may win by a little, never by much
            y = series[r["unique_id"]]
            true = model.finish(y, spec, hint, 7, model.fit(y, spec, hint, 7)[1])[0]
            assert -1e-3 <= true - r["criterion"] < 8
    assert exact >= 10 and sum(r["unique_id"].split("|")[0].split(" ")[1] == r["hint"] for r in got) >= 20


def test_forecasts_follow_the_recursion():
    y = SERIES["walk"]
    model, spec, hint = automodels.AutoArima(), "2,1,0,0,1", "1,0"
    _, x = model.fit(y, spec, hint, 7)
    ar, ma, mean = arima.polynomials(x, (2, 1, 0, 0, 1), 7)
    w = np.diff(y)
    e, w = arima.exact_likelihood(w - mean, ar, ma)[2].tolist(), list(w)
    last, want = y[-1], []
    for _ in range(5):
        now = mean + sum(a * (w[-1 - i] - mean) for i, a in enumerate(ar)) + sum(b * e[-1 - j] for j, b in enumerate(ma))
        w.append(now)
        e.append(0.0)
        last += now
        want.append(last)
    assert model.forecast(model.state(y, spec, hint, 7, x), spec, 5) == pytest.approx(want)


def test_seasonal_arima_continues_a_season():
    t = np.arange(300)
    y = 20 + 5 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(7).normal(size=300) * 0.3
    model = automodels.AutoArima(max_p=1, max_q=1)
    spec, hint, _, state = local_search(model, y, 12)
    ahead = np.arange(300, 324)
    assert hint.endswith("1") and np.abs(model.forecast(state, spec, 24) - 20 - 5 * np.sin(2 * np.pi * ahead / 12)).max() < 1


def test_smoothing_forms_and_their_likelihood():
    assert len(ets.forms()) == 15 and ets.forms("AAN") == ["AAN", "ADN"] and ets.forms("MNM") == ["MNM"] and "AAM" not in ets.forms("ZZM")
    rng, t = np.random.default_rng(2), np.arange(200)
    y = 50 + 0.2 * t + 6 * np.sin(2 * np.pi * t / 7) + rng.normal(size=200)
    criteria = {f: ets.fit(y, f, 7)[0] for f in ets.forms()}
    assert min(criteria, key=criteria.get)[1:] == "AA" and criteria["ANN"] > criteria["AAA"] + 100
    best, found = ets.fit(y, "ANN", 7)
    grid = [ets.likelihood(*ets.run(y.tolist(), "ANN", (a, 0, 0, 0), float(found[4]), 0.0, [0.0])[:2], "ANN") for a in np.linspace(0.01, 0.99, 99)]
    assert ets.likelihood(*ets.run(y.tolist(), "ANN", tuple(found[:4]), float(found[4]), 0.0, [0.0])[:2], "ANN") <= min(grid) + 1e-6 * abs(min(grid))
    assert ets.fit(-y, "MNN", 7)[0] == math.inf and ets.fit(y[:9], "ANA", 7)[0] == math.inf


@pytest.mark.parametrize("form", ["AAA", "MAM", "ADN", "ANA"])
def test_smoothing_recursion_equals_the_textbook_one(form):
    rng = np.random.default_rng(8)
    y, m = 30 + rng.normal(size=60).cumsum() * 0.3, 4
    alpha, beta, gamma, phi = 0.4, 0.1 * (form[1] != "N"), 0.2 * (form[2] != "N"), {"N": 0.0, "A": 1.0, "D": 0.9}[form[1]]
    season = {"N": [0.0], "A": [1.0, -1.0, 0.5, -0.5], "M": [1.1, 0.9, 1.05, 0.95]}[form[2]]
    out, means, level, slope, left = ets.run(y.tolist(), form, (alpha, beta, gamma, phi), 30.0, 0.1, season)
    lv, b, s = 30.0, 0.1, list(season) if form[2] != "N" else [1.0 if form[2] == "M" else 0.0] * m
    for t, v in enumerate(y):  # errors relative to the mean under a multiplicative error
        base = lv + phi * b
        mean = base * s[t % m] if form[2] == "M" else base + s[t % m]
        assert (means[t], out[t]) == pytest.approx((mean, v - mean))
        if form[0] == "M":
            r = (v - mean) / mean
            lv, b, s[t % m] = base * (1 + alpha * r), phi * b + beta * base * r, s[t % m] * (1 + gamma * r)
        else:
            r = v - mean
            lv, b, s[t % m] = base + alpha * r, phi * b + beta * r, s[t % m] + gamma * r
    assert (level, slope) == pytest.approx((lv, b)) and (form[2] == "N" or left == pytest.approx(s))


def season_panel(spark, n=120):
    t, rng = np.arange(n), np.random.default_rng(6)
    return panel_of(spark, {"a": 40 + 4 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n), "b": 20 + 0.3 * t + rng.normal(size=n)})


def test_intervals_equal_errors_of_inner_origins(spark):
    panel, plan = season_panel(spark), BacktestPlan(h=4, n_windows=2, gap=1)
    model = automodels.AutoEts("ANZ")
    run = automodels.auto_backtest(panel, plan, model, calibration=3)
    got = run.forecasts.toPandas().set_index(["unique_id", "window_id", "h_step"]).sort_index()
    assert len(got) == 2 * 2 * 4 and got["q_5000"].equals(got["y_hat"].rename("q_5000")) and got["q_2500"].isna().all()
    values = panel.df.toPandas().pivot(index="ds", columns="unique_id", values="y")
    for (name, window), part in got.groupby(level=[0, 1]):
        cutoff = values.index.get_loc(part["cutoff"].iloc[0])
        y = values[name].to_numpy()
        fit = lambda end, h: (lambda s: model.forecast(s[3], s[0], h))(local_search(model, y[: end + 1], 7))  # noqa: E731,B023
        assert part["y_hat"].to_numpy() == pytest.approx(fit(cutoff, 5)[1:])
        errors = np.array([y[c + 2 : c + 6] - fit(c, 5)[1:] for c in (cutoff - 1 - 4 * k for k in (1, 2, 3))])
        assert cutoff + 2 == values.index.get_loc(part["ds"].iloc[0])
        for q in (0.025, 0.1, 0.9, 0.975):
            want = np.quantile(np.r_[np.abs(errors), -np.abs(errors)], q, axis=0)
            assert (part[f"q_{round(q * 10000):04d}"] - part["y_hat"]).to_numpy() == pytest.approx(want)


def test_windows_without_a_refit_use_the_latest_state(spark):
    panel, model = season_panel(spark), automodels.AutoEts("AAN")
    run = automodels.auto_backtest(panel, BacktestPlan(h=3, n_windows=5, refit_every=2), model, calibration=0)
    runs = {r["window_id"]: (r["refit"], r["fit_window"], r["status"], r["refit_every"]) for r in run.model_runs.collect()}
    assert runs == {0: (True, 0, "ok", 2), 1: (False, 0, "ok", 2), 2: (True, 2, "ok", 2), 3: (False, 2, "ok", 2), 4: (True, 4, "ok", 2)}
    got = run.forecasts.toPandas().sort_values("ds")
    values = panel.df.where("unique_id = 'b'").orderBy("ds").toPandas()["y"].to_numpy()
    for window in range(5):
        part = got[(got["unique_id"] == "b") & (got["window_id"] == window)]
        fit_end = 120 - 3 * (5 - window // 2 * 2)
        spec, _, _, state = local_search(model, values[:fit_end], 7)
        assert part["y_hat"].to_numpy() == pytest.approx(model.forecast(state, spec, 3 * (1 + window % 2))[-3:])
    once = automodels.auto_backtest(panel, BacktestPlan(h=3, n_windows=3), model, calibration=0)
    assert [r["fit_window"] for r in once.model_runs.orderBy("window_id").collect()] == [0, 0, 0]
    with pytest.raises(ValueError, match="refit"):
        automodels.auto_backtest(panel, BacktestPlan(h=3, n_windows=3, refit_every=2), model)
    with pytest.raises(ValueError, match="two"):
        automodels.auto_backtest(panel, BacktestPlan(h=3, n_windows=3), model, calibration=1)
    with pytest.raises(ValueError):
        BacktestPlan(h=3, n_windows=3, refit_every=0)
    with pytest.raises(ValueError, match="percent"):
        automodels.calibrated_quantiles((80, 100), (0.5,))


def test_short_series_are_skipped(spark):
    run = automodels.auto_backtest(panel_of(spark, {"a": np.arange(12.0)}), BacktestPlan(h=2, n_windows=2), automodels.AutoEts("ANN"))
    assert run.forecasts.collect() == [] and {r["status"] for r in run.model_runs.collect()} == {"skipped"}


def test_intervals_of_any_forecaster(spark, tmp_path):
    panel, plan = season_panel(spark), BacktestPlan(h=3, n_windows=2)

    def last(train, window, ahead):
        value = train.df.groupBy("unique_id").agg(F.max_by("y", "ds").alias("y_hat"))
        return ahead.select("unique_id", "ds").join(value, "unique_id")

    wrapped = automodels.calibrated(last, h=3, windows=3, quantiles=plan.quantiles)
    run = run_forecasters(panel, plan, {"last": wrapped}, str(tmp_path))
    got = run.forecasts.toPandas()
    values = panel.df.toPandas().pivot(index="ds", columns="unique_id", values="y")
    assert len(got) == 12 and got["q_2500"].isna().all()
    for r in got.itertuples():
        at = values.index.get_loc(r.cutoff)
        y = values[r.unique_id].to_numpy()
        errors = np.abs([y[c + r.h_step] - y[c] for c in (at - 3, at - 6, at - 9)])
        assert r.y_hat == y[at] and r.q_9000 - r.y_hat == pytest.approx(np.quantile(np.r_[errors, -errors], 0.9))


def test_specs_stay_within_their_bounds():
    specs = automodels.AutoArima(2, 2, 1, 1, 3).specs()
    orders = [tuple(map(int, s.split(","))) for s in specs]
    assert len(set(orders)) == len(orders) == 2 * sum(1 for o in itertools.product(range(3), range(3), range(2), range(2)) if sum(o) <= 3)


def test_stateful_forecasters_refit_by_the_plan(spark, tmp_path):
    panel, model = season_panel(spark), automodels.AutoEts("AAN")
    plan = BacktestPlan(h=3, n_windows=4, refit_every=2)
    fits = []

    def broken(train, window):
        fits.append(window["window_id"])
        if window["window_id"] == 0:
            raise RuntimeError("no fit")
        return train.df.groupBy("unique_id").agg(F.max_by("y", "ds").alias("y_hat"))

    flaky = Stateful(broken, lambda state, window, ahead: ahead.select("unique_id", "ds").join(state, "unique_id"))
    run = run_forecasters(panel, plan, {"ets": automodels.stateful(model, panel, plan), "flaky": flaky}, str(tmp_path))
    whole = automodels.auto_backtest(panel, plan, model, calibration=0)
    key = ["unique_id", "window_id", "h_step"]
    got, want = (f.where("model_id <> 'flaky'").select(*key, "y_hat").toPandas().set_index(key).sort_index() for f in (run.forecasts, whole.forecasts))
    assert len(got) == 24 and got["y_hat"].to_numpy() == pytest.approx(want["y_hat"].to_numpy())
    runs = {(r["model_id"], r["window_id"]): (r["status"], r["refit"], r["refit_every"]) for r in run.model_runs.collect()}
    assert [runs["ets", k] for k in range(4)] == [("ok", True, 2), ("ok", False, 2), ("ok", True, 2), ("ok", False, 2)]
    # Without a state the next window fits, and from there on every other one.
    assert fits == [0, 1, 3] and [runs["flaky", k] for k in range(4)] == [("failed", True, 2), ("ok", True, 2), ("ok", False, 2), ("ok", True, 2)]
    assert BacktestPlan(h=1, n_windows=5).refit_every is None and automodels.stateful(model, panel, plan).refit_every(BacktestPlan(h=1, n_windows=5), 5) == 5
