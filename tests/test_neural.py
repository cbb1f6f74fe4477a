"""Networks: gradients against differences, sums in Spark against one sum, forecasts and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_automodels import panel_of
from tsforge.functions.networks import Adam, Autoencoder, QuantileForecaster
from tsforge.operators import neural
from tsforge.operators.runs import run_forecasters
from tsforge.spec import BacktestPlan, LeakError


@pytest.mark.parametrize("net", [Autoencoder(3, 2), QuantileForecaster(2, (0.1, 0.5, 0.9), hidden=3)])
def test_gradients_equal_differences(net):
    rng = np.random.default_rng(1)
    flat, x, y = net.start(3) + 0.1 * rng.normal(size=net.size()), rng.normal(size=(5, 6)), rng.normal(size=(5, 2))
    loss, slope = net.gradient(flat, x, y)
    for k in range(net.size()):
        step = np.zeros(net.size())
        step[k] = 1e-6
        assert slope[k] == pytest.approx((net.gradient(flat + step, x, y)[0] - net.gradient(flat - step, x, y)[0]) / 2e-6, abs=1e-6)
    halves = [net.gradient(flat, x[a], y[a]) for a in (slice(0, 2), slice(2, 5))]
    assert loss == pytest.approx(sum(h[0] for h in halves)) and slope == pytest.approx(sum(h[1] for h in halves))


def test_steps_of_the_optimiser():
    adam, x = Adam(2, 0.05), np.array([3.0, -2.0])
    for _ in range(600):
        x = adam.step(x, 2 * (x - [1.0, 0.5]))
    assert x == pytest.approx([1.0, 0.5], abs=0.01)


def wave_panel(spark, n=150):
    t, rng = np.arange(n), np.random.default_rng(2)
    a, b = 10 + 3 * np.sin(2 * np.pi * t / 7) + 0.1 * rng.normal(size=n), 100 + 30 * np.sin(2 * np.pi * (t + 2) / 7) + rng.normal(size=n)
    a[[30, 31]] = np.nan
    return panel_of(spark, {"a": a, "b": b, "short": np.arange(6.0)})


def test_samples_and_scales(spark):
    panel = wave_panel(spark)
    scale = {r["unique_id"]: (r["mean"], r["spread"]) for r in neural.scalers(panel.df).collect()}
    values = panel.df.where("unique_id = 'a'").orderBy("ds").toPandas()["y"].to_numpy()
    assert scale["a"] == pytest.approx((np.nanmean(values), np.nanstd(values)))
    made = neural.samples(neural.scaled(panel.df, neural.scalers(panel.df)), context=7, horizon=3).where("unique_id = 'a'").orderBy("ds").toPandas()
    want = [(v[:7], v[7:]) for k in range(141) if np.isfinite(v := (values[k : k + 10] - scale["a"][0]) / scale["a"][1]).all()]
    # A gap shortens what is gathered around it, so no sample reaches over one.
    assert len(made) == len(want)
    for (x, y), r in zip(want, made.itertuples(), strict=True):
        assert np.array(r.x) == pytest.approx(x) and np.array(r.y) == pytest.approx(y)


def test_sums_of_gradients_equal_one_sum(spark):
    rows = neural.samples(neural.scaled(wave_panel(spark).df, neural.scalers(wave_panel(spark).df)), context=7, horizon=2).repartition(5)
    net = QuantileForecaster(2, (0.5,), hidden=4)
    flat = net.start(0)
    loss, slope, n = neural.batch_gradient(rows, net, flat)
    held = rows.toPandas()
    want = net.gradient(flat, np.array(held["x"].tolist()), np.array(held["y"].tolist()))
    assert n == len(held) and loss == pytest.approx(want[0]) and slope == pytest.approx(want[1], abs=1e-9)
    assert neural.batch_gradient(rows.where("false"), net, flat)[2] == 0
    with pytest.raises(ValueError, match="no sample"):
        neural.trained(rows.where("false"), net, neural.Training(epochs=1))


def test_forecasts_of_a_season(spark, tmp_path):
    panel = wave_panel(spark).select_ids(["a", "b"])
    plan = BacktestPlan(h=4, n_windows=1, gap=1, quantiles=(0.1, 0.5, 0.9))
    made = neural.lstm_forecaster(str(tmp_path / "s"), context=14, horizon=5, quantiles=plan.quantiles, hidden=8, how=neural.Training(epochs=20, batches=2, rate=0.03))
    run = run_forecasters(panel, plan, {"lstm": made}, str(tmp_path / "r"))
    got = run.forecasts.toPandas()
    assert len(got) == 8 and [r["status"] for r in run.model_runs.collect()] == ["ok"] and (got["q_9000"] >= got["q_1000"]).all()
    assert (got["y_hat"] - got["y"]).abs()[got["unique_id"] == "a"].max() < 2 and (got["y_hat"] - got["y"]).abs()[got["unique_id"] == "b"].max() < 20
    with pytest.raises(ValueError, match="median"):
        neural.lstm_forecaster("x", context=3, horizon=2, quantiles=(0.1,))


def test_errors_of_what_isnt_like_the_past(spark, tmp_path):
    frame = wave_panel(spark, 220).df.where("unique_id <> 'short'")
    times = [r["ds"] for r in frame.select("ds").distinct().orderBy("ds").collect()]
    past, later = frame.where(F.col("ds") <= F.lit(times[169])), frame.where(F.col("ds") > F.lit(times[169]))
    spoiled = past.withColumn("y", F.when(F.col("ds") == F.lit(times[50]), 500.0).otherwise(F.col("y")))
    net = Autoencoder(8, 3)
    fitted = neural.fit_autoencoder(spoiled, str(tmp_path), length=7, net=net, how=neural.Training(epochs=15, batches=2, rate=0.03))
    assert fitted.losses[-1] < 0.5 * fitted.losses[0]
    odd = later.withColumn("y", F.when(F.col("ds") == F.lit(times[200]), F.col("y") * 3).otherwise(F.col("y")))
    got = fitted.score(odd).toPandas().set_index(["unique_id", "ds"]).sort_index()
    assert len(got) == 100 and got["scorable"].all()
    pool = np.sort(fitted.pool.toPandas()["residual"].to_numpy())
    scale = {r["unique_id"]: r for r in fitted.scale.collect()}
    values = spoiled.union(odd).toPandas().pivot(index="ds", columns="unique_id", values="y")
    assert fitted.calib_n == len(pool) == 2 * 51
    for (name, ds), r in list(got.iterrows())[::7]:
        k = values.index.get_loc(ds)
        x = ((values[name].to_numpy()[k - 6 : k + 1] - scale[name]["mean"]) / scale[name]["spread"])[None]
        off = x - net.apply(fitted.flat, x)
        p = (1 + (pool >= (off**2).mean() - 1e-12).sum()) / (len(pool) + 1)
        assert r["score"] == pytest.approx(-math.log10(p), abs=1e-6) and r["side"] == np.sign(off[0, -1])
    assert got.xs("b")["score"].loc[times[200] : times[206]].min() >= got["score"].max() - 1e-9
    with pytest.raises(LeakError):
        fitted.score(past)


def test_windows_with_odd_points_are_left_out(spark):
    rows = spark.createDataFrame([("a", [0.0, 1.0, -1.0]), ("b", [0.5, 50.0, 0.1]), ("c", [-0.5, 0.2, 0.3])], "unique_id string, x array<double>")
    assert sorted(r["unique_id"] for r in neural.trimmed(rows, trim_z=5.0).collect()) == ["a", "c"]
